"""Extraction from web pages by union-free regular expressions, one wrapper per host.

A page is a stream of tags and text slots; tags that are closed hold what is between. Neighbours of one name, and adjacent
copies of a run of nodes, are folded into a repeated group, again and again, so that repeats inside repeats are found. A
host's pages differ then in few folded streams. Those are aligned one after another: nodes of one name match and their
contents are aligned in turn; a run that occurs once where another page repeats it becomes the group; what has no
counterpart becomes optional. The result has no unions: tags, text slots, (optional)? and (repeated)+ groups only, and
derives every stream that went into it.

With the wrapper every page of the host is read: its texts go to the wrapper's slots. A slot whose text is the same on all
pages of the host that have it is part of the template; the others are data.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

FAN, DEEPEST = 512, 100
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<!\w[^>]*>|<(/?[a-zA-Z][\w:-]*)[^>]*>|([^<]+|<)", re.S | re.I)
TEXT = "#"


def tokens(page: str) -> list[tuple[str, str]]:
    """(token, text): tags by lower-case name with / if closing, and texts; comments, scripts, styles, blank texts fall away."""
    out = []
    for m in _TOKEN.finditer(page):
        if m[2]:
            out.append((m[2].lower(), ""))
        elif m[3]:
            t = " ".join(html.unescape(m[3]).split())
            if t:
                if out and out[-1][0] == TEXT:
                    out[-1] = (TEXT, f"{out[-1][1]} {t}")
                else:
                    out.append((TEXT, t))
    return out


def tree(toks: list[tuple[str, str]]) -> list[tuple]:
    """Nodes (label, children or text): a closed tag has its name as label, one that stands alone its name and a slash.

    A tag that is never closed stands alone, and so do those nested deeper than ``DEEPEST``.
    """
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]
    names: dict[str, int] = {}

    def leave() -> None:
        # The innermost open tag was never closed: it stands alone, what it held follows it.
        name, held = stack.pop()
        names[name] -= 1
        above = stack[-1][1]
        above[-1] = (f"{name}/", None)
        above += held

    for token, text in toks:
        if token == TEXT:
            stack[-1][1].append((TEXT, text))
        elif not token.startswith("/"):
            if len(stack) > DEEPEST:
                stack[-1][1].append((f"{token}/", None))
                continue
            held: list = []
            stack[-1][1].append((token, held))
            stack.append((token, held))
            names[token] = names.get(token, 0) + 1
        elif names.get(token[1:]):
            while stack[-1][0] != token[1:]:
                leave()
            stack.pop()
            names[token[1:]] -= 1
        else:
            stack[-1][1].append((f"{token}/", None))
    while len(stack) > 1:  # where the page ends, html and body end as well
        if stack[-1][0] in ("html", "body"):
            stack.pop()
        else:
            leave()
    return root


# An expression is a tuple of nodes (label, body, repeated, optional). Labels of groups are the tuples of their nodes'.


@lru_cache(200_000)
def fold(labels: tuple, groups: tuple = ()) -> tuple:
    """(label, members) of a run of labels: neighbours alike are one node, adjacent copies of a run one group.

    Members are places in the run; those of a group are its copies, each a run of nodes. ``groups`` are the labels of groups
    that are made also of a single copy.
    """
    items: list = []
    for i, x in enumerate(labels):
        if items and items[-1][0] == x:
            items[-1][1].append(i)
        else:
            items.append((x, [i]))
    while (found := _copies([x for x, _ in items])) is not None:
        size, places = found
        out, i = [], 0
        for at, n in places:
            out += items[i:at]
            out.append((tuple(x for x, _ in items[at : at + size]), [items[at + k * size : at + (k + 1) * size] for k in range(n)]))
            i = at + n * size
        items = _joined(out + items[i:])
    for name in groups:
        out, i, n = [], 0, len(name)
        while i < len(items):
            if tuple(x for x, _ in items[i : i + n]) == name:
                out.append((name, [items[i : i + n]]))
                i += n
            else:
                out.append(items[i])
                i += 1
        items = _joined(out)
    return tuple(items)


def _copies(labels: list) -> tuple[int, list[tuple[int, int]]] | None:
    """The shortest run, of two labels or more, that is followed by a copy of itself: (size, [(first place, copies)]), from the left.

    A run of any length is found. A label that occurs once is in no copy, so only what lies between such labels is looked at.
    """
    if len(labels) < 4:
        return None
    count: dict = {}
    for x in labels:
        count[x] = count.get(x, 0) + 1
    number = {x: k for k, x in enumerate(count)}
    parts, begin = [], 0
    for i, x in enumerate([*labels, None]):
        if x is None or count[x] == 1:
            if i - begin >= 4:
                parts.append((begin, np.array([number[y] for y in labels[begin:i]])))
            begin = i + 1
    for size in range(2, max((len(x) for _, x in parts), default=0) // 2 + 1):
        places = []
        for begin, x in parts:
            if len(x) < 2 * size:
                continue
            same = x[:-size] == x[size:]
            edge = np.flatnonzero(np.diff(same.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            places += [(begin + a, (b - a) // size + 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= size]
        if places:
            return size, places
    return None


def _joined(items: list) -> list:
    out: list = []
    for x, members in items:
        if out and out[-1][0] == x:
            out[-1] = (x, out[-1][1] + members)
        else:
            out.append((x, members))
    return out


def expression(nodes: list[tuple], groups: tuple = ()) -> tuple:
    """The folded expression of a page's nodes."""
    return tuple(_node(x, members, nodes, groups) for x, members in fold(tuple(n[0] for n in nodes), groups))


def _node(label, members, nodes, groups) -> tuple:
    if isinstance(label, tuple):
        copies = [tuple(_node(x, m, nodes, groups) for x, m in copy) for copy in members]
        body = copies[0]
        for c in copies[1:]:
            body = tuple(map(_merged, body, c))
        return (label, body, True, False)
    if label == TEXT or label.endswith("/"):
        return (label, (), len(members) > 1, False)
    body: tuple | None = None
    for e in dict.fromkeys(expression(nodes[i][1], groups) for i in members):
        body = e if body is None else merge(body, e)
    return (label, body, len(members) > 1, False)


def regroup(expr: tuple, groups: tuple) -> tuple:
    """An expression folded again with groups that others have."""
    out = []
    for label, members in fold(tuple(n[0] for n in expr), groups):
        out.append(_again(label, members, expr, groups))
    return tuple(out)


def _again(label, members, expr, groups) -> tuple:
    """One node of the members: places of nodes, or copies of a run that has become a group."""
    nodes = []
    for m in members:
        if isinstance(m, list):
            body = tuple(_again(x, inner, expr, groups) for x, inner in m)
            nodes.append((label, body, True, all(n[3] for n in body)))
        else:
            nodes.append(_inside(expr[m], groups))
    got = nodes[0]
    for n in nodes[1:]:
        got = _merged(got, n)
    return (got[0], got[1], got[2] or len(nodes) > 1, all(n[3] for n in nodes))


def _inside(n: tuple, groups: tuple) -> tuple:
    """A node with what it holds regrouped; a group keeps its run of nodes."""
    body = tuple(_inside(x, groups) for x in n[1]) if isinstance(n[0], tuple) else regroup(n[1], groups)
    return (n[0], body, n[2], n[3])


def groups_of(expr: tuple) -> set[tuple]:
    out = set()
    for label, body, _, _ in expr:
        out |= groups_of(body) | ({label} if isinstance(label, tuple) else set())
    return out


def align(a: tuple, b: tuple) -> list[tuple[int, int]]:
    """The longest common subsequence of two runs of labels, as places (i, j)."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(y) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
    pairs, i, j = [(k, k) for k in range(lo)], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            pairs.append((lo + i, lo + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs + [(len(a) - hi + k, len(b) - hi + k) for k in range(hi)]


def _merged(m: tuple, n: tuple) -> tuple:
    """Two nodes of one label as one."""
    if m == n:
        return m
    body = tuple(map(_merged, m[1], n[1])) if isinstance(m[0], tuple) else merge(m[1], n[1])
    return (m[0], body, m[2] or n[2], m[3] or n[3])


@lru_cache(50_000)
def merge(a: tuple, b: tuple) -> tuple:
    """The expression of both: nodes that match are merged, what only one has is optional."""
    if a == b:
        return a
    out, i, j = [], 0, 0
    for p, q in [*align(tuple(n[0] for n in a), tuple(n[0] for n in b)), (len(a), len(b))]:
        out += [(*n[:3], True) for n in a[i:p]] + [(*n[:3], True) for n in b[j:q]]
        if p < len(a):
            out.append(_merged(a[p], b[q]))
        i, j = p + 1, q + 1
    return tuple(out)


def show(expr: tuple) -> str:
    """The expression as text: tags, # for text slots, (…)+ and (…)?."""
    out = []
    for label, body, repeated, optional in expr:
        inner = show(body) if isinstance(label, tuple) else label if label == TEXT else f"<{label}>" if label.endswith("/") else f"<{label}>{show(body)}</{label}>"
        inner = f"({inner})+" if repeated else inner
        out.append(f"({inner})?" if optional else inner)
    return "".join(out)


@lru_cache(20_000)
def parse(text: str) -> tuple:
    """The inverse of :func:`show`."""
    stack: list[list] = [[]]
    for m in re.finditer(r"<(/?[^<>/]+/)>|</([^<>/]+)>|<([^<>/]+)>|(#)|(\()|\)([+?])", text):
        if m[5] or m[3]:
            stack.append([])
        elif m[2]:
            body = tuple(stack.pop())
            stack[-1].append((m[2], body, False, False))
        elif m[6]:
            body = stack.pop()
            if m[6] == "?":
                stack[-1].append((*body[0][:3], True))
            elif len(body) > 1:
                stack[-1].append((tuple(n[0] for n in body), tuple(body), True, False))
            else:
                stack[-1].append((*body[0][:2], True, body[0][3]))
        else:
            stack[-1].append((m[1] or TEXT, (), False, False))
    return tuple(stack[0])


def _ordered(groups: set[tuple]) -> tuple:
    return tuple(sorted(groups, key=lambda g: (-len(g), str(g))))


def infer(streams: list[str]) -> str:
    """The wrapper of folded streams (or of wrappers), aligned one after another from the longest."""
    exprs = sorted({parse(s) for s in streams}, key=lambda e: (-len(e), show(e)))
    groups = _ordered(set().union(*map(groups_of, exprs)) if exprs else set())
    wrapper: tuple | None = None
    for e in dict.fromkeys(regroup(e, groups) for e in exprs):
        wrapper = e if wrapper is None else merge(wrapper, e)
    return show(wrapper or ())


class Reader:
    """A wrapper made ready for reading pages; how a run of labels falls on the wrapper's nodes is remembered."""

    def __init__(self, wrapper: str):
        self.root = parse(wrapper)
        self.groups = _ordered(groups_of(self.root))
        self.plans: dict[tuple, list] = {}

    def _plan(self, labels: tuple, body: tuple, path: str) -> list:
        """For each child its slot's path and its node's body; () where the wrapper has no such node."""
        key = (path, labels)
        if key not in self.plans:
            out: list = [None] * len(labels)
            self._fall(fold(labels, self.groups), body, path, out)
            self.plans[key] = out
        return self.plans[key]

    def _fall(self, items, body: tuple, path: str, out: list) -> None:
        pair = {j: i for i, j in align(tuple(n[0] for n in body), tuple(x for x, _ in items))}
        for j, (label, members) in enumerate(items):
            i = pair.get(j)
            here, inner = (f"{path}{i}", body[i][1]) if i is not None else (f"{path}x{j}", ())
            if isinstance(label, tuple):
                for copy in members:
                    for k, one in enumerate(copy):
                        self._fall((one,), inner[k : k + 1], f"{here}.{k}.", out)
            else:
                for m in members:
                    out[m] = (here, inner)

    def slots(self, page: str) -> dict[str, list[str]]:
        """The texts of each slot; a slot inside repeated groups has several, in order."""
        out: dict[str, list[str]] = {}
        work = [(tree(tokens(page)), self.root, "")]
        while work:
            nodes, body, path = work.pop()
            plan = self._plan(tuple(n[0] for n in nodes), body, path)
            below = []
            for (label, held), (here, inner) in zip(nodes, plan):
                if label == TEXT:
                    out.setdefault(here, []).append(held)
                elif held:
                    below.append((held, inner, f"{here}."))
            work += reversed(below)
        return out


@lru_cache(256)
def reader(wrapper: str) -> Reader:
    return Reader(wrapper)


def extract(page: str, wrapper: str) -> list[tuple[str, list[str]]]:
    """(slot, texts) of a page."""
    return list(reader(wrapper).slots(page).items())


def host_of(url):
    """The host of an address in lower case, without user and port; '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _streams(batches):
    for batch in batches:
        got = [show(expression(tree(tokens(p)))) for p in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], ["host", "stream"])


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper``. A host's distinct streams are merged ``FAN`` at a time, then what results, until one is left; nulls are empty pages."""
    rows = pages.select(host_of(F.col(url_col).cast("string")).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    streams = cut(rows.mapInArrow(_streams, "host string, stream string").distinct(), "streams")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "stream": [infer(pdf["stream"].tolist())]})

    while True:
        sizes = streams.groupBy("host").agg(F.ceil(F.count("*") / FAN).alias("parts"))
        most = sizes.agg(F.max("parts")).first()[0] or 0
        parts = streams.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("stream"), "parts"))
        streams = parts.groupBy("host", "part").applyInPandas(one, "host string, stream string")
        if most <= 1:
            return streams.withColumnRenamed("stream", "wrapper")
        streams = cut(streams.distinct(), "streams")


def _fields(batches):
    kind = pa.list_(pa.struct([("slot", pa.string()), ("texts", pa.list_(pa.string()))]))
    for batch in batches:
        got = [[{"slot": s, "texts": t} for s, t in extract(p, w)] for p, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, kind)], ["page_id", "host", "fields"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, slot, texts`` for each data slot of each page, and the wrapper's template texts left out.

    A slot that only one page of the host has is data. Null or empty pages have no slot, and so no row. Pages without a
    host share the host ''. Rows that repeat an id and a page count once; rows with one id and several pages each report
    their slots. Ids are integers, or are cast to such. Null ids are left out. Empty in, empty out.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host_of(F.col(url_col).cast("string")).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).where("page_id IS NOT NULL")
    wraps = cut(wrappers(pages.where(F.col(id_col).isNotNull()), url_col, html_col), "wrappers")
    read = rows.join(wraps, "host").select("page_id", "host", "html", "wrapper").mapInArrow(_fields, "page_id bigint, host string, fields array<struct<slot:string,texts:array<string>>>")
    read = cut(read, "slots")
    if not read.groupBy("page_id", F.xxhash64("fields")).count().where("count > 1").isEmpty():
        read = cut(read.dropDuplicates(), "slots-once")
    texts = read.select("host", F.explode("fields").alias("f")).select("host", "f.slot", F.xxhash64("f.texts").alias("h"))
    seen = texts.groupBy("host", "slot").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("n"))
    # One row for each host goes to its pages: the texts themselves aren't shuffled unless the hosts are too many to broadcast.
    data = cut(seen.where("lo <> hi OR n = 1").groupBy("host").agg(F.collect_list("slot").alias("data")), "data-slots")
    kept = read.join(data, "host").select("page_id", "host", F.explode(F.filter("fields", lambda f: F.array_contains("data", f["slot"]))).alias("f"))
    return kept.select("page_id", "host", "f.slot", "f.texts")
