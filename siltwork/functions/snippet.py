"""Snippets: the places of a text where a query's words occur, with context, the words in brackets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_single_cjk, py_ellipsis, py_tokens

CLUSTER_GAP, RANGE_GAP, NO_MATCH = 40, 5, 300
_WORDLIKE = re.compile(r"[0-9A-Za-z_]|[^\x00-\x7f]")


def query_words(query: str) -> list[str]:
    """The words looked for: distinct, in lower case, no single CJK letters."""
    return list(dict.fromkeys(t for t in (x.lower() for x in py_tokens(query)) if t and not is_single_cjk(t)))


def _lower(text: str) -> str:
    """Lower case of the same length, so that places stay places."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _bounded(text: str, a: int, b: int) -> bool:
    return not (a > 0 and _WORDLIKE.match(text[a - 1])) and not (b < len(text) and _WORDLIKE.match(text[b]))


def snippets(text: str, query: str, most: int = 3, before: int = 60, after: int = 100) -> str:
    """Up to ``most`` ranges around the matches, joined by an ellipsis; without a match the text's beginning."""
    if not text:
        return ""
    words = query_words(query) if query else []
    most, before, after = most if most > 0 else 3, min(before if before > 0 else 60, 40), min(after if after > 0 else 100, 60)
    low = _lower(text)
    found = []
    for w in words:
        a = low.find(w)
        while a >= 0:
            if _bounded(low, a, a + len(w)):
                found.append((a, a + len(w)))
            a = low.find(w, a + 1)
    if not found:
        return py_ellipsis(text, NO_MATCH)
    found.sort()
    clusters = [list(found[0])]
    for a, b in found[1:]:
        if a <= clusters[-1][1] + CLUSTER_GAP:
            clusters[-1][1] = max(clusters[-1][1], b)
        else:
            clusters.append([a, b])
    ranges = _apart([[max(0, a - before), min(len(text), b + after)] for a, b in clusters])
    if len(ranges) > most:
        ranges = _apart([ranges[0], *ranges[len(ranges) - (most - 1) :]])
    return " ... ".join(highlight(text[a:b], words) for a, b in ranges)


def _apart(ranges: list[list[int]]) -> list[list[int]]:
    """Shorten each range so that it ends before the next begins."""
    for this, following in zip(ranges, ranges[1:]):
        if this[1] > following[0] - RANGE_GAP:
            this[1] = max(following[0] - RANGE_GAP, this[0] + 1)
    return ranges


def highlight(text: str, words: list[str]) -> str:
    """Bracket the words. Of each word only its next occurrence is looked at: one inside a longer word hides later ones."""
    low, out, at = _lower(text), [], 0
    while at < len(text):
        hits = [(a, k, len(w)) for k, w in enumerate(words) if (a := low.find(w, at)) >= 0 and _bounded(low, a, a + len(w))]
        if not hits:
            break
        a, _, n = min(hits)
        out += [text[at:a], "【", text[a : a + n], "】"]
        at = a + n
    return "".join(out) + text[at:]


def snippet_column(fields: list[tuple[str, Column]], query: str) -> Column:
    """The snippets of several fields, each with its name; for use after a limit."""

    @F.pandas_udf("string")
    def one(text: pd.Series) -> pd.Series:
        return text.map(lambda t: snippets(t or "", query, 2, 40, 60))

    parts = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{name}] "), one(F.coalesce(c, F.lit(""))))) for name, c in fields]
    return F.concat_ws(" ... ", *parts) if parts else F.lit("")
