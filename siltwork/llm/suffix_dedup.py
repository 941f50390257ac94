"""Maximal repeats across a corpus: the interval tree of an enhanced suffix array, distributed.

A repeat is a run of at least ``least`` words that occurs twice or more. It is maximal if its occurrences differ in the
word before (left-diverse) and in the word after. Each maximal repeat is reported with all of its occurrences. Words are
compared in lower case, without punctuation.

Suffixes that share a repeat of ``least`` words share their first ``least`` words, so the suffix array falls apart into
independent groups of equal prefixes:

1. Winnowing picks, in each window of ``least - GRAM + 1`` grams of ``GRAM`` words, the gram with the least hash. Two
   equal runs of ``least`` words pick a common gram, so a text can repeat only around grams that are picked twice in the
   corpus. Those regions are cut out; everything else is done with. Exact copies of a text are carried as one.
2. A group of equal prefixes has one gram, and no more suffixes than that gram has picks. The suffixes of grams that at
   most ``heavy`` texts pick (``MANY`` times as often) are sent, by the hash of their first ``least`` words, to where all
   suffixes with this prefix meet.
   A group whose suffixes all have the same word before it can't hold a left-diverse interval and goes.
3. The other groups are sent, by the least document in them, to where their regions' words are at hand; a document with
   more than ``per_task`` words of regions to compare with is divided by the place of the prefix in it. There the suffixes
   are sorted by prefix doubling, the common prefixes of neighbours are found, and one scan with a stack walks the
   common-prefix interval tree, each interval with what precedes its suffixes.
4. A heavier group never meets in a task. Its diversity is an aggregate. Where it is diverse, its part of the tree is
   found by aggregates, too: every suffix is compared with the least one, ``STRIDE`` words at a time; the least suffix's
   path has a node wherever others leave it, and those that leave at the same place with the same word are a group
   again. Groups that are light by then go to step 3, heavy ones come again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, gram_hashes, mix, normal, powers, word_hashes

LEAST, GRAM, PER_TASK, HEAVY, BATCH = 50, 16, 400_000, 20_000, 100_000
STRIDE, COPIES, MANY = 256, 10_000, 50
START, DIVERSE = 0, -1  # what precedes a suffix: nothing, or several words; else the word's hash


def window_picks(words: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(the gram that winnowing picks in the window of ``least`` words from each place, the hashes of all grams)."""
    h = gram_hashes(words, gram)
    window = least - gram + 1
    if len(h) < window:
        return np.empty(0, np.int64), h
    # The places of window minima, by doubling: best[i] is the place of the leftmost least hash in h[i : i + size].
    best, size = np.arange(len(h)), 1
    while size < window:
        step = min(size, window - size)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(h[b] < h[a], b, a)
        size += step
    return best, h


def picked(words: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that winnowing picks: the leftmost least of each window."""
    best, h = window_picks(words, least, gram)
    at = np.unique(best)
    return at, h[at]


def regions(places: np.ndarray, n_words: int, least: int, gram: int) -> list[tuple[int, int]]:
    """The runs of words that can hold a repeat around the given grams."""
    reach = least - gram
    out: list[list[int]] = []
    for p in places.tolist():
        a, b = max(0, p - reach), min(n_words, p + gram + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= least]


def _pick(least: int, gram: int):
    def run(batches):
        for b in batches:
            n, lists = [], []
            for t in b.column(3).to_pylist():
                w = word_hashes(t)[0]
                n.append(len(w))
                lists.append(picked(w, least, gram)[1].view(np.int64))
            flat = pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "h1", "h2", "n", "grams"])

    return run


def _cut_out(least: int, gram: int):
    """(id, text, repeated grams, heavy grams) to the regions: their words' text, the hash of the word before each, and the
    places in it where a repeat can begin, apart for light and for heavy grams."""

    def run(batches):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary())
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for i, text, grams, hot in zip(*(b.column(k).to_pylist() for k in range(4))):
                low = normal(text)
                w, starts, ends = word_hashes(low)
                best, h = window_picks(w, least, gram)
                h = h.view(np.int64)
                at = np.unique(best)
                places = at[np.isin(h[at], np.array(grams, np.int64))]
                again = np.zeros(len(h), np.int8)
                again[places] = 1
                if hot:
                    again[at[np.isin(h[at], np.array(hot, np.int64))]] = 2
                begins = again[best]
                for x, y in regions(places, len(w), least, gram):
                    mine = begins[x : y - least + 1]
                    light, heavy = (np.flatnonzero(mine == k).astype(np.int32).tobytes() for k in (1, 2))
                    if light or heavy:
                        for c, v in zip(out, (i, x, y - x, int(w[x - 1].view(np.int64)) if x else START, low[starts[x] : ends[y - 1]].decode("utf-8"), light, heavy)):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["id", "start", "n", "before", "text", "light", "heavy"])

    return run


def _prefixes(w: np.ndarray, off: np.ndarray, before: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the first ``least`` words of the suffixes at ``off``, and of the words before them."""
    left = np.where(off > 0, w[np.maximum(off - 1, 0)].view(np.int64), before)
    return gram_hashes(w, least)[off], left


def _suffixes(least: int, parts: int):
    """Each light suffix of a region, packed in one row for each batch and part: prefix hash, word before, region, offset."""
    names = ["part", "fp", "before", "id", "start", "n", "off"]

    def run(batches):
        for b in batches:
            fps, befores, row, offs = [], [], [], []
            ids, starts, sizes = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
            for k, (before, text, light) in enumerate(zip(*(b.column(c).to_pylist() for c in (3, 4, 5)))):
                off = np.frombuffer(light, np.int32)
                g, left = _prefixes(word_hashes(text)[0], off, before, least)
                fps.append(g)
                befores.append(left)
                row.append(np.full(len(g), k, np.int32))
                offs.append(off)
            if not fps:
                continue
            fp, left, row, off = map(np.concatenate, (fps, befores, row, offs))
            part = ((fp >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            there, edges = np.unique(part[order], return_index=True)
            out: list[list] = [[] for _ in names]
            for p, lo, hi in zip(there.tolist(), edges, np.append(edges[1:], len(order))):
                o = order[lo:hi]
                for c, v in zip(out, (p, fp[o].tobytes(), left[o].tobytes(), ids[row[o]].tobytes(), starts[row[o]].astype(np.int32).tobytes(), sizes[row[o]].astype(np.int32).tobytes(), off[o].tobytes())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], names)

    return run


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


_GROUPS = "least bigint, id bigint, start int, n int, node binary, off binary, lpos binary"


def _runs(keys: list[np.ndarray], columns: list[tuple[str, np.ndarray]], packed: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    """One row for each run of equal keys of sorted rows: the first of ``columns``, all of ``packed`` as bytes."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    edge = np.flatnonzero(new)
    ends = np.append(edge[1:], len(new))
    return pa.RecordBatch.from_arrays([*(pa.array(c[edge]) for _, c in columns), *(pa.array([c[a:b].tobytes() for a, b in zip(edge, ends)], pa.binary()) for _, c in packed)], [n for n, _ in columns] + [n for n, _ in packed])


def _diverse(table: pa.Table) -> pa.Table:
    """Keep the groups of equal prefixes whose suffixes don't all follow the same word; name their least document and the place in it."""
    fp, left, ids, start, n, off = (_joined(table, n, k) for n, k in (("fp", np.uint64), ("before", np.int64), ("id", np.int64), ("start", np.int32), ("n", np.int32), ("off", np.int32)))
    order = np.lexsort((start + off, ids, fp))
    fp, left, ids, start, n, off = (c[order] for c in (fp, left, ids, start, n, off))
    first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
    size = np.diff(np.append(first, len(fp)))
    lo, hi = np.minimum.reduceat(left, first), np.maximum.reduceat(left, first)
    # Where a text begins differs from every other place, and its copies begin there as well: they are told apart later.
    good = ((size > 1) & (lo != hi)) | (np.add.reduceat((start == 0) & (off == 0), first) > 0)
    keep = np.repeat(good, size)
    least, lpos = (np.repeat(c[first], size)[keep] for c in (ids, start + off))
    fp, ids, start, n, off = (c[keep] for c in (fp, ids, start, n, off))
    order = np.lexsort((off, start, ids, least))
    fp, ids, start, n, off, least, lpos = (c[order] for c in (fp, ids, start, n, off, least, lpos))
    return pa.Table.from_batches([_runs([least, ids, start], [("least", least), ("id", ids), ("start", start), ("n", n)], [("node", fp.view(np.int64)), ("off", off), ("lpos", lpos.astype(np.int32))])])


def _weights(batches):
    """(least document, place in it, words): a region's words shared among the prefixes that it has."""
    for b in batches:
        least, n = b.column("least").to_numpy(), b.column("n").to_numpy()
        lpos = [np.frombuffer(x, np.int32) for x in b.column("lpos").to_pylist()]
        size = np.array([len(x) for x in lpos], int)
        if not size.sum():
            continue
        key = np.stack([np.repeat(least, size), np.concatenate(lpos).astype(np.int64)])
        key, inv = np.unique(key, axis=1, return_inverse=True)
        words = np.bincount(inv.ravel(), np.repeat(n / np.maximum(size, 1), size))
        yield pa.RecordBatch.from_arrays([pa.array(key[0]), pa.array(key[1]), pa.array(words)], ["least", "lpos", "words"])


def _divide(batches):
    """Divide a region's suffixes among the parts of its least document; ``cuts`` are the first places of parts after the first."""
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in b.schema.names}
        out: list[list] = [[], [], [], [], [], []]
        for least, i, start, node, off, lpos, cuts in zip(*(cols[c] for c in ("least", "id", "start", "node", "off", "lpos", "cuts"))):
            part = np.searchsorted(np.array(cuts or [], np.int64), np.frombuffer(lpos, np.int32), side="right")
            node, off = np.frombuffer(node, np.int64), np.frombuffer(off, np.int32)
            for p in np.unique(part).tolist():
                for c, v in zip(out, (least, p, i, start, node[part == p].tobytes(), off[part == p].tobytes())):
                    c.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["least", "piece", "id", "start", "node", "off"])


def ranks(names: np.ndarray) -> np.ndarray:
    """The ranks of the suffixes of ``names``, by prefix doubling.

    Each text in ``names`` ends with a name that occurs nowhere else, so no run that still has an equal crosses an end.
    """
    order = np.argsort(names, kind="stable")
    s = names[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(len(names), np.int32)
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    alone = first & np.append(first[1:], True)
    active = order[~alone]
    step = 1
    while len(active):
        key = rank[active].astype(np.int64) * (len(names) + 1) + rank[active + step]
        o = np.argsort(key, kind="stable")
        active, key = active[o], key[o]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        old = rank[active]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        at = np.arange(len(active))
        rank[active] = old + (np.maximum.accumulate(np.where(first, at, 0)) - np.maximum.accumulate(np.where(group, at, 0)))
        active = active[~(first & np.append(first[1:], True))]
        step *= 2
    return rank


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The lengths of the longest common prefixes of the suffixes at a and b, by bisection on hashes of runs; none is above ``most``."""
    up, down = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    length = np.zeros(len(a), np.int64)
    for k in range(most.bit_length() - 1, -1, -1):
        x, y = a + length, b + length
        size = np.where(np.maximum(x, y) + (1 << k) <= len(words), 1 << k, 0)
        same = (sums[x + size] - sums[x]) * down[x] == (sums[y + size] - sums[y]) * down[y]
        length += np.where(same, size, 0)
    return length


def intervals(lcp: list[int], before: list[int], docs: list[int], starts: list[int], least: int, name: Callable[[int, int], int]) -> Iterator[tuple[int, int, list[int], list[tuple[int, int]], set[int]]]:
    """(name, length, leaves, longer, documents) of the left-diverse intervals of sorted suffixes, by a stack scan.

    ``lcp[i]`` is the common prefix of suffixes i-1 and i; below ``least`` it parts groups. ``before`` is the word before each
    suffix, DIVERSE for a suffix that stands for copies with different words before; START differs from everything.
    ``leaves`` are the interval's suffixes that are in no longer one, ``longer`` the (name, least suffix) of those directly
    within it, so that all that is given is in proportion to the suffixes. Of two lists or sets the fewer go into the more.
    ``documents`` holds until the next interval is asked for.
    """
    stack: list[list] = []  # [length, first, before, leaves, longer, documents, least suffix]
    for i in range(1, len(before) + 1):
        n = lcp[i] if i < len(before) else 0
        first, left = i - 1, before[i - 1]
        if n < least and not stack:
            continue
        held = [[first], [], {docs[first]}, first]
        while stack and stack[-1][0] > n:
            length, first, was, *more = stack.pop()
            left = was if was == left and was != START else DIVERSE
            held = _together(more, held, docs, starts)
            if left == DIVERSE:
                called = name(first, length)
                yield called, length, held[0], held[1], held[2]
                held = [[], [(called, held[3])], held[2], held[3]]
        if n >= least:
            if stack and stack[-1][0] == n:
                top = stack[-1]
                top[2] = top[2] if top[2] == left and left != START else DIVERSE
                top[3:] = _together(top[3:], held, docs, starts)
            else:
                stack.append([n, first, left, *held])


def _together(a: list, b: list, docs: list[int], starts: list[int]) -> list:
    out = []
    for x, y in zip(a[:3], b[:3]):
        if len(x) < len(y):
            x, y = y, x
        (x.update if isinstance(x, set) else x.extend)(y)
        out.append(x)
    return [*out, min(a[3], b[3], key=lambda i: (docs[i], starts[i]))]


_FOUND = "repeat_id bigint, n_words int, n_occurrences bigint, n_documents bigint, rep bigint, copies bigint, word_start int, longer_id bigint"


def _scan(least: int):
    """The maximal repeats of one part: its regions' words, the offered suffixes, and how many copies each document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, starts, befores, copies = (table.column(c).to_numpy() for c in ("id", "start", "before", "copies"))
        words = [word_hashes(t)[0] for t in table.column("text").to_pylist()]
        offered = table.column("offered").to_pylist()
        del table
        size = np.array([len(w) + 1 for w in words])
        at = np.cumsum(size) - size
        # The end of each region is a name of its own.
        all_words = mix(np.arange(size.sum(), dtype=np.uint64) + np.uint64(1 << 62))
        for a, w in zip(at.tolist(), words):
            all_words[a : a + len(w)] = w
        del words
        off = [np.frombuffer(b"".join(x["off"] for x in several), np.int32) for several in offered]
        node = np.frombuffer(b"".join(x["node"] for several in offered for x in several), np.int64)
        row = np.repeat(np.arange(len(off)), [len(x) for x in off])
        off = np.concatenate(off).astype(np.int64)
        # All that matters of the suffixes' order is that equal beginnings are neighbours; words are ordered by their hashes.
        _, names = np.unique(all_words, return_inverse=True)
        rank = ranks(names.astype(np.int64))
        place_of = at[row] + off
        order = np.argsort(rank[place_of], kind="stable")
        del rank, names, offered
        row, off, place_of, node = row[order], off[order], place_of[order], node[order]
        lcp = np.zeros(len(row), np.int64)
        lcp[1:] = np.where(node[1:] == node[:-1], common_prefix(all_words, place_of[:-1], place_of[1:], int(size.max())), 0)
        start_of = starts[row].astype(np.int64) + off
        left = np.where(off > 0, all_words[np.maximum(place_of - 1, 0)].view(np.int64), befores[row])
        left = np.where(start_of == 0, np.where(copies[row] > 1, DIVERSE, START), left)
        rep = ids[row]
        hashed = mix(all_words)
        weight, count = copies[row].tolist(), dict(zip(ids.tolist(), copies.tolist()))
        places, reps, at_start = place_of.tolist(), rep.tolist(), start_of.tolist()
        total: dict[int, int] = {}  # occurrences of the intervals so far that aren't inside of another yet

        def name(i: int, length: int) -> int:
            return int(gram_hashes(hashed[places[i] : places[i] + length], length)[0].view(np.int64))

        out: list[list] = [[] for _ in range(8)]
        for called, length, leaves, longer, documents in intervals(lcp.tolist(), left.tolist(), reps, at_start, least, name):
            total[called] = n = sum(weight[i] for i in leaves) + sum(total.pop(x) for x, _ in longer)
            d = sum(count[x] for x in documents)
            for i, inner in [*((i, None) for i in leaves), *((i, x) for x, i in longer)]:
                for c, v in zip(out, (called, length, n, d, reps[i], weight[i], at_start[i], inner)):
                    c.append(v)
            if len(out[0]) > BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _FOUND_KINDS)], _FOUND_NAMES)
                out = [[] for _ in range(8)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _FOUND_KINDS)], _FOUND_NAMES)

    return run


_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
_FOUND_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())


# ---- heavy groups: the same tree by aggregates ----


def _heavy_suffixes(least: int):
    def run(batches):
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, start, before, text, heavy in zip(*(b.column(c).to_pylist() for c in ("id", "start", "before", "text", "heavy"))):
                off = np.frombuffer(heavy, np.int32)
                fp, left = _prefixes(word_hashes(text)[0], off, before, least)
                for c, v in zip(out, (fp.view(np.int64), left, np.full(len(off), i, np.int64), np.full(len(off), start, np.int32), off)):
                    c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["node", "before", "id", "start", "off"])

    return run


def _next_words(stride: int):
    """The hashes of the next ``stride`` words of each suffix; fewer at a region's end."""

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for i, start, text, held in zip(*(b.column(c).to_pylist() for c in ("id", "start", "text", "held"))):
                w = word_hashes(text)[0]
                for s in held:
                    a = s["off"] + s["depth"]
                    for c, v in zip(out, (s["node"], s["depth"], s["before"], i, start, s["off"], w[a : a + stride].tobytes())):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [*_SUFFIX_NAMES, "next"])

    return run


def _names(batches):
    """The hashes of the words of nodes, by which their repeats are named: (node, text, off, ends) to (node, length, repeat_id)."""
    for b in batches:
        out: list[list] = [[], [], []]
        for node, text, off, ends in zip(*(b.column(c).to_pylist() for c in ("node", "text", "off", "ends"))):
            w = mix(word_hashes(text)[0][off : off + max(ends)])
            for n in ends:
                for c, v in zip(out, (node, n, int(gram_hashes(w[:n], n)[0].view(np.int64)))):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], ["node", "length", "repeat_id"])


def _agreement(batches):
    """How many of its next words a suffix shares with the least suffix of its node."""
    for b in batches:
        got = []
        for x, y in zip(b.column("next").to_pylist(), b.column("model").to_pylist()):
            n = min(len(x), len(y)) // 8
            differ = np.flatnonzero(np.frombuffer(x, np.int64, n) != np.frombuffer(y, np.int64, n))
            got.append(int(differ[0]) if len(differ) else n)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*_SUFFIX_NAMES, "next")), pa.array(got, pa.int32())], [*_SUFFIX_NAMES, "next", "same"])


def _children(batches):
    """The child that each suffix goes on to: the node's name mixed with the place and the word where it leaves the path; none where
    the region ends."""
    for b in batches:
        keep, kids, depth = [], [], []
        for i, (v, d, k, x) in enumerate(zip(*(b.column(c).to_pylist() for c in ("node", "depth", "same", "next")))):
            if len(x) > 8 * k:
                keep.append(i)
                kids.append(mix(mix(np.array([v], np.int64).view(np.uint64) + np.uint64(k)) ^ mix(np.frombuffer(x, np.uint64, 1, 8 * k)))[0])
                depth.append(d + k + 1)
        take = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.array(kids, np.uint64).view(np.int64)), pa.array(depth, pa.int32()), *(b.column(c).take(take) for c in _SUFFIX_NAMES[2:])], _SUFFIX_NAMES)


def _offer(batches):
    """Single suffixes as groups to scan, one for each node."""
    for b in batches:
        packed = [pa.array([x.tobytes() for x in b.column(c).to_numpy()], pa.binary()) for c in ("node", "off")]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(np.zeros(b.num_rows, np.int32)), b.column("id"), b.column("start"), *packed], _OFFERED_NAMES)


_SUFFIX = "node bigint, depth int, before bigint, id bigint, start int, off int"
_SUFFIX_NAMES = [c.split()[0] for c in _SUFFIX.split(", ")]
_OFFERED = "least bigint, piece int, id bigint, start int, node binary, off binary"
_OFFERED_NAMES = [c.split()[0] for c in _OFFERED.split(", ")]


def _heavy(table: DataFrame, texts: DataFrame, least: int, heavy: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(light suffixes, occurrences of the nodes that were found) of the groups with heavy grams; no group is collected."""
    light, found = [], []
    rows = table.where("length(heavy) > 0").mapInArrow(_heavy_suffixes(least), "node bigint, before bigint, id bigint, start int, off int")
    rows = cut(rows.select("node", F.lit(least).alias("depth"), "before", "id", "start", "off"), "heavy-suffixes")
    while not rows.isEmpty():
        begins = F.col("start") + F.col("off") == 0
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("before").alias("lo"), F.max("before").alias("hi"), F.max(begins).alias("begins"))
        rows = cut(rows.join(nodes.where("begins OR (n > 1 AND lo <> hi)").select("node", "n"), "node"), "heavy-diverse")
        light.append(rows.where(F.col("n") <= heavy).drop("n"))
        rows = rows.where(F.col("n") > heavy)
        if rows.isEmpty():
            break
        held = rows.groupBy("id", "start").agg(F.collect_list(F.struct("node", "depth", "before", "off")).alias("held"))
        words = cut(held.join(table.select("id", "start", "text"), ["id", "start"]).mapInArrow(_next_words(STRIDE), f"{_SUFFIX}, next binary"), "heavy-words")
        order = F.struct("id", "start", "off")
        order = F.struct("id", "start", "off")
        model = words.groupBy("node").agg(F.min_by("next", order).alias("model"), F.min(order).alias("first"))
        same = cut(words.join(model.select("node", "model"), "node").mapInArrow(_agreement, f"{_SUFFIX}, next binary, same int").join(texts.select("id", "copies"), "id"), "heavy-same")
        # The path of the least suffix ends a node wherever some suffix leaves it; the node's suffixes are those that go at least as far.
        onto = Window.partitionBy("node").orderBy(F.desc("same"))
        leaves = same.groupBy("node", "depth", "same").agg(F.count("*").alias("n"), F.sum("copies").alias("c"), F.min("before").alias("lo"), F.max("before").alias("hi"), F.sum(F.when(begins, F.col("copies")).otherwise(0)).alias("b"))
        farthest = same.groupBy("node", "id", "copies").agg(F.max("same").alias("same")).groupBy("node", "same").agg(F.sum("copies").alias("d"))
        path = leaves.join(farthest, ["node", "same"], "left").select("node", "depth", "same", F.sum("n").over(onto).alias("n"), F.sum("c").over(onto).alias("n_occurrences"), F.sum("d").over(onto).alias("n_documents"), F.min("lo").over(onto).alias("lo"), F.max("hi").over(onto).alias("hi"), F.sum("b").over(onto).alias("b"))
        # A node is left-diverse if its suffixes follow different words, or if texts begin with it.
        ends = path.where((F.col("same") < STRIDE) & (F.col("n") > 1) & ((F.col("lo") != F.col("hi")) | (F.col("b") > 1)))
        ends = cut(ends.select("node", F.col("same").alias("end"), (F.col("depth") + F.col("same")).alias("length"), "n_occurrences", "n_documents"), "heavy-nodes")
        first = ends.groupBy("node").agg(F.collect_list("length").alias("ends")).join(model.select("node", "first.*"), "node").join(table.select("id", "start", "text"), ["id", "start"])
        named = ends.join(first.select("node", "text", "off", "ends").mapInArrow(_names, "node bigint, length int, repeat_id bigint"), ["node", "length"])
        # A suffix is listed with the last of the path's repeats that it has, the least one also with those before, for the longer.
        known = F.struct("end", "repeat_id", "length", "n_occurrences", "n_documents")
        along = cut(named.groupBy("node").agg(F.sort_array(F.collect_list(known)).alias("ends")), "heavy-paths")
        last = F.expr("try_element_at(filter(ends, e -> e.end <= same), -1)")
        rows_of = lambda df, e: df.select(f"{e}.repeat_id", F.col(f"{e}.length").alias("n_words"), f"{e}.n_occurrences", f"{e}.n_documents", F.col("id").alias("rep"), "copies", (F.col("start") + F.col("off")).alias("word_start"), "longer_id")
        listed = rows_of(same.join(along, "node").withColumn("e", last).where("e IS NOT NULL").withColumn("longer_id", F.lit(None).cast("bigint")), "e")
        steps = along.join(model.select("node", "first.*"), "node").join(texts.select("id", "copies"), "id").select("id", "start", "off", "copies", F.explode(F.expr("transform(slice(ends, 1, size(ends) - 1), (e, i) -> struct(e AS e, ends[i + 1].repeat_id AS longer_id))")).alias("s"))
        found.append(cut(listed.unionByName(rows_of(steps.select("*", "s.e", "s.longer_id"), "e")), "heavy-found"))
        onward = same.where(F.col("same") == STRIDE).select("node", (F.col("depth") + STRIDE).alias("depth"), "before", "id", "start", "off")
        split = same.where(F.col("same") < STRIDE).select(*_SUFFIX_NAMES, "next", "same").mapInArrow(_children, _SUFFIX)
        rows = cut(onward.unionByName(split), "heavy-suffixes")
    return light, found


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, per_task: int = PER_TASK, heavy: int = HEAVY) -> DataFrame:
    """``repeat_id, n_words, n_occurrences, n_documents, doc_id, word_start, longer_id`` of the maximal repeats of ``least`` words or more.

    The rows are those of the interval tree: one for each repeat and occurrence (``doc_id``, ``word_start``) that is in no longer
    repeat, and one for each longer repeat directly within it, ``longer_id``, with that one's least occurrence. So the
    occurrences of a repeat are those of its rows and of the repeats they name as longer; every repeat has two rows or
    more, and all together are in proportion to the text, not to the pairs of documents. (A group that is heavy may list
    an occurrence of a longer repeat once more.) Texts that are equal as wholes are listed where the whole text repeats;
    in repeats of a part of them the least id stands for all. ``n_occurrences`` and ``n_documents`` count every copy, and are
    the repeat's, over all its rows.
    ``repeat_id`` is a hash of the repeat's words; it doesn't depend on partitioning. Ids are integers, or are cast to
    such. Texts shorter than ``least`` words, null and empty texts hold none. Rows that share an id are one document: the
    row whose text has the least hash. Null ids are left out. Empty in, empty out.

    ``per_task`` (words) and ``heavy`` (suffixes of one prefix) only say how work is divided: they don't change the result.
    """
    gram = min(gram, least)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("id", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), "text")
    grams = cut(rows.mapInArrow(_pick(least, gram), "id bigint, h1 bigint, h2 int, n bigint, grams array<bigint>").where(F.col("n") >= least), "picked")
    repeated = not grams.groupBy("id").count().where("count > 1").isEmpty()
    if repeated:
        nth = F.row_number().over(Window.partitionBy("id").orderBy("h1", "h2"))
        grams = cut(grams.withColumn("__n", nth).where("__n = 1").drop("__n"), "picked-one")
    texts = cut(grams.groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "h1", "h2", F.col("n").alias("total"), "copies"), "texts")
    held = grams.join(texts.select("id"), "id", "left_semi").select("id", F.explode("grams").alias("g"))
    again = held.groupBy("g", "id").count().groupBy("g").agg(F.count("*").alias("docs"), F.sum("count").alias("n")).where("n > 1")
    again = again.select("g", ((F.col("docs") > heavy) | (F.col("n") > MANY * heavy)).alias("hot"))
    wanted = held.join(again, "g").groupBy("id").agg(F.collect_set("g").alias("grams"), F.collect_set(F.when(F.col("hot"), F.col("g"))).alias("hot"))
    wanted = cut(wanted.join(texts.select("id", "h1"), "id"), "wanted")
    cutouts = rows.join(wanted.hint("shuffle_hash"), ["id", "h1"]).select("id", "text", "grams", "hot").mapInArrow(_cut_out(least, gram), "id bigint, start int, n int, before bigint, text string, light binary, heavy binary")
    table = cut(cutouts.dropDuplicates(["id", "start"]) if repeated else cutouts, "regions")

    # Light groups: by prefix to where they meet, then by the least document (divided, if it is hot) to where they are scanned.
    total = table.agg(F.coalesce(F.sum(F.length("light") / 4), F.lit(0))).first()[0]
    packed = table.where("length(light) > 0").mapInArrow(_suffixes(least, max(1, math.ceil(total / per_task))), "part bigint, fp binary, before binary, id binary, start binary, n binary, off binary")
    groups = cut(packed.groupBy("part").applyInArrow(_diverse, _GROUPS), "groups")
    hot = groups.groupBy("least").agg(F.sum("n").alias("words")).where(F.col("words") > per_task).select("least")
    weights = groups.join(hot, "least", "left_semi").mapInArrow(_weights, "least bigint, lpos bigint, words double").groupBy("least", "lpos").agg(F.sum("words").alias("words"))
    so_far = F.sum("words").over(Window.partitionBy("least").orderBy("lpos")) - F.col("words")
    pieces = weights.select("least", "lpos", F.floor(so_far / per_task).alias("piece")).groupBy("least", "piece").agg(F.min("lpos").alias("lpos")).where("piece > 0")
    cuts = pieces.groupBy("least").agg(F.sort_array(F.collect_list("lpos")).alias("cuts"))
    offered = groups.join(cuts, "least", "left").select("least", "id", "start", "node", "off", "lpos", "cuts").mapInArrow(_divide, _OFFERED)
    light, found = _heavy(table, texts, least, heavy)
    for more in light:
        offered = offered.unionByName(more.mapInArrow(_offer, _OFFERED))
    parts = max(1, math.ceil((groups.agg(F.sum("n")).first()[0] or 0) / per_task))
    sent = offered.withColumn("to", F.pmod(F.xxhash64("least", "piece"), F.lit(parts))).groupBy("to", "id", "start").agg(F.collect_list(F.struct("node", "off")).alias("offered"))
    full = sent.join(table.select("id", "start", "before", "text"), ["id", "start"]).join(texts.select("id", "copies"), "id")
    scanned = full.select("to", "id", "start", "before", "text", "offered", "copies").groupBy("to").applyInArrow(_scan(least), _FOUND)
    for more in found:
        scanned = scanned.unionByName(more)
    scanned = cut(scanned, "repeats")

    # A text with copies repeats as a whole, with those that hold it, if there are such. That is where its copies are listed.
    several = texts.where("copies > 1").select("id", "h1", "h2", "total", "copies")
    long = F.col("n_words") == F.col("total")
    marked = scanned.where("copies > 1 AND word_start = 0").join(several.select(F.col("id").alias("rep"), "total"), "rep").where(long).drop("total")
    marked = cut(marked, "whole-texts")
    alone = several.join(marked.select(F.col("rep").alias("id")), "id", "left_anti")
    alone = alone.select(F.col("h1").alias("repeat_id"), F.col("total").cast("int").alias("n_words"), F.col("copies").alias("n_occurrences"), F.col("copies").alias("n_documents"), F.col("id").alias("rep"), "copies", F.lit(0).alias("word_start"), F.lit(None).cast("bigint").alias("longer_id"))
    # Many copies are joined in slices, so that no text's are in one place.
    slices = F.ceil(F.col("copies") / COPIES)
    members = grams.join(several.select("h1", "h2", F.col("total").alias("n"), F.col("id").alias("rep"), "copies"), ["h1", "h2", "n"]).select("rep", F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), slices).alias("slice"))
    whole = marked.unionByName(alone).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1))).join(members.where("doc_id <> rep"), ["rep", "slice"])
    columns = ["repeat_id", "n_words", "n_occurrences", "n_documents", "doc_id", "word_start", "longer_id"]
    out = scanned.unionByName(alone).withColumnRenamed("rep", "doc_id").select(columns)
    return out.unionByName(whole.select(columns))
