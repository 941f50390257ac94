"""Best-fit packing with swap-based local search.

Texts are counted in words and cut into pieces no longer than a bin. Pieces are put into bins by best fit in decreasing
order. Then the bins that aren't full are improved: a piece moves to another bin, two pieces are exchanged, or two
are exchanged for one, whenever the sum of the squared fills grows, until no exchange of two bins raises it. A bin that
becomes empty is gone.

Pieces are packed in shards of about ``shard_items`` by a hash of the id: a packing loses at most a few bins a shard, and
no task sees more than a shard.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, words_of

CAPACITY, SHARD_ITEMS, ROUNDS = 4096, 20_000, None


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; items come in decreasing length (ties in order), each to the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
            room -= n
        else:
            b = len(bins)
            bins.append([i])
            room = capacity - n
        by_room[room].append(b)
        rooms |= 1 << room
    return bins


class Bin:
    """Pieces by length. Bit n of ``one`` says that a piece, of ``two`` that two pieces together, have the length n.

    A bin of capacity c has less than sqrt(2 c) different lengths, so all exchanges of two bins are weighed in at most
    that many operations on words of c bits, however many pieces there are.
    """

    __slots__ = ("by_length", "fill", "one", "_two")

    def __init__(self, items: list[int], lengths: list[int]):
        self.by_length: dict[int, list[int]] = {}
        self.fill, self.one, self._two = 0, 0, None
        for i in items:
            self.put(lengths[i], i)

    def put(self, n: int, i: int) -> None:
        self.by_length.setdefault(n, []).append(i)
        self.fill += n
        self.one |= 1 << n
        self._two = None

    def take(self, n: int) -> int:
        several = self.by_length[n]
        i = several.pop()
        if not several:
            del self.by_length[n]
            self.one &= ~(1 << n)
        self.fill -= n
        self._two = None
        return i

    @property
    def two(self) -> int:
        if self._two is None:
            self._two = 0
            for n, several in self.by_length.items():
                self._two |= (self.one if len(several) > 1 else self.one & ~(1 << n)) << n
        return self._two

    def parts(self, n: int, pieces: int) -> list[int]:
        """The lengths of so many pieces that have the length n together."""
        if pieces == 1:
            return [n]
        return next([x, n - x] for x in sorted(self.by_length) if n - x in self.by_length and (2 * x != n or len(self.by_length[x]) > 1))

    def items(self) -> list[int]:
        return [i for n in sorted(self.by_length, reverse=True) for i in self.by_length[n]]


def improve(bins: list[list[int]], lengths: list[int], capacity: int, rounds: int | None = ROUNDS) -> list[list[int]]:
    """Local search on the bins that aren't full: moves, one-for-one and two-for-one exchanges that raise the sum of squared fills.

    The emptiest bin gives, the fuller bins take. Every step raises the sum, which has a bound, so the search ends, where no
    exchange of any two bins raises it any more (or after ``rounds`` passes, if given).
    """
    held = [Bin(b, lengths) for b in bins]
    done = 0
    while rounds is None or done < rounds:
        done += 1
        open_ = sorted((b for b in range(len(held)) if 0 < held[b].fill < capacity), key=lambda b: (held[b].fill, b))
        changed = False
        for at, a in enumerate(open_):
            for b in reversed(open_[at + 1 :]):
                if not held[a].fill:
                    break
                while held[a].fill and 0 < held[b].fill < capacity and _step(held[a], held[b], capacity):
                    changed = True
        if not changed:
            break
    return [b.items() for b in held if b.fill]


def _highest(bits: int, room: int) -> int:
    return (bits & ((2 << room) - 1)).bit_length() - 1


def _step(a: Bin, b: Bin, capacity: int) -> bool:
    """The best exchange that shifts length from one bin to the fuller one (of equals, to the second); False if none raises the sum."""
    if a.fill > b.fill:
        a, b = b, a
    room = capacity - b.fill
    # A shift of d > 0 from the emptier a to the fuller b raises the sum; the largest d that fits is best, of equals the simplest.
    best, how = 0, None
    d = _highest(a.one, room)  # a piece moves
    if d > best:
        best, how = d, (d, 1, 0, 0)
    for give, pieces in ((a.one, 1), (a.two, 2)):  # one for one, two for one
        if pieces == 2 and best < room and (d := _highest(give, room)) > best:  # two pieces move
            best, how = d, (d, 2, 0, 0)
        if best < room:
            for t in b.by_length:
                d = _highest(give >> t, room)
                if d > best:
                    best, how = d, (d + t, pieces, t, 1)
    if best < room:
        for g in a.by_length:  # one for two
            least = max(0, g - room)
            take = b.two >> least
            if take and best < (d := g - least - (take & -take).bit_length() + 1):
                best, how = d, (g, 1, g - d, 2)
    if how is None:
        return False
    g, give, t, take = how
    to_b = [(n, a.take(n)) for n in a.parts(g, give)]
    to_a = [(n, b.take(n)) for n in b.parts(t, take)] if take else []
    for n, i in to_b:
        b.put(n, i)
    for n, i in to_a:
        a.put(n, i)
    return True


def _pack(capacity: int, rounds: int | None):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "copy"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].tolist()
        bins = improve(best_fit(lengths, capacity), lengths, capacity, rounds)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(lengths))
        out = pdf.iloc[order]
        size = [len(b) for b in bins]
        n = out["length"].to_numpy()
        start = np.cumsum(n) - n
        first = np.repeat(start[np.cumsum(size) - size], size) if len(size) else start
        number = np.repeat(np.arange(len(bins)), size)
        return pd.DataFrame({"bin": out["shard"].to_numpy() * (1 << 32) + number, "doc_id": out["doc_id"].to_numpy(), "copy": out["copy"].to_numpy(), "piece": out["piece"].to_numpy(), "word_start": out["piece"].to_numpy() * capacity, "length": n, "bin_offset": start - first})

    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, rounds: int | None = ROUNDS) -> DataFrame:
    """``bin, doc_id, copy, piece, word_start, length, bin_offset``: where the words of every document go.

    Every word is in exactly one bin. A text longer than a bin is cut into full pieces and a rest. Rows that repeat an
    id are numbered by ``copy`` (longest first) and packed each. A text without a word (null, empty) takes no place and
    has no row. Equal lengths go by id. Ids are integers, or are cast to such. Null ids are left out. Empty in, empty out.
    """
    lengths = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("n")).where("doc_id IS NOT NULL AND n > 0")
    # Rows of one id become one row with their lengths, longest first: the number of a copy doesn't depend on the order read.
    lengths = lengths.groupBy("doc_id").agg(F.sort_array(F.collect_list("n"), asc=False).alias("ns")).select("doc_id", F.posexplode("ns").alias("copy", "n"))
    pieces = lengths.select("doc_id", F.col("copy").cast("bigint").alias("copy"), "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / capacity))).alias("piece"))
    pieces = cut(pieces.select("doc_id", "copy", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("piece") * capacity).alias("length")), "pieces")
    shards = max(1, math.ceil(pieces.count() / shard_items))
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(shards)).cast("bigint"))
    return sharded.groupBy("shard").applyInPandas(_pack(capacity, rounds), "bin bigint, doc_id bigint, copy bigint, piece bigint, word_start bigint, length bigint, bin_offset bigint")
