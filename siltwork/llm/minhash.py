"""Near duplicates: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. Every document becomes a set of hashed word shingles and a signature of ``HASHES`` minima.
2. Documents with the same shingle set (count and two 64-bit set hashes) are joined to the least of them.
3. Signatures are cut into bands; documents that agree in a band share a bucket.
4. Candidate pairs are compared batch by batch. After n of the hashes with m agreements, the similarity has the
   posterior Beta(m+1, n-m+1); a pair is pruned once P(similarity >= threshold) falls below ``miss``.
5. Survivors are verified by the exact Jaccard similarity of their shingle sets.
6. Verified pairs are joined into groups; the least id of a group is kept.

Buckets aren't capped, and none is collected. Each member is first compared with the least member of its buckets. In
buckets whose members aren't in one group by then, two members are compared if they are in different groups, could be as
similar as the threshold by their sizes, and share a shingle among the rarest of each, as many as two such sets can't
all differ in (the prefix filter of set similarity joins, by how many of these documents have a shingle). None of these
conditions loses a pair that reaches the threshold or changes the groups. Documents of a bucket that have little in
common but what all of them share are told apart by their rarest shingles, without comparing each with each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, gram_hashes, mix, sign_classes, word_hashes

SHINGLE, HASHES, BANDS, BATCH = 3, 128, 32, 32
THRESHOLD, MISS = 0.6, 1e-3

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_SALT = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; a text with fewer words is one shingle; no word, none."""
    words = word_hashes(text)[0]
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(size, len(words))))


def signature(grams: np.ndarray) -> np.ndarray:
    x = (grams >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048]
        np.minimum(best, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1), out=best)
    return best


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def least_matches(threshold: float, miss: float, batch: int = BATCH, hashes: int = HASHES) -> dict[int, int]:
    """For n compared hashes, the fewest agreements m with P(similarity >= threshold | m of n) >= miss.

    With a uniform prior that probability is P(Binomial(n + 1, threshold) <= m).
    """
    out = {}
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, -1
        while total < miss and m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def survives(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which rows of the signature matrices ``a`` and ``b`` pass every batch; a pruned row isn't compared further."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    at = 0
    for n, m in sorted(least.items()):
        matches[alive] += (a[alive, at:n] == b[alive, at:n]).sum(axis=1)
        alive = alive[matches[alive] >= m]
        at = n
    return alive


def _signatures(batches):
    for batch in batches:
        n = batch.num_rows
        counts = np.zeros(n, np.int64)
        s1, s2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        sigs, bands = [], np.zeros((n, BANDS), np.int64)
        for i, text in enumerate(batch.column(2).to_pylist()):
            grams = shingles(text)
            counts[i] = len(grams)
            if not len(grams):
                sigs.append(b"")
                continue
            sig = signature(grams)
            h = sig.reshape(BANDS, -1).astype(np.uint64)
            key = _SALT.copy()
            for k in range(h.shape[1]):
                key = mix(key ^ h[:, k]) + np.uint64(k)
            bands[i] = key.view(np.int64)
            sigs.append(sig.astype(np.uint16).tobytes())
            s1[i] = np.add.reduce(grams).view(np.int64)
            s2[i] = np.bitwise_xor.reduce(mix(grams + np.uint64(0x632BE59BD9B4E019))).view(np.int64)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(s1), pa.array(s2), pa.array(sigs, pa.binary()), flat], ["id", "th", "n", "s1", "s2", "sig", "bands"])


def _pruner(least: dict[int, int]):
    def prune(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.stack([np.frombuffer(x, np.uint16) for x in batch.column(k).to_pylist()]) for k in ("sig_a", "sig_b"))
                keep = pa.array(survives(a, b, least))
                yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    return prune


def _verifier(threshold: float):
    def verify(batches):
        last: tuple[int, np.ndarray] | None = None  # pairs come joined by b: a hub's are together
        for batch in batches:
            a, b, ta, tb = (batch.column(k).to_pylist() for k in ("a", "b", "text_a", "text_b"))
            keep = []
            for i in range(len(a)):
                if last is None or last[0] != b[i]:
                    last = (b[i], shingles(tb[i]))
                if jaccard(last[1], shingles(ta[i])) >= threshold:
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    return verify


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """``doc_id, keeper_id, group_size, is_kept`` for each distinct id.

    Texts without a word (null, empty, only signs) are nobody's copy and keep themselves. A text of fewer words than a
    shingle is one shingle. Rows that share an id are one document: the row whose text has the least hash stands for
    it. Ties don't matter: groups are sets, and the least id is kept. Ids are integers, or
    are cast to such. Null ids are left out. Empty in, empty out.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id IS NOT NULL")
    rows = rows.select("id", F.xxhash64("text").alias("th"), "text")
    sigs = cut(rows.mapInArrow(_signatures, "id bigint, th bigint, n bigint, s1 bigint, s2 bigint, sig binary, bands array<bigint>"), "signatures")
    repeated = not sigs.groupBy("id").count().where("count > 1").isEmpty()
    if repeated:
        first = F.row_number().over(Window.partitionBy("id").orderBy("th"))
        sigs = cut(sigs.withColumn("__n", first).where("__n = 1").drop("__n"), "signatures-one")

    key = ["n", "s1", "s2"]
    same = cut(sigs.where("n > 0").groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("c")), "same-sets")
    twins = sigs.join(same.where("c > 1"), key).select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    reps = sigs.join(same.select(F.col("rep").alias("id")), "id", "left_semi")

    least, fits = least_matches(threshold, miss), _fits(threshold)
    placed = reps.select("id", "n", F.explode("bands").alias("bh"))
    hubs = placed.groupBy("bh").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1")
    shared = cut(placed.join(hubs.select("bh", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "bh"), "buckets")
    members = cut(shared.select("id").distinct(), "members")
    some = cut(reps.join(members, "id", "left_semi").select("id", "th", "sig"), "member-signatures")
    text = rows.join(some.select("id", "th").hint("shuffle_hash"), ["id", "th"], "left_semi").select("id", "text")
    text = cut(text.dropDuplicates(["id"]) if repeated else text, "member-texts")

    star = shared.where("id <> hub").where(fits("n", "hub_n")).groupBy(F.col("id").alias("a")).agg(F.min("hub").alias("b"))
    edges = _verified(star, some, text, least, threshold, "star")
    roots = cut(components(edges, "star"), "star-roots")
    rooted = shared.select("bh", "id", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").select("bh", "id", "n", F.coalesce("root", "id").alias("root"))
    rooted = cut(rooted, "rooted")
    mixed = rooted.groupBy("bh").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bh")
    mixed = cut(rooted.join(mixed, "bh", "left_semi"), "mixed-buckets")
    rare = _rarest(mixed.select("id").distinct(), text, threshold)
    meeting = cut(mixed.join(rare, "id"), "meetings")
    apart = meeting.groupBy("bh", "gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bh", "gram")
    meeting = cut(meeting.join(apart, ["bh", "gram"], "left_semi"), "mixed-meetings")
    x, y = (meeting.select("bh", "gram", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "root"))) for k in "xy")
    pairs = x.join(y, ["bh", "gram"]).where("root_x < root_y").where(fits("n_x", "n_y"))
    pairs = pairs.select(F.greatest("id_x", "id_y").alias("a"), F.least("id_x", "id_y").alias("b")).distinct()
    more = _verified(pairs, some, text, least, threshold, "rest")

    root = components(edges.unionByName(more).unionByName(twins), "near")
    out = sigs.select("id").join(root, sigs["id"] == root["node"], "left").select("id", F.coalesce("root", "id").alias("keeper_id"))
    sizes = out.groupBy("keeper_id").agg(F.count("*").alias("group_size"))
    return out.join(sizes, "keeper_id").select(F.col("id").alias("doc_id"), "keeper_id", "group_size", (F.col("id") == F.col("keeper_id")).alias("is_kept"))


def _fits(threshold: float):
    """Two sets of these sizes can have the threshold's similarity."""
    return lambda m, n: F.least(m, n) >= F.lit(threshold - 1e-9) * F.greatest(m, n)


def _rarest(ids: DataFrame, text: DataFrame, threshold: float) -> DataFrame:
    """(id, gram): the rarest shingles of the documents ``ids``, so many that two similar sets can't miss each other, less those that
    only one of the documents has."""

    def sets(batches):
        for batch in batches:
            got = [shingles(t).view(np.int64) for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
            flat = np.concatenate(got) if got else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "grams"])

    grams = cut(text.join(ids, "id", "left_semi").mapInArrow(sets, "id bigint, grams array<bigint>"), "rest-shingles")
    each = grams.select("id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    # Shingles of a single document come first in the order, and meet nothing: only their number counts.
    nth = F.row_number().over(Window.partitionBy("id").orderBy("df", "gram"))
    held = each.join(often, "gram").withColumn("k", nth).withColumn("more", F.count("*").over(Window.partitionBy("id")))
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    return held.where(F.col("k") + F.col("n") - F.col("more") <= prefix).select("id", "gram")


def _verified(pairs: DataFrame, sigs: DataFrame, text: DataFrame, least: dict[int, int], threshold: float, what: str) -> DataFrame:
    """The pairs (a, b) that survive the sequential comparison and have at least the threshold's exact similarity."""
    pairs = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    alive = cut(pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(_pruner(least), "a bigint, b bigint"), f"{what}-alive")
    full = alive.join(text.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(text.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return cut(full.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(threshold), "a bigint, b bigint"), f"{what}-edges")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """The rows of ``docs`` whose document is kept by :func:`near_groups`; rows with a null id go."""
    gone = cut(near_groups(docs, id_col, text_col, threshold, miss).where("NOT is_kept").select(F.col("doc_id").alias("__gone")), "near-losers")
    return docs.where(F.col(id_col).isNotNull()).join(gone.hint("shuffle_hash"), F.col(id_col) == F.col("__gone"), "left_anti")


_SQL = r"""
WITH RECURSIVE split AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{sign}', ' ', 'g'), '({letter})', ' \1 ', 'g'), '[a-z0-9_\x{{80}}-\x{{10ffff}}]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - {size} + 1) + 1), lambda i: array_to_string(w[i:i + {size} - 1], ' '))) AS g FROM split WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams AS a JOIN grams AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM common JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE c / CAST(x.n + y.n - c AS DOUBLE) >= {threshold}),
edges AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT doc_id, doc_id AS root FROM split UNION SELECT b, root FROM reach JOIN edges ON a = doc_id),
groups AS (SELECT doc_id, min(root) AS keeper_id FROM reach GROUP BY doc_id)
SELECT doc_id, keeper_id, count(*) OVER (PARTITION BY keeper_id) AS group_size, doc_id = keeper_id AS is_kept FROM groups"""


def near_sql() -> str:
    """:func:`near_groups` of ``documents`` with ids that are unique: all pairs that share a shingle, by their exact similarity.

    Banding and pruning may miss a pair close to the threshold, with the chances given in the README; SQL misses none.
    """
    sign, letter = sign_classes()
    return _SQL.format(sign=sign, letter=letter, size=SHINGLE, threshold=f"CAST({THRESHOLD} AS DOUBLE)")
