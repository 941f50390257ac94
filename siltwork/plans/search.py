"""Hybrid search as one plan: signals, normalisation, fusion, the first stage's top, reranking, hits."""

from __future__ import annotations

from collections import OrderedDict
from copy import deepcopy
from dataclasses import replace
from threading import Lock

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.snippet import snippet_column
from ..functions.text import py_distinct_tokens
from ..operators import scoring as S
from ..operators.index import Index, column_of
from ..schema import Field, SearchOptions

HIT = "id string, idx bigint, score double, path string, source string, tags array<string>, fields map<string,string>, snippet string, bm25 double, emb double, exact boolean, prefix boolean, strict array<string>"
SIGNALS = ("bm25", "emb", "phrase", "name", "strict")
FAST_CHARS = 2000


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def signals(index: Index, query: str, terms: list[str], searchable: list[Field], embeddable: list[Field]) -> DataFrame:
    """Every item with its raw signals. Items without a posting or vector have zeros, which count in the normalisation."""
    schema, items = index.schema, index.items
    name = schema.primary()
    name_col = F.col(column_of(schema, name.name)) if name else F.lit("")
    name_lower = F.lower(name_col)
    phrase = S.phrase_boost(terms, [F.col(column_of(schema, f.name)) for f in searchable])
    boost, types = S.strict_boost(query, [(F.col(c), w) for c, w in S.strict_fields(schema)])
    # What is asked of the texts first: only its numbers are joined.
    out = items.select(
        "idx", phrase.alias("phrase"), (S.name_match(name_lower, query, terms) if name else F.lit(0.0)).alias("name"), (S.prefix_match(name_lower, query) if name else F.lit(False)).alias("prefix"),
        boost.alias("strict"), types.alias("strict_types"),
    )
    out = out.join(S.bm25(index, terms, searchable), "idx", "left").withColumn("bm25", _zero(F.col("bm25")))
    vector = index.encoder.encode(query).tolist() if index.encoder is not None and index.vectors is not None and embeddable else None
    emb = S.dense(index, vector, embeddable) if vector is not None else None
    out = out.join(emb, "idx", "left").withColumn("emb", _zero(F.col("emb"))) if emb is not None else out.withColumn("emb", F.lit(0.0))
    out = out.withColumn("phrase", F.when(F.col("bm25") > 0, F.col("phrase")).otherwise(F.lit(0.0)))
    first = S.exact_name(items, name_col, query) if name else index.spark.createDataFrame([(None,)], "exact_idx bigint")
    return out.crossJoin(F.broadcast(first)).withColumn("exact", F.coalesce(F.col("idx") == F.col("exact_idx"), F.lit(False))).drop("exact_idx")


def stage_one(rows: DataFrame, o: SearchOptions) -> DataFrame:
    """Signals normalised over all items by a one-row aggregate, fused; the best ``rerank_top`` by score, then position."""
    ranges = rows.agg(*[f(s).alias(f"{s}_{n}") for s in SIGNALS for n, f in (("lo", F.min), ("hi", F.max))])
    both = rows.crossJoin(F.broadcast(ranges))
    n = {s: S.normalised(F.col(s), F.col(f"{s}_lo"), F.col(f"{s}_hi")) for s in SIGNALS}
    score = F.lit(o.w_bm25) * n["bm25"] + F.lit(o.w_emb) * n["emb"] + F.lit(o.w_phrase) * n["phrase"] + F.lit(0.25) * n["name"]
    score = score + F.when(n["strict"] > 0, F.lit(o.w_strict) * n["strict"]).otherwise(F.lit(0.0))
    score = score + F.when(F.col("exact"), F.lit(o.w_exact)).when(F.col("prefix"), F.lit(o.w_prefix)).otherwise(F.lit(0.0))
    return both.withColumn("stage1", score).drop(*[f"{s}_{x}" for s in SIGNALS for x in ("lo", "hi")]).orderBy(F.desc("stage1"), "idx").limit(o.rerank_top)


def reranked(index: Index, best: DataFrame, query: str, terms: list[str], embeddable: list[Field], o: SearchOptions) -> DataFrame:
    """The candidates with their final ``score``, in order, cut to ``top_k``."""
    schema = index.schema
    name, desc = schema.primary(), schema.description()
    text = lambda f: F.col(column_of(schema, f.name)) if f else F.lit("")
    similar: list[Column] = []
    if index.vectors is not None and index.encoder is not None and embeddable:
        vector = index.encoder.encode(query).tolist()
        rows = index.vectors.where(F.col("field").isin([f.name for f in embeddable])).join(F.broadcast(best.select("idx")), "idx", "left_semi")
        pivot = rows.groupBy("idx").agg(*[F.max(F.when(F.col("field") == f.name, S.dot(F.col("vec"), vector))).alias(f"sim{i}") for i, f in enumerate(embeddable)])
        best = best.join(F.broadcast(pivot), "idx", "left")
        similar = [_zero(F.col(f"sim{i}")) for i in range(len(embeddable))]
    with_signal = best.withColumn("signal", S.rerank_signal(F.lower(text(name)), text(desc), terms, F.size("strict_types") > 0, similar))
    ranges = with_signal.agg(F.min("signal").alias("lo"), F.max("signal").alias("hi"))
    final = F.lit(1 - o.w_rerank) * F.col("stage1") + F.lit(o.w_rerank) * S.normalised(F.col("signal"), F.col("lo"), F.col("hi"))
    return with_signal.crossJoin(F.broadcast(ranges)).withColumn("score", final).orderBy(F.desc("score"), "idx").limit(o.top_k)


def hits(index: Index, ranked: DataFrame, query: str, snippet_fields: list[Field]) -> DataFrame:
    """Displayed fields, tags, raw scores, flags and snippets; the snippets are made after the limit."""
    schema = index.schema
    shown = [x for f in schema.displayed() for x in (F.lit(f.name), F.col(column_of(schema, f.name)))]
    fields = F.create_map(*shown) if shown else F.create_map().cast("map<string,string>")
    snippet = snippet_column([(f.name, F.col(column_of(schema, f.name))) for f in snippet_fields], query)
    return ranked.select("id", "idx", "score", "path", "source", "tags", fields.alias("fields"), snippet.alias("snippet"), "bm25", "emb", "exact", "prefix", F.col("strict_types").alias("strict")).orderBy(F.desc("score"), "idx")


def search(index: Index, options: SearchOptions) -> DataFrame:
    """The best hits. An empty query, or one without a token, has none; items that match nothing may fill the result."""
    o = options.resolved()
    terms = py_distinct_tokens(o.query)
    if not o.query or not terms:
        return index.spark.createDataFrame([], HIT)
    searchable, embeddable = S.resolve_fields(index.schema, o.fields, "searchable"), S.resolve_fields(index.schema, o.fields, "embeddable")
    # Only numbers are kept for the two uses of the signals; the texts of the few best are read again.
    rows = signals(index, o.query, terms, searchable, embeddable).select("idx", *SIGNALS, "strict_types", "prefix", "exact").persist(StorageLevel.MEMORY_AND_DISK)
    best = index.items.join(F.broadcast(stage_one(rows, o)), "idx").persist(StorageLevel.MEMORY_AND_DISK)
    index.cached += [rows, best]
    ranked = reranked(index, best, o.query, terms, embeddable, o)
    wanted = [f for f in index.schema.snippets() if f.name in o.fields] or index.schema.snippets()
    return hits(index, ranked, o.query, wanted)


def fast_search(index: Index, text: str, k: int = 10) -> DataFrame:
    """BM25 alone over all searchable fields, with a long text as the query: its first 2000 characters."""
    query = text[:FAST_CHARS]
    terms = py_distinct_tokens(query)
    out = "idx bigint, path string, source string, name string, desc string, score double, snippet string"
    if not terms:
        return index.spark.createDataFrame([], out)
    schema = index.schema
    best = S.bm25(index, terms, schema.searchable()).where("bm25 > 0").orderBy(F.desc("bm25"), "idx").limit(k if k > 0 else 10)
    name, desc = schema.primary(), schema.description()
    col = lambda f: F.col(column_of(schema, f.name)) if f else F.lit("")
    rows = index.items.join(F.broadcast(best), "idx")
    snippet = F.regexp_replace(snippet_column([("", col(desc))], query), r"^\[\] ", "") if desc else F.lit("")
    return rows.select("idx", "path", "source", col(name).alias("name"), col(desc).alias("desc"), F.col("bm25").alias("score"), snippet.alias("snippet")).orderBy(F.desc("score"), "idx")


class ResultCache:
    """Up to ``most`` collected results; the oldest goes first. Callers get copies."""

    def __init__(self, most: int = 256):
        self.most, self.rows = most, OrderedDict()

    @staticmethod
    def key(o: SearchOptions) -> tuple:
        r = o.resolved()
        return tuple(tuple(v) if isinstance(v, list) else v for v in r.__dict__.values())

    def get(self, o: SearchOptions):
        got = self.rows.get(self.key(o))
        return deepcopy(got) if got is not None else None

    def set(self, o: SearchOptions, rows: list) -> None:
        self.rows[self.key(o)] = deepcopy(rows)
        while len(self.rows) > self.most:
            self.rows.popitem(last=False)


class Engine:
    """An index with a result cache; searches run in a job group that :meth:`cancel` ends."""

    def __init__(self, index: Index, group: str = "search"):
        self.index, self.cache, self.group, self.lock = index, ResultCache(), group, Lock()

    def search(self, options: SearchOptions) -> list[dict]:
        with self.lock:
            got = self.cache.get(options)
        if got is None:
            # The frames that a search keeps are its own, so that searches can run side by side.
            own = replace(self.index, cached=[])
            self.index.spark.sparkContext.setJobGroup(self.group, options.query, interruptOnCancel=True)
            try:
                got = [r.asDict() for r in search(own, options).collect()]
            finally:
                own.close()
            with self.lock:
                self.cache.set(options, got)
        return got

    def fast_search(self, text: str, k: int = 10) -> list[dict]:
        return [r.asDict() for r in fast_search(self.index, text, k).collect()]

    def cancel(self) -> None:
        self.index.spark.sparkContext.cancelJobGroup(self.group)

    def close(self) -> None:
        self.index.close()
