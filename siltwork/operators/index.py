"""The inverted index as tables: postings, document lengths, field statistics; written as a snapshot and read back."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.extract import merge_tags
from ..functions.text import term_counts
from .. import storage
from ..schema import CorpusSchema

CURRENT = "CURRENT"


def column_of(schema: CorpusSchema, name: str) -> str:
    """Fields have columns by number, so that their names needn't be column names."""
    return f"f{schema.index(name)}"


def normalise_items(items: DataFrame, schema: CorpusSchema) -> DataFrame:
    """Items with one column per field: ids default to paths, sources to 'item', tags join every tags field.

    Missing fields and nulls are empty texts. A tag with a blank becomes two, as it does when an index is read.
    """
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    cols = {}
    for f in schema.fields:
        text = F.coalesce(F.try_element_at(F.col("fields"), F.lit(f.name)), F.lit(""))
        cols[column_of(schema, f.name)] = merge_tags(text, tags) if f.type == "tags" else text
    path = F.coalesce(F.col("path"), F.lit(""))
    own_id = F.when(F.coalesce(F.col("id"), F.lit("")) == "", path).otherwise(F.col("id"))
    source = F.when(F.coalesce(F.col("source"), F.lit("")) == "", F.lit("item")).otherwise(F.col("source"))
    split = F.filter(F.split(F.array_join(tags, " "), r"[ \t\n]+"), lambda x: x != "")
    order = [F.col(c) for c in ("source_no", "path", "row_no") if c in items.columns] or [own_id]
    return items.select(F.struct(*order, own_id.alias("__id")).alias("order"), own_id.alias("id"), path.alias("path"), source.alias("source"), split.alias("tags"), *[c.alias(k) for k, c in cols.items()])


def numbered(items: DataFrame, staging: str) -> DataFrame:
    """Items with ``idx`` 0..n-1 in their order: range partitions are written once, then offset by their sizes."""
    local = F.monotonically_increasing_id()
    rows = items.repartitionByRange("order").sortWithinPartitions("order")
    rows.select(F.shiftright(local, 33).alias("part"), local.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), "*").write.mode("overwrite").parquet(staging)
    kept = items.sparkSession.read.parquet(staging)
    sizes = dict(kept.groupBy("part").count().collect())
    start, total = [], 0
    for part in sorted(sizes):
        start.append((part, total))
        total += sizes[part]
    offsets = items.sparkSession.createDataFrame(start or [(0, 0)], "part bigint, start bigint")
    return kept.join(F.broadcast(offsets), "part").select((F.col("start") + F.col("at")).alias("idx"), *[c for c in items.columns if c != "order"])


def field_rows(items: DataFrame, schema: CorpusSchema) -> DataFrame:
    """(idx, field, text) of every field, searchable or not."""
    pairs = F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(column_of(schema, f.name)).alias("text")) for f in schema.fields])
    return items.select("idx", F.explode(pairs).alias("x")).select("idx", "x.field", "x.text")


def _typed(rows: DataFrame, keep: list[str], more: str) -> StructType:
    return StructType([StructField(c, rows.schema[c].dataType) for c in keep] + list(StructType.fromDDL(more)))


def in_batches(batch: pa.RecordBatch, rows: int = 512):
    """Parts of a batch, so that few texts at a time are Python objects."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def _count_terms(batches):
    """(idx, field, text) to (idx, field, term, tf, dl), a few texts at a time."""
    for part in (p for b in batches for p in in_batches(b)):
        counts = [term_counts(t) for t in part.column(2).to_pylist()]
        sizes = np.array([len(c) for c in counts], np.int64)
        row = pa.array(np.repeat(np.arange(len(counts)), sizes))
        terms, tf = pa.array([t for c in counts for t in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())
        yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), terms, tf, pa.array(np.repeat(sizes, sizes))], ["idx", "field", "term", "tf", "dl"])


def _count_lengths(batches):
    for part in (p for b in batches for p in in_batches(b)):
        dl = pa.array([len(term_counts(t)) for t in part.column(2).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), dl], ["idx", "field", "dl"])


def _count_frequencies(batches, most: int = 100_000):
    """(idx, field, text) to (term, field, df): sums of up to ``most`` terms and a text's, to be summed up further."""
    held: dict[str, Counter] = {}

    def out():
        columns = [t for c in held.values() for t in c], [f for f, c in held.items() for _ in c], [n for c in held.values() for n in c.values()]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["term", "field", "df"])

    for part in (p for b in batches for p in in_batches(b)):
        for field, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
            held.setdefault(field, Counter()).update(list(term_counts(text)))
            if sum(map(len, held.values())) >= most:
                yield out()
                held.clear()
    if held:
        yield out()


def _bytes_of(rows: DataFrame) -> DataFrame:
    return rows.select("idx", "field", F.col("text").cast("binary").alias("text"))


def distinct_ids(ids: DataFrame) -> bool:
    """Whether no value of the one column occurs twice."""
    return ids.groupBy(*ids.columns).count().where("count > 1").isEmpty()


def postings(rows: DataFrame, distinct: bool = False) -> DataFrame:
    """(idx, field, term, tf, dl): how often each term occurs in each field of each item, beside the field's length.

    A text's terms are counted where it is read. If each item has each field once (``distinct``), nothing is shuffled; else
    the texts of an item count as one.
    """
    counted = _bytes_of(rows).mapInArrow(_count_terms, _typed(rows, ["idx", "field"], "term string, tf bigint, dl bigint"))
    if distinct:
        return counted
    summed = counted.groupBy("idx", "field", "term").agg(F.sum("tf").alias("tf"))
    return summed.withColumn("dl", F.count("*").over(Window.partitionBy("idx", "field")))


def doc_lengths(rows: DataFrame, distinct: bool = False) -> DataFrame:
    """(idx, field, dl): the number of distinct terms of the fields that have any. ``distinct`` as in :func:`postings`."""
    if not distinct:
        return postings(rows).groupBy("idx", "field").agg(F.count("*").alias("dl"))
    return _bytes_of(rows).mapInArrow(_count_lengths, _typed(rows, ["idx", "field"], "dl bigint")).where("dl > 0")


def term_frequencies(rows: DataFrame, distinct: bool = False) -> DataFrame:
    """(term, field, df) straight from texts: sums of batches are spread by term over as many partitions as the input's size asks for."""
    if not distinct:
        return document_frequency(postings(rows))
    counted = _bytes_of(rows).mapInArrow(_count_frequencies, "term string, field string, df bigint")
    return counted.repartition(parts_for(rows), "term").groupBy("term", "field").agg(F.sum("df").alias("df"))


def parts_for(df: DataFrame, each: int = 8 << 20) -> int:
    """Partitions of ``each`` bytes of what ``df`` reads, so that a partition's size doesn't follow the input's; Spark's own number if that size isn't known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= 1 << 50:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(df.sparkSession.sparkContext.defaultParallelism, size // each)


def field_stats(lengths: DataFrame, n_items: int) -> DataFrame:
    """(field, n, avgdl): the average runs over all items, also those where the field is empty."""
    return lengths.groupBy("field").agg(F.sum("dl").alias("total")).select("field", F.lit(n_items).cast("bigint").alias("n"), (F.col("total") / F.lit(n_items)).alias("avgdl"))


def stats_of(post: DataFrame, n_items: int) -> DataFrame:
    """:func:`field_stats` from postings: a field's lengths sum up to its postings."""
    return post.groupBy("field").agg(F.count("*").alias("total")).select("field", F.lit(n_items).cast("bigint").alias("n"), (F.col("total") / F.lit(n_items)).alias("avgdl"))


def document_frequency(post: DataFrame) -> DataFrame:
    """(term, field, df)."""
    return post.groupBy("term", "field").agg(F.count("*").alias("df"))


@dataclass
class Index:
    """A loaded index: its schema and tables. ``vectors`` is (idx, field, vec), None if nothing is embedded.

    One that isn't stored has its ``texts`` (idx, field, text), from which a query's own terms are counted, and ``n_items``.
    """

    spark: SparkSession
    schema: CorpusSchema
    items: DataFrame
    postings: DataFrame
    stats: DataFrame
    vectors: DataFrame | None = None
    path: str = ""
    encoder: object | None = None
    cached: list[DataFrame] = field(default_factory=list)
    texts: DataFrame | None = None
    n_items: int = 0

    def close(self) -> None:
        for df in self.cached:
            df.unpersist()
        self.cached.clear()

    def field_names(self) -> list[str]:
        return self.schema.names()


def index_of(items: DataFrame, schema: CorpusSchema, encoder=None, vectors: DataFrame | None = None) -> Index:
    """An index that isn't stored, of items with (idx, id, path, source, tags, f0, f1, ...); for ad-hoc queries and tests."""
    rows = field_rows(items, schema)
    n = items.count()
    if vectors is None and encoder is not None and schema.embeddable():
        embedded = rows.where(F.col("field").isin([f.name for f in schema.embeddable()]))
        vectors = embedded.select("idx", "field", encoder.column(F.substring("text", 1, schema.embed_chars())).alias("vec"))
    distinct = distinct_ids(items.select("idx"))
    stats = field_stats(doc_lengths(rows, distinct), max(n, 1))
    return Index(items.sparkSession, schema, items, postings(rows, distinct), stats, vectors, "", encoder, texts=rows if distinct else None, n_items=max(n, 1))


def build_index(items: DataFrame, schema: CorpusSchema, path: str, encoder=None, cache_dir: str = "", progress=None) -> dict[str, int]:
    """Write a snapshot of the index below ``path`` and make it the current one; returns how many items it has, how many files were skipped.

    The sources are read once. No item is an error. With an encoder, only texts whose content hash isn't in the embedding
    cache are encoded, and the encoder's files are copied into the snapshot. A manifest says what the snapshot holds.
    """
    from .embedding import embed_fields, save_encoder

    tell = progress or (lambda stage, done, total: None)
    spark = items.sparkSession
    schema.validate()
    snap = f"{path.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    staging = f"{snap}/staging"
    tell("items", 0, 4)
    skipped = 0
    if "error" in items.columns:
        items.write.parquet(f"{snap}/scanned")
        items = spark.read.schema(items.schema).parquet(f"{snap}/scanned")
        skipped = items.where("error IS NOT NULL").count()
        items = items.where("error IS NULL")
    numbered(normalise_items(items, schema), staging).write.parquet(f"{snap}/items")
    rows = spark.read.parquet(f"{snap}/items")
    n = rows.count()
    if not n:
        storage.delete(spark, snap)
        raise ValueError("there is nothing to index")
    tell("postings", 1, 4)
    # Counted once; the ranges are found from what is written. Sorted by term, so that a query's terms prune files and row groups.
    counted = postings(field_rows(rows, schema), distinct=True)
    counted.write.parquet(f"{snap}/counted")
    counted = spark.read.schema(counted.schema).parquet(f"{snap}/counted")
    counted.repartitionByRange(parts_for(counted, 32 << 20), "term").sortWithinPartitions("term", "field", "idx").write.parquet(f"{snap}/postings")
    stats_of(counted, n).write.parquet(f"{snap}/stats")
    tell("embeddings", 2, 4)
    embedded = encoder is not None and bool(schema.embeddable())
    if embedded:
        embed_fields(rows, schema, encoder, f"{snap}/vectors", cache_dir)
        save_encoder(spark, encoder, f"{snap}/model")
    tell("schema", 3, 4)
    for name in ("staging", "scanned", "counted"):
        storage.delete(spark, f"{snap}/{name}")
    storage.write_bytes(spark, f"{snap}/manifest.json", json.dumps({"items": n, "vectors": embedded, "encoder": encoder.name if embedded else ""}).encode())
    storage.write_bytes(spark, f"{snap}/schema.json", schema.to_json().encode())
    publish(spark, path, snap)
    tell("done", 4, 4)
    return {"items": n, "skipped": skipped}


def publish(spark: SparkSession, path: str, snap: str) -> None:
    """Make a snapshot current by replacing the pointer file in one step; older snapshots but one go."""
    storage.write_bytes(spark, f"{path}/schema.json", storage.read_bytes(spark, f"{snap}/schema.json"))
    before = current(spark, path) if storage.exists(spark, f"{path}/{CURRENT}") else ""
    storage.write_bytes(spark, f"{path}/{CURRENT}", json.dumps({"snapshot": snap.rpartition("/")[2]}).encode())
    clean_stale(spark, path, keep={snap.rpartition("/")[2], before.rpartition("/")[2]})


def clean_stale(spark: SparkSession, path: str, keep: set[str] | None = None) -> None:
    """Remove snapshots that are neither current nor in ``keep``: what broken-off builds have left."""
    if keep is None:
        keep = {current(spark, path).rpartition("/")[2]} if storage.exists(spark, f"{path}/{CURRENT}") else set()
    for name in storage.listing(spark, path):
        if name.startswith("snapshot-") and name not in keep:
            storage.delete(spark, f"{path}/{name}")


def current(spark: SparkSession, path: str) -> str:
    return f"{path.rstrip('/')}/{json.loads(storage.read_bytes(spark, f'{path}/{CURRENT}'))['snapshot']}"


def load_index(spark: SparkSession, path: str, encoder=None) -> Index:
    """The current snapshot's tables, and its own encoder unless one is given; no table is read before a query."""
    from .embedding import load_encoder

    snap = current(spark, path)
    schema = CorpusSchema.from_json(storage.read_bytes(spark, f"{snap}/schema.json").decode())
    manifest = json.loads(storage.read_bytes(spark, f"{snap}/manifest.json"))
    vectors = spark.read.parquet(f"{snap}/vectors") if manifest["vectors"] else None
    if encoder is None and manifest["vectors"]:
        encoder = load_encoder(spark, f"{snap}/model", manifest["encoder"])
    return Index(spark, schema, spark.read.parquet(f"{snap}/items"), *(spark.read.parquet(f"{snap}/{t}") for t in ("postings", "stats")), vectors, snap, encoder)
