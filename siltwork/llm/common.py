"""What the operators of this subpackage share: cut points, hashing of words, dense numbering.

Conventions that hold for every operator here:

* only the named columns are read, so extra columns and clashing names don't matter;
* a row whose ``doc_id`` is null can't be named in a result and takes no part;
* temporary tables are written below ``spark.checkpoint.dir``, which all executors share.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut points: the cluster's ``spark.checkpoint.dir``, or a new one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    named = tempfile.mkdtemp(prefix="siltwork-")
    spark.sparkContext.setCheckpointDir(named)
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a temporary table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltwork/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    relieve(spark)
    return spark.read.schema(df.schema).parquet(path)


def relieve(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage if its heap takes more than half of what it may.

    A chain of many queries leaves plans and compiled code behind. They are garbage, but the JVM would rather fill its whole
    heap with them; once it collects, it gives the memory back, and Spark deletes the shuffle files of what has ended.
    """
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        jvm.java.lang.System.gc()


def release() -> None:
    """Delete the temporary tables; run when the results that read them have been written."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already; the folder is the cluster's to clean then
            return


def numbered(df: DataFrame, keys: list[str], number: str, what: str) -> DataFrame:
    """Number the rows 0..n-1 in the order of ``keys`` (unique together): range partitions, sorted apart, then offset.

    Only one row per partition comes to the driver.
    """
    sorted_df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = F.monotonically_increasing_id()
    kept = cut(
        sorted_df.select("*", F.shiftright(local, 33).alias("__part"), local.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")),
        what,
    )
    sizes = dict(kept.groupBy("__part").count().collect())
    offsets, total = {}, 0
    for part in sorted(sizes):
        offsets[part] = total
        total += sizes[part]
    start = spark_rows(df.sparkSession, list(offsets.items()), "__part int, __start bigint")
    return kept.join(F.broadcast(start), "__part").select(*df.columns, (F.col("__start") + F.col("__at")).alias(number))


def spark_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table of driver rows; for tables whose size doesn't grow with the data (partitions, sources, languages)."""
    return spark.createDataFrame(rows, schema)


def components(edges: DataFrame, what: str) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b), root the least node of its component; alternating stars.

    Every round halves the distance to the root or better; hot nodes are aggregated, not windowed.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{what}-edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("__m")).select(F.col("a").alias("__u"), F.least("a", "__m").alias("__m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("__u")).select(F.col("b").alias("a"), F.col("__m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("__m")).select(F.col("a").alias("__u"), "__m")
        small = large.join(least, F.col("a") == F.col("__u")).select(F.greatest("b", "__m").alias("a"), F.least("b", "__m").alias("b")).where("a <> b")
        edges = cut(small.unionByName(least.select(F.col("__u").alias("a"), F.col("__m").alias("b"))).distinct(), f"{what}-stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def words_of(text: Column) -> Column:
    """How many runs of non-blank characters a text has (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0)).cast("bigint")


# ---- hashing of words, vectorised over the bytes of a text ----

_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = 0x9E3779B97F4A7C15 | 1
_MI = pow(_M, -1, 1 << 64)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)
_WORD = np.zeros(256, bool)
for _c in range(256):
    _WORD[_c] = _c >= 128 or chr(_c).isalnum() or _c == 95


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier, and of its inverse."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 2 * len(_POW), 1 << 16)
        up, down = np.full(size, _M, np.uint64), np.full(size, _MI, np.uint64)
        up[0] = down[0] = 1
        _POW, _INV = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POW[:n], _INV[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Signs outside of ASCII part words as those of ASCII do; scripts that are written without blanks have words of one letter.
_SIGN = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u203e\u2041-\u206f\u2190-\u2bff\u3000-\u3004\u3008-\u3020\u3030\ufe30-\ufe4f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_LETTER = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3021-\u302f\u3031-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(text: str) -> bytes:
    """A text's words in lower case, as UTF-8 in which only bytes of words are letters, digits, _ or beyond ASCII."""
    low = text.lower()
    if not low.isascii():
        low = _LETTER.sub(r" \g<0> ", _SIGN.sub(" ", low))
    return low.encode("utf-8", "replace")


def sign_classes() -> tuple[str, str]:
    """What :func:`normal` takes for signs, and for words of one letter, as classes of a regular expression in ASCII."""
    return tuple("".join(c if c.isascii() else f"\\x{{{ord(c):x}}}" for c in p.pattern) for p in (_SIGN, _LETTER))


def word_hashes(text: str | bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text (or of its :func:`normal` form), with their first and last+1 byte in that form."""
    raw = np.frombuffer(normal(text) if isinstance(text, str) else text, np.uint8)
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.flatnonzero(np.diff(_WORD[raw].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[raw] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; none if there are fewer."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    up, down = powers(len(words) + 1)
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])
