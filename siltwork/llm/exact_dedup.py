"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of characters. Distinct blocks are sorted and their ranks become
integer names. Adjacent names are then paired, the distinct pairs sorted and named by rank, again and again, until
a document has a single name. Two documents end with the same identity exactly if they are the same text: a name
stands for one block or one pair, never for a hash of it.

The sort order of blocks is (64-bit hash, bytes). The hash comes first only so that a rank can be told from the hash
alone where it belongs to a single block; blocks that share a hash are told apart by their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

BLOCK, FAN = 1024, 64


def _blocks(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """One row per block: the document (id and hashes of its text), the block's number, hash and text.

    A place in a text is found by walking there from its beginning, so a text is first cut into large pieces, those into
    smaller ones, and those into blocks: the steps are few times the text's length, also if it is very long.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__block")).where(F.col("__id").isNotNull() & F.col("__block").isNotNull())
    rows = rows.select("__id", F.xxhash64("__block").alias("__h1"), F.hash("__block").alias("__h2"), F.lit(0).alias("__pos"), "__block")
    for size in (FAN * FAN * block, FAN * block, block):
        last = F.greatest(F.lit(0), F.floor((F.length("__block") - 1) / size).cast("int"))
        rows = rows.select("__id", "__h1", "__h2", "__pos", "__block", F.explode(F.sequence(F.lit(0), last)).alias("__k"))
        rows = rows.select("__id", "__h1", "__h2", (F.col("__pos") + F.col("__k") * (size // block)).alias("__pos"), F.substring("__block", F.col("__k") * size + 1, F.lit(size)).alias("__block"))
    return rows.withColumn("__bh", F.xxhash64("__block"))


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """(document, number, name): the rank of each block among the distinct blocks."""
    distinct = blocks.select("__bh", "__block").distinct()
    counted = numbered(distinct.groupBy("__bh").agg(F.count("*").alias("__n")), ["__bh"], "__rank", "block-ranks")
    places = blocks.select("__id", "__h1", "__h2", "__pos", "__bh")
    shared = counted.where("__n > 1").select("__bh")
    if shared.isEmpty():
        return places.join(counted.select("__bh", F.col("__rank").alias("__name")), "__bh").drop("__bh")
    # Blocks that share a hash: number them by their bytes beyond all single ranks.
    total = counted.count()
    apart = numbered(distinct.join(shared, "__bh", "left_semi"), ["__bh", "__block"], "__rank", "shared-blocks")
    lone = places.join(counted.where("__n = 1").select("__bh", F.col("__rank").alias("__name")), "__bh").drop("__bh")
    rest = blocks.join(apart.select("__bh", "__block", (F.col("__rank") + total).alias("__name")), ["__bh", "__block"]).drop("__bh", "__block")
    return lone.unionByName(rest)


def exact_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``__id, __h1, __h2, level, name`` for each distinct (id, text): equal (level, name) means equal text.

    Rows that repeat id and text are one document. An empty text is one empty block. Null ids and texts have no row.
    """
    key = ["__id", "__h1", "__h2"]
    blocks = _blocks(docs, id_col, text_col, block)
    named = cut(_name_blocks(blocks).distinct(), "names-0")
    done, level = [], 0
    while True:
        sized = named.withColumn("__last", F.max("__pos").over(_by(key)))
        if level:
            done.append(named.where("__whole").select(*key, F.lit(level).alias("level"), F.col("__name").alias("name")))
            open_ = named.where("NOT __whole")
        else:
            sized = cut(sized.select(*key, "__pos", "__name", (F.col("__last") == 0).alias("__whole")), "sized-0")
            done.append(sized.where("__whole").select(*key, F.lit(0).alias("level"), F.col("__name").alias("name")))
            open_ = sized.where("NOT __whole")
        if open_.isEmpty():
            break
        pairs = open_.groupBy(*key, F.floor(F.col("__pos") / 2).cast("int").alias("__pos")).agg(
            F.max(F.when(F.col("__pos") % 2 == 0, F.col("__name"))).alias("__left"),
            F.coalesce(F.max(F.when(F.col("__pos") % 2 == 1, F.col("__name"))), F.lit(-1)).alias("__right"),
        )
        names = numbered(pairs.select("__left", "__right").distinct(), ["__left", "__right"], "__name", f"pairs-{level}")
        level += 1
        joined = pairs.join(names, ["__left", "__right"]).select(*key, "__pos", "__name")
        named = cut(joined.withColumn("__whole", F.max("__pos").over(_by(key)) == 0), f"names-{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _by(key: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*key)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, keeper_id, copies, is_kept`` for each distinct (id, text).

    ``keeper_id`` is the least id of the documents with this text, ``copies`` how many of them there are. An empty
    text is a text like any other. A null text is never a copy: it keeps itself with ``copies`` 1. Rows that repeat
    both id and text count once. Rows with one id and several texts are separate documents. Null ids are left out.
    An empty table gives an empty result.
    """
    names = exact_identities(docs, id_col, text_col, block)
    groups = names.groupBy("level", "name").agg(F.min("__id").alias("keeper_id"), F.count("*").alias("copies"))
    result = names.join(groups, ["level", "name"]).select(F.col("__id").alias("doc_id"), "keeper_id", "copies", (F.col("__id") == F.col("keeper_id")).alias("is_kept"))
    bare = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNull()).select(F.col(id_col).alias("doc_id")).distinct()
    return result.unionByName(bare.select("doc_id", F.col("doc_id").alias("keeper_id"), F.lit(1).cast("bigint").alias("copies"), F.lit(True).alias("is_kept")))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, one for each text: the one with the least id; of rows that repeat id and text, one.

    Rows with a null text all stay. Rows with a null id go.
    """
    names = exact_identities(docs, id_col, text_col, block)
    least = F.row_number().over(_by(["level", "name"]).orderBy("__id", "__h1", "__h2"))
    losers = cut(names.withColumn("__n", least).where("__n > 1").select("__id", "__h1", "__h2"), "exact-losers").hint("shuffle_hash")
    left = docs.where(F.col(id_col).isNotNull())
    kept = left.join(losers, (left[id_col] == losers["__id"]) & (F.xxhash64(left[text_col]) == losers["__h1"]) & (F.hash(left[text_col]) == losers["__h2"]), "left_anti")
    repeats = _repeated(docs, id_col, text_col)
    return kept if repeats is None else _one_of_each(kept, repeats, id_col, text_col)


def _repeated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """The (id, hashes) of rows that repeat both, or None: the usual case costs one aggregate of ids."""
    again = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__h1"), F.hash(text_col).alias("__h2")).agg(F.count("*").alias("__n")).where("__n > 1")
    again = cut(again.select("__id", "__h1", "__h2"), "repeated-rows")
    return None if again.isEmpty() else again


def _one_of_each(docs: DataFrame, repeats: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row where id and text repeat."""
    is_repeat = (docs[id_col] == repeats["__id"]) & (F.xxhash64(docs[text_col]) == repeats["__h1"]) & (F.hash(docs[text_col]) == repeats["__h2"])
    single = docs.join(repeats.hint("shuffle_hash"), is_repeat, "left_anti")
    several = docs.join(repeats.hint("shuffle_hash"), is_repeat, "left_semi").dropDuplicates([id_col, text_col])
    return single.unionByName(several)
