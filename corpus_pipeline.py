"""From raw documents to packed training bins: five stages, each over all that its predecessor kept.

1. toxicity: documents that the multiple-instance model rejects go;
2. exact dedup: one document of each text stays;
3. near dedup: one document of each near-duplicate group stays;
4. mixing: documents are taken, some repeatedly, so that the sources meet their target weights;
5. packing: the words of all that is left are placed in bins.

Every stage is written as Parquet and read again before the next one. Ids are integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltwork import storage
from siltwork.llm.common import cut
from siltwork.llm.exact_dedup import drop_exact_duplicates
from siltwork.llm.minhash import drop_near_duplicates
from siltwork.llm.mixing import mix_documents
from siltwork.llm.packing import pack
from siltwork.llm.toxicity import drop_toxic


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; all others stay as they are, those with a null, empty or wordless text among them.

    Rows with a null id go; repeated rows are judged each. The labels are the table ``labels``; if there is no such table,
    or it hasn't labels of both kinds, nothing can be learned and nothing is rejected. Empty in, empty out.
    """
    path = f"{sf_dir}/labels.parquet"
    labels = spark.read.parquet(path) if storage.exists(spark, path) else spark.createDataFrame([], "doc_id bigint, toxic int")
    return drop_toxic(docs, labels)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays for each text: that of the least id. Null texts are nobody's copies and stay; null ids go. Empty in, empty out."""
    return drop_exact_duplicates(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id, all its rows with it.

    Texts without a word are nobody's copies and stay. Null ids go. Empty in, empty out.
    """
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the schedule takes them: some of a source, or all, or several times, so that the sources meet their weights.

    Texts without a word fill no budget and go, as do null ids; a null source is a source. Empty in, empty out.
    """
    return mix_documents(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the words of every document go: ``bin, doc_id, copy, piece, word_start, length, bin_offset``.

    A document that comes several times is packed as often, numbered by ``copy``. Texts without a word take no place.
    Empty in, empty out.
    """
    return pack(docs)


STAGES = [
    ("toxicity", filter_toxic),
    ("exact dedup", dedup_exact),
    ("near dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: The toxicity stage trains a model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is the last stage's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
