import math
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import pytest

import corpus_pipeline
from siltwork.llm import common, minhash, mixing, packing, queries, toxicity
from siltwork.llm.common import components, numbered, shared_dir
from tests.llm.cases import empty, odd
from tests.llm.test_dedup import brute_near


def test_stages_against_brute_force(spark, data):
    """Each stage on its own input: what stays is what plain Python keeps."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    start = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]

    model = toxicity.train_toxicity(docs, labels)
    first = corpus_pipeline.filter_toxic(spark, docs, data)
    clean = {i for i, r in start.items() if not model or model.score(r.text or "")[0] < model.threshold}
    assert {r.doc_id for r in first.collect()} == clean and first.columns == docs.columns

    second = corpus_pipeline.dedup_exact(spark, first, data)
    by_text = defaultdict(list)
    for i in clean:
        by_text[start[i].text].append(i)
    once = {min(v) for v in by_text.values()}
    assert {r.doc_id for r in second.collect()} == once and second.columns == docs.columns

    third = corpus_pipeline.dedup_near(spark, second, data)
    keepers = set(brute_near([(i, start[i].text) for i in once], minhash.THRESHOLD).values())
    assert {r.doc_id for r in third.collect()} == keepers and third.columns == docs.columns

    fourth = corpus_pipeline.mix_sources(spark, third, data)
    assert fourth.columns == docs.columns
    tokens, words = Counter(), {i: len((start[i].text or "").split()) for i in keepers}
    for i in keepers:
        tokens[start[i].source] += words[i]
    total = sum(tokens.values())
    w = mixing.weights(tokens, mixing.solve_exponent(tokens, total))
    taken, rows = Counter(), fourth.collect()
    for r in rows:
        taken[r.source] += words[r.doc_id]
        assert r == start[r.doc_id]
    longest = max(words.values())
    assert all(0 <= taken[s] - math.floor(w[s] * total + 0.5) < longest for s in tokens if w[s] * total >= 1)

    fifth = corpus_pipeline.pack_bins(spark, fourth, data).collect()
    packed = Counter()
    for x in fifth:
        packed[x.doc_id] += x.length
    assert packed == Counter({i: n * words[i] for i, n in Counter(r.doc_id for r in rows).items() if words[i]})
    fills = Counter()
    for x in fifth:
        fills[x.bin] += x.length
    assert max(fills.values()) <= packing.CAPACITY


def test_run_is_the_stages(spark, data):
    got = corpus_pipeline.run(spark, data)
    assert got.columns == ["bin", "doc_id", "copy", "piece", "word_start", "length", "bin_offset"] and got.count() > 50
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_and_empty_stages(spark, data):
    for docs in (odd(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, data)
            assert name == "packing" or out.columns == docs.columns
            out.collect()


def test_queries_are_registered():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 11)] == [1] * 10 and "pipeline" in queries.QUERIES
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_sql(spark, data, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    want = con.execute(queries.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    a, b = (df[cols].sort_values(cols, ignore_index=True) for df in (got, want))
    for c in cols:
        assert (a[c].fillna("~") == b[c].fillna("~")).all(), c


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 300), (300, 250), (7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "t").collect())
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 160), 100) | dict.fromkeys((200, 250, 300), 200)


def test_numbered(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS x")
    assert [tuple(r) for r in numbered(df, ["x"], "n", "t").orderBy("n").collect()] == [(i, i) for i in range(1000)]
    assert numbered(df.where("false"), ["x"], "n", "t").collect() == []


def test_shared_dir(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

    class Cluster:
        class conf:
            get = staticmethod(lambda k, d=None: "spark://host:7077" if k == "spark.master" else d)

    with pytest.raises(ValueError):
        shared_dir(Cluster)


def test_driver_heap_is_given_back(spark, monkeypatch):
    """Every cut, and the fit before it begins, has the JVM collect a heap that has grown beyond half of its bound; a smaller one is left."""
    jvm, gcs, heap = spark.sparkContext._jvm, [], [0]
    fake = SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(
        Runtime=SimpleNamespace(getRuntime=lambda: SimpleNamespace(totalMemory=lambda: heap[0], maxMemory=lambda: 1000)), System=SimpleNamespace(gc=lambda: gcs.append(heap[0])))))
    real = common.relieve
    watched = lambda s: real(SimpleNamespace(sparkContext=SimpleNamespace(_jvm=fake)))
    monkeypatch.setattr(common, "relieve", watched)
    monkeypatch.setattr(toxicity, "relieve", watched)
    for heap[0] in (500, 501):
        assert common.cut(spark.range(3), "t").count() == 3
    assert gcs == [501]
    docs, labels = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: len(gcs))
    assert toxicity.train_toxicity(docs, labels) == 2
    monkeypatch.undo()
    assert jvm.java.lang.Runtime.getRuntime().totalMemory() > 0 and common.relieve(spark) is None
