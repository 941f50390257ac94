"""What has to hold so that queries pass over large tables: work in proportion to the input, memory that doesn't follow it."""

import math
from dataclasses import replace

from pyspark.sql import functions as F

from siltwork.functions.text import ascii_lower, contains_fold, contains_lower, term_counts, tokens
from siltwork.operators.index import doc_lengths, document_frequency, index_of, postings, term_frequencies
from siltwork.operators.scoring import bm25, bm25_scan
from siltwork.plans.search import signals
from siltwork.schema import LONGTEXT, TEXT, CorpusSchema, Field

ROWS = "idx bigint, field string, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_term_counts_are_those_of_tokens(spark):
    texts = ["Nginx 配置管理abc_ß ÀÉ x²Ⅷ", None, "", "a\x00b\x1fc  d e", "١٢ ३ ſ éx É'ÉX", "ＡＢＣ", "漢", "カ゚ン", "a_b-c.d A_B", "配" * 100]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("got")).collect():
        assert sorted(term_counts(None if r.t is None else r.t.encode()).elements()) == sorted(r.got)


def test_postings_of_long_texts_and_repeated_ids(spark):
    """A text's length is found once, not for each of its words; texts of one item count as one, as in SQL."""
    long = spark.createDataFrame([(1, "text", " ".join(f"w{i}" for i in range(20_000)) + " w0")], ROWS)
    assert "Exchange" not in plan(postings(long, True)) and "array_distinct" not in plan(postings(long))
    assert postings(long, True).agg(F.count("*"), F.min("dl"), F.max("dl"), F.sum("tf")).first()[:] == (20_000, 20_000, 20_000, 20_001)
    twice = spark.createDataFrame([(1, "text", "a b a"), (1, "text", "b c"), (2, "text", "a"), (2, "name", None), (None, "text", "c")], ROWS)
    want = [(1, "text", "a", 2, 3), (1, "text", "b", 2, 3), (1, "text", "c", 1, 3), (2, "text", "a", 1, 1), (None, "text", "c", 1, 1)]
    assert sorted(map(tuple, postings(twice).collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, doc_lengths(twice).collect()), key=str) == sorted([(1, "text", 3), (2, "text", 1), (None, "text", 1)], key=str)


def test_term_frequencies_hold_no_postings(spark):
    rows = spark.createDataFrame([(i, f, f"t{i % 7} x y X") for i in range(50) for f in ("name", "text")], ROWS)
    got = term_frequencies(rows, True)
    assert "idx" not in plan(got).split("MapInArrow")[0]
    assert sorted(got.collect()) == sorted(document_frequency(postings(rows)).collect())


def test_scan_reads_texts_once(spark):
    """Counts are a table that is read as often as needed; nothing is left in the cache, no text is tokenised in the plan."""
    items = spark.createDataFrame([(1, "the thing", "A b"), (2, None, "the the"), (3, "x", None)], "idx bigint, f0 string, f1 string")
    got = bm25_scan(items, ["the", "thing"], [("a", F.col("f0"), 3), ("b", F.col("f1"), 1)], ["idx"])
    both = plan(got.crossJoin(got.agg(F.max("bm25").alias("most"))))
    assert "regexp_extract_all" not in both and "MapInArrow" not in both and "InMemoryTableScan" not in both and "parquet" in both
    n, avg = 3, (2 + 1) / 3
    one = lambda tf, dl, df, avg: math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    want = {1: 3 * (one(1, 2, 1, avg) * 2), 2: one(2, 1, 1, 1.0), 3: 0.0}
    assert {r.idx: round(r.bm25, 9) for r in got.collect()} == {k: round(x, 9) for k, x in want.items()}


def test_contains_without_lowering(spark):
    texts = ["The THING", "Kelvin", "İx", "ſ", "a.b", "ÀÉ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for sub in ("the thing", "k", "i", "s", "a.b", "à", ".", "T", ""):
        r = df.select(F.contains(F.lower("t"), F.lit(sub)).alias("a"), contains_lower(F.col("t"), sub).alias("b"), F.coalesce(F.contains(ascii_lower(F.col("t")), F.lit(sub)), F.lit(False)).alias("c"), contains_fold(F.col("t"), sub).alias("d")).collect()
        assert [x.a for x in r] == [x.b for x in r]
        assert sub in ("", "T") or [x.c for x in r] == [x.d for x in r]


def test_search_joins_numbers(spark):
    """Texts aren't shuffled for a search's joins, and those of an index that isn't stored are read once for a query's terms."""
    schema = CorpusSchema.of("t", [Field("name", TEXT, 3, True), Field("body", LONGTEXT, 1, True, strict=True)])
    items = spark.createDataFrame([(i, f"p{i}", "", "", [], f"n{i}", f"the thing {i} x") for i in range(5)], "idx bigint, id string, path string, source string, tags array<string>, f0 string, f1 string")
    ix = index_of(items, schema)
    assert ix.texts is not None and index_of(items.union(items), schema).texts is None
    got = signals(ix, "thing 3", ["thing", "3"], schema.searchable(), [])
    joined = plan(got).split("Join")
    assert len(joined) > 1 and not any(" f1#" in x.splitlines()[1] for x in plan(got).split("Exchange")[1:] if len(x.splitlines()) > 1)
    assert [r.idx for r in got.orderBy(F.desc("bm25"), "idx").limit(1).collect()] == [3]
    full = bm25(replace(ix, texts=None), ["thing", "3"], schema.searchable())
    assert sorted(bm25(ix, ["thing", "3"], schema.searchable()).collect()) == sorted(full.collect())


def test_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    """Large files are parsed as they come in; a broken one still has no item, wherever it breaks."""
    from siltwork.sources import scan as at

    (tmp_path / "a.ndjson").write_text("".join(f'{{"t": "é{i}", "b": [{i}]}}\n\n' for i in range(12_000)), "utf-8")
    (tmp_path / "b.ndjson").write_text('{"t": 1}\n' * 6_000 + "{")
    (tmp_path / "c.csv").write_text("t,b\n" + "".join(f'"x\n{i}",é{i}\n\n' for i in range(12_000)), "utf-8")
    (tmp_path / "e.csv").write_text("t,b\n" + "1,2\n" * 6_000 + '"open')
    text = "schema:\n  name: s\n  fields: [{{name: t}}, {{name: b, searchable: true}}]\nsources:\n  - {{dir: '{d}', format: {f}, include: '*.{f}', mapping: {{t: t, b: {b}}}}}\n"
    for kind, b, path in (("ndjson", "b.0", "a.ndjson"), ("csv", "b", "c.csv")):
        cfg = at.parse_config(text.format(d=tmp_path, f=kind, b=b))
        rows = at.scan(spark, cfg).collect()
        good = {r.id: r.fields for r in rows if r.error is None}
        want = [(f"é{i}", str(i)) if kind == "ndjson" else (f"x\n{i}", f"é{i}") for i in range(12_000)]
        assert good == {f"{path}#{i}": {"t": t, "b": b} for i, (t, b) in enumerate(want, 1)}
        assert sorted(r.path for r in rows if r.error) == (["b.ndjson"] if kind == "ndjson" else ["e.csv"])
    pieces = at.in_pieces(at.files(spark, str(tmp_path), "*.csv").select("path", "content")).select(F.max(F.length("piece")), F.count("*")).first()
    assert pieces[0] == at.PIECE and pieces[1] > 4


def test_hash_embedding_of_bounded_parts(monkeypatch):
    """The texts that are hashed at once are bounded by their letters, not only by their number; the vectors stay the same."""
    import numpy as np
    import pandas as pd

    from siltwork.functions import hashing as H

    texts = ["ab cd " * (i * 997 % 20_000) for i in range(300)] + [None, "", "x y " * 750_000]
    seen, plain = [], H.hash_embeddings
    monkeypatch.setattr(H, "hash_embeddings", lambda part: seen.append(sum(map(len, part))) or plain(part))
    got = np.stack(H.embed_all(pd.Series(texts)))
    assert sorted(seen)[-1] == 3_000_000 and sorted(seen)[-2] <= H.AT_ONCE and len(seen) > 3
    assert np.array_equal(got[::25], np.stack([plain([t or ""])[0] for t in texts[::25]])) and not got[300].any() and len(got) == 303
