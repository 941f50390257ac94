import pytest

from siltwork.operators.embedding import HashEncoder
from siltwork.operators.index import build_index, load_index, index_of, normalise_items, numbered
from siltwork.plans.search import Engine, ResultCache, fast_search, search
from siltwork.plans.service import CommandError, Service
from siltwork.schema import LONGTEXT, TAGS, TEXT, CorpusSchema, Field, SchemaError, SearchOptions

ITEM = "id string, path string, source string, tags array<string>, fields map<string,string>"
TEST = CorpusSchema.of("test", [Field("name", TEXT, 5, True, display=True), Field("body", LONGTEXT, 1, True, display=True, snippet=True)])
STOCK = CorpusSchema.of("inventory", [Field("sku", TEXT, 5, True, display=True), Field("summary", LONGTEXT, 1, True, display=True, snippet=True), Field("labels", TAGS, 3, True, display=True)], "sku")
A = [("a.md", "Nginx 使用指南", "Nginx 反向代理的配置与部署说明, 示例见附录"), ("b.md", "Nginx 配置", "nginx 反向代理配置示例"), ("c.md", "Markdown 渲染", "前端渲染 markdown 的实现方式")]
B = [("app.md", "App", "描述一"), ("net.md", "网络笔记", "内网段 192.168.1.1 的部署记录")]
C = [("a.md", "Alpha", "one two three four five six seven eight nine ten"), ("b.md", "Beta", "alpha note")]


def build(spark, tmp, schema, rows, encoder=None, cache=""):
    build_index(spark.createDataFrame(rows, ITEM), schema, str(tmp), encoder, cache)
    return load_index(spark, str(tmp), encoder)


def docs(rows):
    return [(p, p, "", [], {"name": n, "body": b}) for p, n, b in rows]


@pytest.fixture(scope="module")
def indexes(spark, tmp_path_factory):
    return {k: build(spark, tmp_path_factory.mktemp(k), TEST, docs(v)) for k, v in (("A", A), ("B", B), ("C", C))}


@pytest.mark.parametrize(
    "corpus,query,want",
    [
        ("A", "nginx 部署", [("a.md", 0.792472, 3.102736), ("b.md", 0.66, 3.177489), ("c.md", 0, 0)]),
        ("A", "markdown 渲染", [("c.md", 0.88, 13.261917), ("a.md", 0, 0), ("b.md", 0, 0)]),
        ("B", "192.168.1.1", [("net.md", 0.52, 1.899746), ("app.md", 0, 0)]),
        ("C", "alpha note", [("a.md", 0.52, 3.465736), ("b.md", 0.28, 1.980421)]),
    ],
)
def test_golden_scores(indexes, corpus, query, want):
    got = [(r.path, round(r.score, 6), round(r.bm25, 6)) for r in search(indexes[corpus], SearchOptions(query)).collect()]
    assert got == want


def test_custom_schema(spark, tmp_path):
    ix = build(spark, tmp_path, STOCK, [("sku/123", "sku/123.md", "shop", ["premium", "on sale"], dict(summary="红色外壳的桌面小部件, 带无线充电功能", sku="widget-123"))])
    hit = search(ix, SearchOptions("widget-123")).first()
    assert round(hit.score, 6) == 1.380583 and round(hit.bm25, 6) == 2.876821 and hit.id == "sku/123" and hit.source == "shop"
    assert hit.tags == ["premium", "on", "sale"] and hit.fields["labels"] == "premium on sale" and hit.exact and not hit.strict
    assert round(search(ix, SearchOptions("premium")).first().bm25, 6) == 0.863046


def test_empty_query_cap_and_cache(indexes):
    assert search(indexes["A"], SearchOptions("")).collect() == [] and search(indexes["A"], SearchOptions("!!!")).collect() == []
    engine = Engine(indexes["C"])
    assert len(engine.search(SearchOptions("alpha note", top_k=1))) == 1 and len(engine.search(SearchOptions("alpha note", top_k=5))) == 2
    first = engine.search(SearchOptions("alpha note"))
    first[0]["path"] = "changed"
    assert engine.search(SearchOptions("alpha note"))[0]["path"] == "a.md"
    assert len(search(indexes["C"], SearchOptions("alpha note", rerank_top=1)).collect()) == 1
    assert len(search(indexes["C"], SearchOptions("no such", strict=True)).collect()) == 2
    cache = ResultCache(2)
    for q in "abc":
        cache.set(SearchOptions(q), [1])
    assert cache.get(SearchOptions("a")) is None and cache.get(SearchOptions("c")) == [1]


def test_field_restriction_and_fast_search(indexes):
    got = {r.path: r for r in search(indexes["C"], SearchOptions("alpha", fields=["body"])).collect()}
    assert got["a.md"].bm25 == 0 and round(got["b.md"].bm25, 6) == round(0.6931472 * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 6)), 6)
    assert [r.path for r in search(indexes["C"], SearchOptions("alpha", fields=["unknown"])).collect()] == ["a.md", "b.md"]
    rows = fast_search(indexes["A"], "nginx 配置与部署的说明文档", 2).collect()
    assert rows and rows[0].name and all(r.score > 0 for r in rows) and "【" in rows[0].snippet + rows[1].snippet
    assert fast_search(indexes["A"], "...").collect() == []


def test_snippets_and_strict_types(indexes):
    hit = search(indexes["B"], SearchOptions("192.168.1.1")).first()
    # Only strict fields, the path and the name are looked at: the body isn't strict here.
    assert hit.strict == [] and hit.snippet == "[body] 内网段 【192】.【168】.【1】.【1】 的部署记录"


def test_hash_vectors(spark, tmp_path):
    schema = CorpusSchema.of("demo", [Field("title", TEXT, 5, True, True, True), Field("body", LONGTEXT, 1, True, True, True, True)])
    rows = [(p, p, "", [], {"title": n, "body": b}) for p, n, b in C]
    ix = build(spark, tmp_path, schema, rows, HashEncoder())
    got = search(ix, SearchOptions("alpha note")).collect()
    assert got[0].emb != 0 and len(got) == 2
    adhoc = index_of(numbered(normalise_items(spark.createDataFrame(rows, ITEM), schema), str(tmp_path / "adhoc")), schema, HashEncoder())
    assert [(r.path, round(r.score, 9)) for r in search(adhoc, SearchOptions("alpha note")).collect()] == [(r.path, round(r.score, 9)) for r in got]


def test_schema_rules(tmp_path):
    with pytest.raises(SchemaError):
        CorpusSchema.of("x", [Field("a"), Field("a")])
    with pytest.raises(SchemaError):
        CorpusSchema.of("x", [Field("a")])
    with pytest.raises(SchemaError):
        CorpusSchema.of("x", [Field("a", searchable=True, weight=-1)])
    with pytest.raises(SchemaError):
        CorpusSchema.of("x", [Field("a", searchable=True)], "b")
    s = CorpusSchema.of("x", [Field("a", weight=0, searchable=True)])
    assert s.fields[0].weight == 1 and s.primary() is None and s.embed_chars() == 512
    s.save(tmp_path / "s.json")
    back = CorpusSchema.load(tmp_path / "s.json")
    assert back.fields == s.fields and back.max_embed_chars == 512 and "a:text" in str(back)


def test_service(spark, tmp_path):
    svc = Service(spark)
    build_index(spark.createDataFrame(docs(A), ITEM), TEST, str(tmp_path))
    assert svc.schema(str(tmp_path))["fields"][0]["name"] == "name"
    assert set(svc.search(str(tmp_path), "nginx")[0]) == {"id", "score", "path", "source", "tags", "fields", "snippet"}
    for bad in (lambda: svc.search(str(tmp_path), "x", fields=["nope"]), lambda: svc.search(str(tmp_path / "no"), "x"), lambda: svc.fastsearch(str(tmp_path), "  ")):
        with pytest.raises(CommandError):
            bad()
    assert svc.fastsearch(str(tmp_path), "nginx")
    with pytest.raises(ValueError):
        build_index(spark.createDataFrame([], ITEM), TEST, str(tmp_path / "none"))
    svc.close()
