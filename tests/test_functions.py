import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltwork.functions import text as T
from siltwork.functions.extract import MISSING, get_path, merge_tags, split_words, stringify, to_tags
from siltwork.functions.hashing import bucket, bucket_column, fnv64, hash_embedding
from siltwork.functions.snippet import highlight, query_words, snippets
from siltwork.sources.scan import match_glob

VECTORS = {
    k: v.split()
    for k, v in {
        "Nginx配置": "nginx 配置", "PRODUCT-2024-001": "product 2024 001", "hello world": "hello world", "Nginx 配置管理": "nginx 配置 置管 管理", "": "", "!!!": "",
        "测试abc测试": "测试 abc 测试", "单个字运行时: 洞 和 配置": "单个 个字 字运 运行 行时 洞 和 配置", "Éa_Öx ÀB": "Éa_Öx Àb",
    }.items()
}


def test_tokens(spark):
    df = spark.createDataFrame([(k,) for k in VECTORS], "t string")
    got = {r[0]: r[1] for r in df.select("t", T.tokens(F.col("t"))).collect()}
    assert got == VECTORS
    assert {k: T.py_tokens(k) for k in VECTORS} == VECTORS
    assert T.py_distinct_tokens("配置配置a A") == ["配置", "置配", "a"]
    assert spark.createDataFrame([("配置配置a A",)], "t string").select(T.distinct_tokens(F.col("t"))).first()[0] == ["配置", "置配", "a"]
    assert spark.createDataFrame([(None,)], "t string").select(T.tokens(F.col("t"))).first()[0] == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="aZ9_é配置カ゛ -.\n洞٣", max_size=12), min_size=1, max_size=20))
def test_token_twins(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.tokens(F.col("t"))).collect()] == [T.py_tokens(t) for t in texts]


STRICT = {
    "é10.0.0.1é 访问192.168.1.1和a@b.co": {"ip": ["10.0.0.1", "192.168.1.1"], "domain": ["b.co"], "email": ["a@b.co"], "url": [], "file_path": []},
    "见https://例.com/x/y。好 http://a.b/c?d=é": {"ip": [], "domain": [], "email": [], "url": ["https://例.com/x/y", "http://a.b/c?d"], "file_path": ["/x/y", "/a.b/c"]},
    "a_10.0.0.1 1.2.3.4.5 foo.bar-baz.io": {"ip": ["1.2.3.4"], "domain": ["foo.bar-baz.io"], "email": [], "url": [], "file_path": []},
    "d41d8cd98f00b204e9800998ecf8427e中 .x@y.org": {"ip": [], "domain": ["y.org"], "email": ["x@y.org"], "hash_md5": ["d41d8cd98f00b204e9800998ecf8427e"]},
}


def test_strict_formats(spark):
    for text, want in STRICT.items():
        df = spark.createDataFrame([(text,)], "t string")
        for kind, found in want.items():
            assert df.select(T.strict_matches(F.col("t"), kind)).first()[0] == found, (text, kind)
            assert [r for k, r, _ in T.strict_tokens(text) if k == kind] == found, (text, kind)
    kinds = [k for k, _, _ in T.strict_tokens("访问 192.168.1.1 和 example.com 或 user@mail.org")]
    assert {"ip", "domain", "email"} <= set(kinds) and T.has_strict("a.b.com") and not T.has_strict("plain words")


def test_small_text_functions(spark):
    assert T.human_bytes(10) == "10 B" and T.human_bytes(2048) == "2.0 KB"
    row = spark.createDataFrame([("ÀBCdef",)], "t string").select(T.ascii_lower(F.col("t")), T.contains_fold(F.col("t"), "bcd"), T.contains_fold(F.col("t"), ""), T.ellipsis(F.col("t"), 3), T.first_chars(F.col("t"), 2)).first()
    assert tuple(row) == ("Àbcdef", True, False, "ÀBC...", "ÀB")


def test_dot_path_and_values(spark):
    root = {"a": {"b": ["x", "y", "z"]}, "name": "n1", "l": [{"b": 1}]}
    assert [get_path(root, p) for p in ("name", "a.b.0", "a.b[1]", "l[0].b")] == ["n1", "x", "y", 1]
    assert all(get_path(root, p) is MISSING for p in ("missing", "a.missing", "", "a..b", "a.b[9]", "a.b[-1]", "a.b[x]", "a.b[1"))
    assert [stringify(v) for v in (None, "s", True, 1.0, 1e21, 0.1, 7, ["a", [1, None]], {"k": 1})] == ["", "s", "true", "1", "1000000000000000000000", "0.1", "7", "a 1 ", '{"k":1}']
    assert to_tags([" a ", "", 3]) == ["a", "3"] and to_tags(" x  y ") == ["x", "y"] and to_tags(5) is None
    df = spark.createDataFrame([("own", ["a", "b"]), ("", ["a"]), ("own", []), ("", None)], "f string, t array<string>")
    assert [r[0] for r in df.select(merge_tags(F.col("f"), F.col("t"))).collect()] == ["own a b", "a", "own", ""]
    assert df.select(split_words(F.lit(" a\tb \n c"))).first()[0] == ["a", "b", "c"]


GLOBS = {
    "**/*.json": ("a/b/c.json x.json", "c.txt"), "*.json": ("a.json", "a/b.json"), "docs/**/*.md": ("docs/x/y.md docs/z.md", "README.md"), "docs/*.md": ("docs/x.md", "docs/x/y.md"),
    "**/*.md": ("x.md", "x.mdx"), "**": ("any/thing", ""), "a/**": ("a a/b", "ab"), "?[ab].t": ("xa.t", "xc.t xab.t"), "./a.t": ("a.t", "b.t"),
}


@pytest.mark.parametrize("pattern", GLOBS)
def test_glob(pattern):
    good, bad = (x.split() for x in GLOBS[pattern])
    assert all(match_glob(pattern, n) for n in good) and not any(match_glob(pattern, n) for n in bad)


def test_hashes(spark):
    assert fnv64(b"") == 0xCBF29CE484222325 and fnv64(b"a") == 0xAF63DC4C8601EC8C
    texts = ["", "a", "abc", "配置", "a longer text"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(bucket_column(F.col("t"))).collect()] == [bucket(t.encode()) for t in texts]
    v = hash_embedding("Hello hello world")
    assert v.shape == (512,) and abs(np.linalg.norm(v) - 1) < 1e-6 and not hash_embedding("").any()


def test_snippets():
    assert snippets("", "q") == "" and snippets("abc", "") == "abc" and snippets("x" * 400, "q") == "x" * 300 + "..."
    assert query_words("洞 配置 Nginx nginx") == ["配置", "nginx"]
    assert snippets("The Nginx server, nginx!", "nginx") == "The 【Nginx】 server, 【nginx】!"
    long = "start alpha " + "x " * 200 + "alpha end " + "y " * 200 + "alpha last"
    got = snippets(long, "alpha", 2)
    assert got.count("【alpha】") == 2 and got.count(" ... ") == 1 and "last" in got and "start" in got
    # One occurrence inside a longer word hides a later one until it has been passed.
    assert highlight("alphabet alpha", ["alpha"]) == "alphabet alpha"
    # CJK neighbours are word letters, so an ideograph between others isn't marked.
    assert snippets("内 配置 外", "配置") == "内 【配置】 外" and "【" not in snippets("内配置外", "配置")
