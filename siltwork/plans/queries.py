"""The engine's operators over the driver's tables, each over a whole table, with the SQL they are held against.

The corpus is ``documents`` with the fields source (text, weight 3, the name), lang (text, weight 1) and text (long text,
weight 1, strict).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.extract import json_path, merge_tags
from ..functions.hashing import hash_embed
from ..functions.snippet import snippet_column
from ..operators import scoring as S
from ..operators.embedding import cache_misses
from ..operators.index import distinct_ids, doc_lengths, field_rows, field_stats, postings, term_frequencies
from ..schema import LONGTEXT, TEXT, CorpusSchema, Field
from ..sources.scan import glob_filter, glob_regex
from ..streaming.live import difference

CORPUS = CorpusSchema.of("documents", [Field("source", TEXT, 3, True, display=True), Field("lang", TEXT, 1, True, display=True), Field("text", LONGTEXT, 1, True, display=True, snippet=True, strict=True)], "source")
QUERY = "the thing of src1"
TERMS = T.py_distinct_tokens(QUERY)
STRICT_QUERY = "find 224.145.138.68 or src1.example.com in src1"
RERANK_TOP, TOP_K = 100, 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table over all cores: a file of one row group is one task otherwise. A table of more than ``SMALL``
    bytes for each core stays as it is read, so what is shuffled is bounded by the cluster, not by the data."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(_table(spark, sf_dir, "documents").select("doc_id", *CORPUS.names()))
    return d.select(F.col("doc_id").alias("idx"), *[F.coalesce(F.col(f.name), F.lit("")).alias(f"f{i}") for i, f in enumerate(CORPUS.fields)])


def _fields() -> list:
    return [(f.name, F.col(f"f{i}"), f.boost) for i, f in enumerate(CORPUS.fields)]


def tokenize_counts(spark, sf_dir):
    d = spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


def token_dedup(spark, sf_dir):
    d = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.md5(F.array_join(T.distinct_tokens(F.col("text")), " ")).alias("tokens"))


def cjk_tokens(spark, sf_dir):
    texts = ["Nginx配置", "PRODUCT-2024-001", "hello world", "Nginx 配置管理", "!!!", "测试abc测试", "单个字运行时: 洞 和 配置"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return df.select("t", F.array_join(T.tokens(F.col("t")), ",").alias("tokens"))


def _rows(spark, sf_dir):
    """The documents' fields, and whether no id occurs twice."""
    return field_rows(_items(spark, sf_dir), CORPUS), distinct_ids(_table(spark, sf_dir, "documents").select("doc_id"))


def build_postings(spark, sf_dir):
    return postings(*_rows(spark, sf_dir))


def doc_length(spark, sf_dir):
    return doc_lengths(*_rows(spark, sf_dir))


def build_field_stats(spark, sf_dir):
    n = _table(spark, sf_dir, "documents").count()
    s = field_stats(doc_length(spark, sf_dir), max(n, 1))
    return s.select("field", "n", F.round("avgdl", 6).alias("avgdl"))


def term_df(spark, sf_dir):
    return term_frequencies(*_rows(spark, sf_dir))


def bm25_field(spark, sf_dir):
    r = S.bm25_scan(_items(spark, sf_dir), TERMS, [_fields()[2]], ["idx"])
    return r.select(F.col("idx").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


def bm25_multi(spark, sf_dir):
    r = S.bm25_scan(_items(spark, sf_dir), TERMS, _fields(), ["idx"])
    return r.select(F.col("idx").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


def fast_search(spark, sf_dir):
    r = S.bm25_scan(_items(spark, sf_dir), TERMS, _fields(), ["idx"]).where("bm25 > 0")
    return r.orderBy(F.desc("bm25"), "idx").limit(TOP_K).select(F.col("idx").alias("doc_id"), F.round("bm25", 6).alias("score"))


def _query_vector(spark, sf_dir):
    # One row of a bounded dimension: the vector that is searched for.
    row = _table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else []


def dense_topk(spark, sf_dir):
    d = _table(spark, sf_dir, "embeddings").withColumn("s", S.dot(F.col("embedding"), _query_vector(spark, sf_dir)))
    return d.orderBy(F.desc("s"), "vec_id").limit(TOP_K).select("vec_id", F.round("s", 6).alias("score"))


def dense_weighted(spark, sf_dir):
    """Two fields (the vector, weight 3, and its first half, weight 1): the weighted mean of the dot products."""
    q = _query_vector(spark, sf_dir)
    half = len(q) // 2
    d = _table(spark, sf_dir, "embeddings")
    a, b = S.dot(F.col("embedding"), q), S.dot(F.slice("embedding", 1, max(1, half)), q[:half])
    return d.select("vec_id", F.round((a * 3 + b * 1) / 4, 6).alias("score"))


def phrase_boost(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("boost", S.phrase_boost(TERMS, [F.col(f"f{i}") for i in range(3)]))
    scored = S.bm25_scan(items, TERMS, _fields(), ["idx", "boost"])
    return scored.where("bm25 > 0").select(F.col("idx").alias("doc_id"), F.round("boost", 6).alias("boost"))


def name_match(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    q = "Cold Widget"
    return p.select("p_partkey", F.round(S.name_match(F.lower("p_name"), q, T.py_distinct_tokens(q)), 6).alias("score"))


def exact_prefix(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), "p_name")
    exact = S.exact_name(p, F.col("p_name"), "cold widget")
    return p.crossJoin(F.broadcast(exact)).select(F.col("idx").alias("p_partkey"), F.coalesce(F.col("idx") == F.col("exact_idx"), F.lit(False)).alias("exact"), S.prefix_match(F.lower("p_name"), "Cold").alias("prefix"))


def strict_extract(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    p = _table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("url").alias("text"))
    both = spread(d).unionByName(p)
    return both.select("origin", "id", *[F.array_join(F.array_distinct(T.strict_matches(F.col("text"), k)), " ").alias(k) for k in T.FORMATS])


def strict_boost(spark, sf_dir):
    boost, types = S.strict_boost(STRICT_QUERY, [(F.col(c) if c != "path" else F.lit(""), w) for c, w in S.strict_fields(CORPUS)])
    return _items(spark, sf_dir).select(F.col("idx").alias("doc_id"), F.round(boost, 6).alias("boost"), F.array_join(types, ",").alias("types"))


def minmax_normalize(spark, sf_dir):
    r = S.bm25_scan(_items(spark, sf_dir), TERMS, _fields(), ["idx"])
    both = r.crossJoin(F.broadcast(r.agg(F.min("bm25").alias("lo"), F.max("bm25").alias("hi"))))
    return both.select(F.col("idx").alias("doc_id"), F.round(S.normalised(F.col("bm25"), F.col("lo"), F.col("hi")), 6).alias("score"))


def _signals(spark, sf_dir):
    """All that is asked of the texts in one pass; what is kept for the aggregate and the scores is numbers."""
    phrase = S.phrase_boost(TERMS, [F.col(f"f{i}") for i in range(3)])
    boost, types = S.strict_boost(QUERY, [(F.col(c) if c != "path" else F.lit(""), w) for c, w in S.strict_fields(CORPUS)])
    lower = F.lower("f0")
    rows = _items(spark, sf_dir).withColumn("raw_phrase", phrase).withColumn("name", S.name_match(lower, QUERY, TERMS)).withColumn("strict", boost).withColumn("strict_types", types)
    rows = rows.withColumn("prefix", S.prefix_match(lower, QUERY)).withColumn("signal", S.rerank_signal(lower, F.col("f2"), TERMS, F.size("strict_types") > 0, []))
    scored = S.bm25_scan(rows, TERMS, _fields(), ["idx", "raw_phrase", "name", "strict", "prefix", "signal"])
    return scored.withColumn("phrase", F.when(F.col("bm25") > 0, F.col("raw_phrase")).otherwise(0.0)).withColumn("emb", F.lit(0.0)).withColumn("exact", F.lit(False))


def _best(spark, sf_dir):
    from ..schema import SearchOptions
    from .search import stage_one

    return stage_one(_signals(spark, sf_dir), SearchOptions(QUERY, rerank_top=RERANK_TOP))


def hybrid_stage1(spark, sf_dir):
    return _best(spark, sf_dir).select(F.col("idx").alias("doc_id"), F.round("stage1", 6).alias("stage1"))


def rerank_signal(spark, sf_dir):
    return _best(spark, sf_dir).select(F.col("idx").alias("doc_id"), F.round("signal", 6).alias("signal"))


def search_topk(spark, sf_dir):
    """The whole search: signals, normalisation, fusion, the first stage's top, reranking, the top."""
    rows = _best(spark, sf_dir)
    both = rows.crossJoin(F.broadcast(rows.agg(F.min("signal").alias("lo"), F.max("signal").alias("hi"))))
    score = F.lit(0.8) * F.col("stage1") + F.lit(0.2) * S.normalised(F.col("signal"), F.col("lo"), F.col("hi"))
    return both.withColumn("score", score).orderBy(F.desc("score"), "idx").limit(TOP_K).select(F.col("idx").alias("doc_id"), F.round("score", 6).alias("score"))


def field_restriction(spark, sf_dir):
    able = {f.name: i for i, f in enumerate(CORPUS.fields)}
    chosen = S.resolve_fields(CORPUS, ["lang", "nothing", "source"], "searchable")
    r = S.bm25_scan(_items(spark, sf_dir), ["src1", "en"], [(f.name, F.col(f"f{able[f.name]}"), f.boost) for f in chosen], ["idx"])
    return r.select(F.col("idx").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


def hash_embeddings(spark, sf_dir):
    """The buckets of each text that aren't zero."""
    d = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    vec = d.select("doc_id", F.posexplode(hash_embed(F.coalesce(F.col("text"), F.lit("")))).alias("bucket", "x"))
    return vec.where("x <> 0").select("doc_id", "bucket", F.round(F.col("x").cast("double"), 6).alias("value"))


def snippet_hits(spark, sf_dir):
    top = fast_search(spark, sf_dir)
    rows = _table(spark, sf_dir, "documents").join(F.broadcast(top), "doc_id")
    return rows.select("doc_id", snippet_column([("text", F.col("text"))], QUERY).alias("snippet"))


DOT_PATHS = {"k": "props.k", "key": "more.0.b", "place": "list[1].x", "number": "list.0", "deep": "list[1].y[1][0]", "none": "props.missing.x", "beyond": "list[9]", "empty": "props..k"}


def dot_path(spark, sf_dir):
    """Paths into maps and lists: by key, by place, a number as either, lists in lists; what isn't there; an empty part."""
    e = _table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    row = F.struct(F.from_json("props", "k bigint").alias("props"), F.struct(F.struct(user.alias("b")).alias("0")).alias("more"))
    pair = F.struct(F.col("event_type").alias("x"), F.array(F.array(user), F.array(F.col("event_type"), user)).alias("y"))
    whole = F.concat(F.expr("substring(j, 1, length(j) - 1)"), F.lit(',"list":["'), user, F.lit('",'), F.to_json(pair), F.lit("]}"))
    d = e.withColumn("j", F.to_json(row)).withColumn("j", whole)
    return d.select("event_id", *[json_path(F.col("j"), p).alias(n) for n, p in DOT_PATHS.items()])


def tags_merge(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    return p.select("p_partkey", merge_tags(F.col("p_name"), F.split(F.lower("p_type"), " ")).alias("tags"))


GLOB = "en/**/*"


def glob_filter_pages(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]+/", ""), r"[?#].*$", "")
    return _table(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(glob_filter(F.col("path"), GLOB))


def _keys(df):
    return df.select(F.substring(F.coalesce("text", F.lit("")), 1, CORPUS.embed_chars()).alias("text")).withColumn("key", F.md5("text"))


def embed_cache_misses(spark, sf_dir):
    """The cache holds the texts of the source src0; what is missing is encoded once for each distinct text."""
    d = _table(spark, sf_dir, "documents")
    cache = _keys(d.where("source = 'src0'")).select("key").distinct()
    return cache_misses(_keys(d), cache).select("key", F.length("text").cast("bigint").alias("n_chars"))


def embed_cache_prune(spark, sf_dir):
    """What stays in a cache of all texts when only the documents in French are left."""
    d = _table(spark, sf_dir, "documents")
    return _keys(d).select("key").distinct().join(_keys(d.where("lang = 'fr'")).select("key"), "key", "left_semi")


def source_diff(spark, sf_dir):
    """Two listings of the documents: in the second src1 is gone, src2 new and every source's sizes from 5000 letters on differ."""
    d = _table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id")).alias("path"), F.col("n_chars").alias("size"), "source")
    before = d.where("source <> 'src2'").select("path", "size")
    after = d.where("source <> 'src1'").select("path", F.when(F.col("size") >= 5000, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return difference(before, after)


QUERIES = {
    "tokenize_counts": tokenize_counts, "token_dedup": token_dedup, "cjk_tokens": cjk_tokens, "postings": build_postings, "doc_length": doc_length,
    "field_stats": build_field_stats, "term_df": term_df, "bm25_field": bm25_field, "bm25_multi": bm25_multi, "fast_search": fast_search,
    "dense_topk": dense_topk, "dense_weighted": dense_weighted, "phrase_boost": phrase_boost, "name_match": name_match, "exact_prefix": exact_prefix,
    "strict_extract": strict_extract, "strict_boost": strict_boost, "minmax_normalize": minmax_normalize, "hybrid_stage1": hybrid_stage1,
    "rerank_signal": rerank_signal, "search_topk": search_topk, "field_restriction": field_restriction, "hash_embed": hash_embeddings, "snippet": snippet_hits,
    "dot_path": dot_path, "tags_merge": tags_merge, "glob_filter": glob_filter_pages, "embed_cache_misses": embed_cache_misses,
    "embed_cache_prune": embed_cache_prune, "source_diff": source_diff,
}

# ---- SQL ----

_TOK = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\p{{L}}\\p{{Nd}}_]+')"


def _tok(col: str) -> str:
    return _TOK.format(col)


_FIELDS = "SELECT doc_id AS idx, 'source' AS field, source AS text FROM documents UNION ALL SELECT doc_id, 'lang', lang FROM documents UNION ALL SELECT doc_id, 'text', text FROM documents"
_POST = f"SELECT idx, field, term, count(*) AS tf FROM (SELECT idx, field, unnest({_tok('text')}) AS term FROM ({_FIELDS})) GROUP BY ALL"
_LEN = f"SELECT idx, field, count(*) AS dl FROM ({_POST}) GROUP BY ALL"
_STATS = f"SELECT field, (SELECT count(*) FROM documents) AS n, sum(dl) / (SELECT CAST(count(*) AS DOUBLE) FROM documents) AS avgdl FROM ({_LEN}) GROUP BY field"


def _bm25(terms: list[str], weights: dict[str, float]) -> str:
    """(doc_id, bm25) of all documents."""
    quoted = ", ".join(f"'{t}'" for t in terms)
    names = ", ".join(f"'{f}'" for f in weights)
    w = "CASE field " + " ".join(f"WHEN '{f}' THEN CAST({x} AS DOUBLE)" for f, x in weights.items()) + " END"
    return f"""
WITH post AS MATERIALIZED ({_POST}), len AS (SELECT idx, field, count(*) AS dl FROM post GROUP BY ALL),
stats AS (SELECT field, (SELECT CAST(count(*) AS DOUBLE) FROM documents) AS n, sum(dl) / (SELECT CAST(count(*) AS DOUBLE) FROM documents) AS avgdl FROM len GROUP BY field),
hit AS (SELECT * FROM post WHERE term IN ({quoted}) AND field IN ({names})),
freq AS (SELECT term, field, CAST(count(*) AS DOUBLE) AS df FROM hit GROUP BY ALL),
part AS (SELECT idx, {w} * ln((n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)) + 1) * (tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))) AS s
  FROM hit JOIN freq USING (term, field) JOIN stats USING (field) JOIN len USING (idx, field)),
score AS (SELECT doc_id, coalesce(sum(s), CAST(0 AS DOUBLE)) AS bm25 FROM documents LEFT JOIN part ON doc_id = idx GROUP BY doc_id)"""


_WEIGHTS = {f.name: f.boost for f in CORPUS.fields}
_MULTI = _bm25(TERMS, _WEIGHTS)


def _case(cond: str, x: float) -> str:
    return f"(CASE WHEN {cond} THEN CAST({x} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"


def _contains(col: str, s: str) -> str:
    return f"contains({col}, '{s}')"


def _fold(col: str) -> str:
    return f"translate(coalesce({col}, ''), '{T.UPPER}', '{T.LOWER}')"


_PHRASE = " + ".join(_case(_contains(_fold(c), p), x) for p, x in S.phrases(TERMS) for c in ("source", "lang", "text"))


def _name(col: str, query: str) -> str:
    return " + ".join([_case(_contains(col, query.lower()), 0.5)] + [_case(_contains(col, t), 0.3) for t in T.py_distinct_tokens(query) if len(t.encode()) >= 2])


def _strict(query: str) -> tuple[str, str]:
    boosts, types = [], []
    for kind, raw, norm in T.strict_tokens(query):
        own = f"({_case(_contains('text', raw), 0.15)} + {_case(_contains('source', raw), 0.3)})"
        whole = "lower(text || '  ' || source)" if kind.startswith("hash") or kind == "domain" else "''"
        loose = _contains(whole, norm)
        boosts += [own, _case(loose, 0.2)]
        types.append(f"CASE WHEN {own} > 0 OR {loose} THEN '{kind}' END")
    return " + ".join(boosts) or "CAST(0 AS DOUBLE)", f"concat_ws(',', {', '.join(types)})" if types else "''"


_NORM = "CASE WHEN max({0}) OVER () = min({0}) OVER () THEN {0} ELSE ({0} - min({0}) OVER ()) / (max({0}) OVER () - min({0}) OVER ()) END"
_STAGE = _MULTI + f""",
raw AS (SELECT doc_id, source, text, bm25, CASE WHEN bm25 > 0 THEN {_PHRASE} ELSE CAST(0 AS DOUBLE) END AS phrase, {_name('lower(source)', QUERY)} AS name, starts_with(lower(source), '{QUERY.lower()}') AS prefix FROM score JOIN documents USING (doc_id)),
normed AS (SELECT doc_id, source, text, prefix, {_NORM.format('bm25')} AS b, {_NORM.format('phrase')} AS p, {_NORM.format('name')} AS n FROM raw),
best AS (SELECT doc_id, source, text, CAST(0.4 AS DOUBLE) * b + CAST(0.1 AS DOUBLE) * p + CAST(0.25 AS DOUBLE) * n + {_case('prefix', 0.1)} AS stage1 FROM normed ORDER BY stage1 DESC, doc_id LIMIT {RERANK_TOP})"""
_N = len(TERMS)
_SIGNAL = (
    f"CAST({0.4 / _N!r} AS DOUBLE) * (" + " + ".join(_case(_contains("lower(source)", t), 1) for t in TERMS) + ") + CAST(0.3 AS DOUBLE) * (" + " + ".join(_case(_contains("lower(source)", a + b), 1) for a, b in zip(TERMS, TERMS[1:]))
    + f") + CAST({0.3 / _N!r} AS DOUBLE) * (" + " + ".join(_case(_contains("lower(text)", t), 1) for t in TERMS if len(t.encode()) >= 2) + ")"
)
_RERANK = _STAGE + f", sig AS (SELECT doc_id, stage1, {_SIGNAL} AS signal FROM best)"


def _re2(pattern: str) -> str:
    return pattern.replace(T.EDGE, r"\b").replace("'", "''")


_EXTRACT = ", ".join(f"array_to_string(list_filter(l_{k}, lambda x, i: list_position(l_{k}, x) = i), ' ') AS {k}" for k in T.FORMATS)
_LISTS = ", ".join(f"regexp_extract_all(coalesce(text, ''), '{_re2(p)}') AS l_{k}" for k, p in T.FORMATS.items())
_DOT = "list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), lambda a, b: a + b)"
_VEC0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_KEY = "SELECT left(coalesce(text, ''), 512) AS t, source, lang FROM documents"

_FNV = "list_reduce(list_prepend(CAST({h} AS BIGINT), list_transform(regexp_extract_all(hex(encode({s})), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
_EMBED = f"""
WITH d AS MATERIALIZED (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM d),
tri AS (SELECT doc_id, unnest(b[:-3]) AS x, unnest(b[2:-2]) AS y, unnest(b[3:]) AS z FROM bytes WHERE len(b) > 2),
three AS (SELECT doc_id, (xor((xor((xor(2166136261, x) * 16777619) & 4294967295, y) * 16777619) & 4294967295, z) * 16777619) & 4294967295 AS h, 1 AS w FROM tri),
words AS (SELECT doc_id, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS ws FROM d),
singles AS (SELECT doc_id, unnest(ws) AS s FROM words), pairs AS (SELECT doc_id, unnest(ws[:-2]) || ' ' || unnest(ws[2:]) AS s FROM words WHERE len(ws) > 1),
names AS MATERIALIZED (SELECT s, {_FNV.format(h=2166136261, s='s')} AS h FROM (SELECT s FROM singles UNION SELECT s FROM pairs)),
found AS (SELECT * FROM three UNION ALL SELECT doc_id, h, 2 FROM singles JOIN names USING (s) WHERE strlen(s) >= 2 UNION ALL SELECT doc_id, h, 3 FROM pairs JOIN names USING (s)),
sums AS (SELECT doc_id, CAST(h % 512 AS INT) AS bucket, CAST(sum(w) AS DOUBLE) AS c FROM found GROUP BY ALL)
SELECT doc_id, bucket, round(CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 6) AS value FROM sums"""

SQL = {
    "tokenize_counts": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)",
    "token_dedup": f"SELECT doc_id, md5(coalesce(string_agg(x, ' ' ORDER BY i), '')) AS tokens FROM documents LEFT JOIN (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(t) AS x, unnest(range(len(t))) AS i FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)) GROUP BY ALL) USING (doc_id) GROUP BY doc_id",
    "cjk_tokens": "SELECT * FROM (VALUES ('Nginx配置', 'nginx,配置'), ('PRODUCT-2024-001', 'product,2024,001'), ('hello world', 'hello,world'), ('Nginx 配置管理', 'nginx,配置,置管,管理'), ('!!!', ''), ('测试abc测试', '测试,abc,测试'), ('单个字运行时: 洞 和 配置', '单个,个字,字运,运行,行时,洞,和,配置')) AS v(t, tokens)",
    "postings": f"SELECT idx, field, term, tf, count(*) OVER (PARTITION BY idx, field) AS dl FROM ({_POST})",
    "doc_length": _LEN,
    "field_stats": f"SELECT field, n, round(avgdl, 6) AS avgdl FROM ({_STATS})",
    "term_df": f"SELECT term, field, count(*) AS df FROM ({_POST}) GROUP BY ALL",
    "bm25_field": _bm25(TERMS, {"text": 1.0}) + " SELECT doc_id, round(bm25, 6) AS bm25 FROM score",
    "bm25_multi": _MULTI + " SELECT doc_id, round(bm25, 6) AS bm25 FROM score",
    "bm25_postings": _MULTI + " SELECT doc_id, round(bm25, 6) AS bm25 FROM score WHERE doc_id IN (SELECT idx FROM part)",
    "fast_search": _MULTI + f" SELECT doc_id, round(bm25, 6) AS score FROM (SELECT * FROM score WHERE bm25 > 0 ORDER BY bm25 DESC, doc_id LIMIT {TOP_K})",
    "dense_topk": f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_DOT.format('embedding', _VEC0)} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT {TOP_K})",
    "dense_weighted": f"SELECT vec_id, round(({_DOT.format('embedding', 'q')} * 3 + {_DOT.format('embedding[1:len(q) // 2]', 'q[1:len(q) // 2]')} * 1) / 4, 6) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)",
    "phrase_boost": _MULTI + f" SELECT doc_id, round({_PHRASE}, 6) AS boost FROM score JOIN documents USING (doc_id) WHERE bm25 > 0",
    "name_match": f"SELECT p_partkey, round({_name('lower(p_name)', 'Cold Widget')}, 6) AS score FROM part",
    "exact_prefix": "SELECT p_partkey, coalesce(p_partkey = (SELECT min(p_partkey) FROM part WHERE p_name = 'cold widget'), false) AS exact, starts_with(lower(p_name), 'cold') AS prefix FROM part",
    "strict_extract": f"SELECT origin, id, {_EXTRACT} FROM (SELECT origin, id, {_LISTS} FROM (SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, url FROM pages))",
    "strict_boost": "SELECT doc_id, round({0}, 6) AS boost, {1} AS types FROM documents".format(*_strict(STRICT_QUERY)),
    "minmax_normalize": _MULTI + f" SELECT doc_id, round({_NORM.format('bm25')}, 6) AS score FROM score",
    "hybrid_stage1": _STAGE + " SELECT doc_id, round(stage1, 6) AS stage1 FROM best",
    "rerank_signal": _RERANK + " SELECT doc_id, round(signal, 6) AS signal FROM sig",
    "search_topk": _RERANK + f", fin AS (SELECT doc_id, CAST(0.8 AS DOUBLE) * stage1 + CAST(0.2 AS DOUBLE) * ({_NORM.format('signal')}) AS score FROM sig) SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM fin ORDER BY score DESC, doc_id LIMIT {TOP_K})",
    "field_restriction": _bm25(["src1", "en"], {"lang": 1.0, "source": 3.0}) + " SELECT doc_id, round(bm25, 6) AS bm25 FROM score",
    "dot_path": "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(user_id AS VARCHAR) AS key, event_type AS place, CAST(user_id AS VARCHAR) AS number, event_type AS deep, CAST(NULL AS VARCHAR) AS none, CAST(NULL AS VARCHAR) AS beyond, CAST(NULL AS VARCHAR) AS empty FROM events",
    "hash_embed": _EMBED,
    "tags_merge": "SELECT p_partkey, p_name || ' ' || lower(p_type) AS tags FROM part",
    "glob_filter": f"SELECT page_id, path FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[?#].*$', '') AS path FROM pages) WHERE regexp_matches(path, '{glob_regex(GLOB)}')",
    "embed_cache_misses": f"SELECT md5(t) AS key, CAST(length(t) AS BIGINT) AS n_chars FROM (SELECT DISTINCT t FROM ({_KEY})) WHERE t NOT IN (SELECT t FROM ({_KEY}) WHERE source = 'src0')",
    "embed_cache_prune": f"SELECT DISTINCT md5(t) AS key FROM ({_KEY}) WHERE t IN (SELECT t FROM ({_KEY}) WHERE lang = 'fr')",
    "source_diff": """WITH d AS (SELECT source || '/' || doc_id AS path, n_chars AS size, source FROM documents),
a AS (SELECT path, size FROM d WHERE source <> 'src2'), b AS (SELECT path, CASE WHEN size >= 5000 THEN size + 1 ELSE size END AS size FROM d WHERE source <> 'src1')
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size""",
}
