"""Queries over indexes and files: searches by way of :mod:`.search`, an index that is stored and read back, and every source format.

Three corpora: ``documents`` as in :mod:`.queries`, stored; ``documents`` with vectors for its texts; ``part`` with names that
can be matched exactly, tags and vectors. The vectors are those of ``embeddings`` with the same id; the query's vector is
that of id 0.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from ..operators import scoring as S
from ..operators.index import Index, build_index, index_of, load_index
from ..schema import LONGTEXT, TAGS, TEXT, CorpusSchema, Field, SearchOptions
from ..sources.scan import parse_config, scan
from . import queries as Q
from .search import fast_search, search

PARTS = CorpusSchema.of("parts", [Field("name", TEXT, 5, True, True, True), Field("brand", TEXT, 1, True, display=True), Field("kind", LONGTEXT, 2, True, True, True, True), Field("labels", TAGS, 3, True, display=True)], "name")
PAPERS = CorpusSchema.of("papers", [Field("source", TEXT, 3, True, display=True), Field("lang", TEXT, 1, True, display=True), Field("text", LONGTEXT, 1, True, True, strict=True)], "source")
PART_QUERY = "cold widget"


class VectorOf:
    """An encoder that has one query vector: that of a row of a table."""

    name = "row"

    def __init__(self, vector: list[float]):
        self.vector, self.dim = vector, len(vector)

    def encode(self, text: str):
        import numpy as np

        return np.array(self.vector, np.float64)


def _vectors(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    return Q._table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.lit(field).alias("field"), F.col("embedding").alias("vec"))


def part_index(spark: SparkSession, sf_dir: str) -> Index:
    p = Q._table(spark, sf_dir, "part")
    tags = F.split(F.lower("p_type"), " ")
    items = p.select(F.col("p_partkey").alias("idx"), F.concat(F.lit("part/"), F.col("p_partkey")).alias("id"), F.lit("").alias("path"), F.lit("stock").alias("source"), tags.alias("tags"), F.col("p_name").alias("f0"), F.col("p_brand").alias("f1"), F.col("p_type").alias("f2"), F.array_join(tags, " ").alias("f3"))
    return index_of(items, PARTS, VectorOf(Q._query_vector(spark, sf_dir)), _vectors(spark, sf_dir, "name"))


def paper_index(spark: SparkSession, sf_dir: str) -> Index:
    items = Q._items(spark, sf_dir).withColumns({"id": F.concat(F.lit("doc/"), F.col("idx")), "path": F.lit(""), "source": F.lit("web"), "tags": F.array().cast("array<string>")})
    return index_of(items, PAPERS, VectorOf(Q._query_vector(spark, sf_dir)), _vectors(spark, sf_dir, "text"))


def _hits(df: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return df.select("id", r("score"), r("bm25"), r("emb"), "exact", "prefix", F.array_join("strict", ",").alias("strict"), F.array_join("tags", " ").alias("tags"), F.to_json("fields").alias("fields"), "snippet")


def search_exact(spark, sf_dir):
    """BM25, vectors, phrase, name, exact name and prefix; displayed fields, tags, snippets."""
    return _hits(search(part_index(spark, sf_dir), SearchOptions(PART_QUERY)))


def search_strict(spark, sf_dir):
    """BM25, vectors, phrase, name and fixed formats over whole texts."""
    return _hits(search(paper_index(spark, sf_dir), SearchOptions(Q.STRICT_QUERY))).drop("snippet", "fields", "tags")


def dense_fields(spark, sf_dir):
    """The weighted mean over two embeddable fields, of which one has vectors."""
    ix = part_index(spark, sf_dir)
    got = S.dense(ix, ix.encoder.vector, PARTS.embeddable())
    return got.select("idx", F.round("emb", 6).alias("emb"))


_stored: dict[tuple[str, str], str] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> Index:
    """``documents`` as an index that is built once a session, and read back."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stored:
        path = storage.temporary(spark, "index")
        d = Q.spread(Q._table(spark, sf_dir, "documents").select("doc_id", *Q.CORPUS.names()))
        fields = F.create_map(*[x for f in Q.CORPUS.names() for x in (F.lit(f), F.coalesce(F.col(f), F.lit("")))])
        # Items are numbered in the order of their paths.
        items = d.select(F.col("doc_id").cast("string").alias("id"), F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("path"), F.lit("web").alias("source"), F.array().cast("array<string>").alias("tags"), fields.alias("fields"))
        items = items.withColumns({"source_no": F.lit(0), "row_no": F.lit(0)})
        build_index(items, Q.CORPUS, path)
        _stored[key] = path
    return load_index(spark, _stored[key])


def bm25_postings(spark, sf_dir):
    """BM25 from a stored index: of the postings only the query's terms are read."""
    ix = stored_index(spark, sf_dir)
    scored = S.bm25(ix, Q.TERMS, Q.CORPUS.searchable()).join(ix.items.select("idx", "id"), "idx")
    return scored.select(F.col("id").cast("bigint").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


def fast_search_stored(spark, sf_dir):
    """:func:`fast_search` itself, on the stored index."""
    got = fast_search(stored_index(spark, sf_dir), Q.QUERY, Q.TOP_K)
    return got.select(F.col("path").cast("bigint").alias("doc_id"), "name", F.round("score", 6).alias("score"))


# ---- sources ----

CONFIG = """
schema:
  name: sources
  fields:
    - {{name: title, type: text, searchable: true}}
    - {{name: body, type: longtext, searchable: true}}
    - {{name: keys, type: tags, searchable: true}}
sources:
  - {{dir: "{dir}", format: {format}, include: "**/*", mapping: {{title: "{title}", body: "{body}", keys: "{keys}"}}}}
"""


def _write(df: DataFrame, line: F.Column, name: str, one_file_each: bool) -> str:
    """Texts as files below a temporary folder: one for each row, or as many rows in a file as Spark puts there."""
    spark = df.sparkSession
    path = storage.temporary(spark, f"source-{name}")
    rows = df.select("key", line.alias("value"))
    (rows.write.partitionBy("key") if one_file_each else rows.drop("key").coalesce(1).write).text(path)
    storage.delete(spark, f"{path}/_SUCCESS")
    return path


def _read(spark: SparkSession, path: str, fmt: str, title: str, body: str, keys: str) -> DataFrame:
    cfg = parse_config(CONFIG.format(dir=path, format=fmt, title=title, body=body, keys=keys))
    got = scan(spark, cfg).where("error IS NULL")
    return got.select(F.col("fields")["title"].alias("title"), F.trim(F.col("fields")["body"], F.lit("\n")).alias("body"), F.array_join("tags", ",").alias("tags"))


def _nations(spark, sf_dir):
    return Q._table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("title"), F.col("n_regionkey").alias("region"))


def source_json(spark, sf_dir):
    """One JSON file for each nation, with nested paths."""
    d = _nations(spark, sf_dir)
    line = F.to_json(F.struct(F.struct(F.col("title").alias("name")).alias("head"), F.array(F.struct(F.col("region").alias("no")), F.struct(F.col("key").alias("no"))).alias("list"), F.array(F.lit("a"), F.lower("title")).alias("keys")))
    return _read(spark, _write(d, line, "json", True), "json", "head.name", "list[1].no", "keys")


def source_yaml(spark, sf_dir):
    d = _nations(spark, sf_dir)
    line = F.concat(F.lit("head:\n  name: '"), "title", F.lit("'\nlist:\n  - nr: "), F.col("region"), F.lit("\n  - nr: "), F.col("key"), F.lit("\nkeys: [a, '"), F.lower("title"), F.lit("']"))
    return _read(spark, _write(d, line, "yaml", True), "yaml", "head.name", "list.1.nr", "keys")


def source_frontmatter(spark, sf_dir):
    d = _nations(spark, sf_dir)
    line = F.concat(F.lit("---\ntitle: '"), "title", F.lit("'\nkeys: a "), F.lower(F.translate("title", " ", "-")), F.lit("\n---\n\n# no "), F.col("key"), F.lit("\nlies in "), F.col("region"))
    return _read(spark, _write(d, line, "frontmatter", True), "frontmatter", "title", "__body__", "keys")


def source_text(spark, sf_dir):
    d = _nations(spark, sf_dir)
    return _read(spark, _write(d, F.concat("title", F.lit("\nno "), F.col("key")), "text", True), "text", "none", "__body__", "none")


def _parts(spark, sf_dir):
    return Q._table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), F.col("p_type").alias("body"), F.col("p_brand").alias("brand"))


def source_csv(spark, sf_dir):
    """Rows by a heading, by a position, with quoted commas; a line is an item."""
    d = _parts(spark, sf_dir)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit(' ""x"", y"'))
    line = F.concat_ws(",", quoted(F.col("title")), F.col("body"), F.concat(F.col("brand"), F.lit(" k"), F.col("key")))
    head = spark.createDataFrame([(0, "name,  kind ,keys")], "key int, value string")
    rows = head.select(F.lit(0).alias("o"), "value").unionByName(d.select(F.lit(1).alias("o"), line.alias("value"))).orderBy("o")
    path = storage.temporary(spark, "source-csv")
    rows.coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    storage.delete(spark, f"{path}/_SUCCESS")
    return _read(spark, path, "csv", "name", "1", "keys")


def source_ndjson(spark, sf_dir):
    d = _parts(spark, sf_dir)
    line = F.to_json(F.struct("title", F.struct(F.array("body").alias("b")).alias("a"), F.array("brand", F.col("key").cast("string")).alias("keys")))
    return _read(spark, _write(d, line, "ndjson", False), "ndjson", "title", "a.b.0", "keys")


def source_xlsx(spark, sf_dir):
    """A workbook of the nations (25 rows, whatever the scale): shared, inline and number cells."""
    rows = sorted(tuple(r) for r in _nations(spark, sf_dir).collect())
    shared = ["name", "no", "keys", *(r[1] for r in rows)]
    cell = lambda ref, kind, x: f'<c r="{ref}" t="inlineStr"><is><t>{escape(x)}</t></is></c>' if kind == "i" else f'<c r="{ref}"' + (' t="s"' if kind == "s" else "") + f"><v>{x}</v></c>"
    body = ['<row r="1">' + "".join(cell(f"{c}1", "s", k) for k, c in enumerate("ABD")) + "</row>"]
    for n, (key, name, _) in enumerate(rows):
        body.append(f'<row r="{n + 2}">' + cell(f"A{n + 2}", "s", n + 3) + cell(f"B{n + 2}", "n", key) + cell(f"D{n + 2}", "i", f"a {name.lower().replace(' ', '-')}") + "</row>")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{escape(x)}</t></si>" for x in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{''.join(body)}</sheetData></worksheet>")
    path = storage.temporary(spark, "source-xlsx")
    storage.make_folder(spark, path)
    storage.write_bytes(spark, f"{path}/nations.xlsx", buffer.getvalue())
    return _read(spark, path, "xlsx", "name", "no", "keys")


QUERIES = {
    "search_exact": search_exact, "search_strict": search_strict, "dense_fields": dense_fields, "bm25_postings": bm25_postings, "fast_search_stored": fast_search_stored,
    "source_json": source_json, "source_yaml": source_yaml, "source_frontmatter": source_frontmatter, "source_text": source_text, "source_csv": source_csv,
    "source_ndjson": source_ndjson, "source_xlsx": source_xlsx,
}


# ---- SQL ----


def _search_sql(table: str, key: str, fields: dict[str, float], name: str, desc: str, strict: str, strict_types: str, query: str, embed: dict[str, float], vec_field: str, out: str) -> str:
    """A whole search over a table: signals of all rows, normalised, fused, the best 100, reranked, the best 10."""
    terms = T.py_distinct_tokens(query)
    o = SearchOptions(query).resolved()
    rows = " UNION ALL ".join(f"SELECT {key} AS idx, '{f}' AS field, {f} AS text FROM base" for f in fields)
    w = "CASE field " + " ".join(f"WHEN '{f}' THEN CAST({x} AS DOUBLE)" for f, x in fields.items()) + " END"
    quoted = ", ".join(f"'{t}'" for t in terms)
    zero = "CAST(0 AS DOUBLE)"
    phrase = " + ".join(Q._case(Q._contains(Q._fold(f), p), x) for p, x in S.phrases(terms) for f in fields) or zero
    norm = Q._NORM.format
    dot = Q._DOT.format("embedding", Q._VEC0)
    signal = [f"CAST({0.4 / len(terms)!r} AS DOUBLE) * (" + " + ".join(Q._case(Q._contains(f"lower({name})", t), 1) for t in terms) + ")"]
    signal.append("CAST(0.3 AS DOUBLE) * (" + (" + ".join(Q._case(Q._contains(f"lower({name})", a + b), 1) for a, b in zip(terms, terms[1:])) or zero) + ")")
    signal.append(f"CAST({0.3 / len(terms)!r} AS DOUBLE) * (" + (" + ".join(Q._case(Q._contains(f"lower({desc})", t), 1) for t in terms if len(t.encode()) >= 2) or zero) + ")")
    signal.append(Q._case("strict_types <> ''", 0.5))
    signal.append(f"CAST({0.3 / len(embed)!r} AS DOUBLE) * (" + " + ".join(f"({'sim' if f == vec_field else zero} + 1) / 2" for f in embed) + ")")
    return f"""
WITH base AS MATERIALIZED ({table}), total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM base),
post AS MATERIALIZED (SELECT idx, field, term, count(*) AS tf FROM (SELECT idx, field, unnest({Q._tok('text')}) AS term FROM ({rows})) GROUP BY ALL),
len AS (SELECT idx, field, count(*) AS dl FROM post GROUP BY ALL), stats AS (SELECT field, n, sum(dl) / n AS avgdl FROM len, total GROUP BY field, n),
hit AS (SELECT * FROM post WHERE term IN ({quoted})), freq AS (SELECT term, field, CAST(count(*) AS DOUBLE) AS df FROM hit GROUP BY ALL),
points AS (SELECT idx, {w} * ln((n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)) + 1) * (tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))) AS s
  FROM hit JOIN freq USING (term, field) JOIN stats USING (field) JOIN len USING (idx, field)),
score AS (SELECT idx, list_reduce(list_prepend({zero}, list_sort(list(s))), lambda a, b: a + b) AS bm25 FROM points GROUP BY idx),
vecs AS (SELECT vec_id AS idx, {dot} AS sim FROM embeddings),
raw AS (SELECT base.*, coalesce(bm25, {zero}) AS bm25, coalesce(sim, {zero}) AS sim, coalesce(sim * CAST({embed[vec_field]} AS DOUBLE) / CAST({sum(embed.values())} AS DOUBLE), {zero}) AS emb,
  CASE WHEN bm25 > 0 THEN {phrase} ELSE {zero} END AS phrase, {Q._name(f'lower({name})', query)} AS named, {strict} AS strict, {strict_types} AS strict_types,
  starts_with(lower({name}), '{query.lower()}') AS prefix, coalesce({key} = (SELECT min({key}) FROM base WHERE {name} = '{query}'), false) AS exact
  FROM base LEFT JOIN score ON {key} = score.idx LEFT JOIN vecs ON {key} = vecs.idx),
normed AS (SELECT *, {norm('bm25')} AS b, {norm('emb')} AS e, {norm('phrase')} AS p, {norm('named')} AS n, {norm('strict')} AS t FROM raw),
best AS (SELECT *, CAST({o.w_bm25} AS DOUBLE) * b + CAST({o.w_emb} AS DOUBLE) * e + CAST({o.w_phrase} AS DOUBLE) * p + CAST(0.25 AS DOUBLE) * n + CASE WHEN t > 0 THEN CAST({o.w_strict} AS DOUBLE) * t ELSE {zero} END
  + CASE WHEN exact THEN CAST({o.w_exact} AS DOUBLE) WHEN prefix THEN CAST({o.w_prefix} AS DOUBLE) ELSE {zero} END AS stage1 FROM normed ORDER BY stage1 DESC, {key} LIMIT {o.rerank_top}),
sig AS (SELECT *, {' + '.join(signal)} AS signal FROM best),
fin AS (SELECT *, CAST({1 - o.w_rerank!r} AS DOUBLE) * stage1 + CAST({o.w_rerank} AS DOUBLE) * ({norm('signal')}) AS final FROM sig)
SELECT {out} FROM (SELECT * FROM fin ORDER BY final DESC, {key} LIMIT {o.top_k})"""


_NUMBERS = "round(final, 6) AS score, round(bm25, 6) AS bm25, round(emb, 6) AS emb, exact, prefix, strict_types AS strict"
_PART = "SELECT CAST(p_partkey AS BIGINT) AS key, p_name AS name, p_brand AS brand, p_type AS kind, lower(p_type) AS labels FROM part"
_DOC = "SELECT doc_id AS key, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents"
_NATION = "SELECT n_name AS title, {body} AS body, {tags} AS tags FROM nation"


def _marked(col: str) -> str:
    return f"regexp_replace({col}, '(?i)\\b({'|'.join(PART_QUERY.split())})\\b', '【\\1】', 'g')"


SQL = {
    "search_exact": _search_sql(_PART, "key", {f.name: f.boost for f in PARTS.fields}, "name", "kind", "CAST(0 AS DOUBLE)", "''", PART_QUERY, {"name": 5.0, "kind": 2.0}, "name", f"'part/' || key AS id, {_NUMBERS}, labels AS tags, to_json(struct_pack(name := name, brand := brand, kind := kind, labels := labels))::VARCHAR AS fields, '[kind] ' || {_marked('kind')} AS snippet"),
    "search_strict": _search_sql(_DOC, "key", {"source": 3.0, "lang": 1.0, "text": 1.0}, "source", "text", *Q._strict(Q.STRICT_QUERY), Q.STRICT_QUERY, {"text": 1.0}, "text", f"'doc/' || key AS id, {_NUMBERS}"),
    "dense_fields": f"SELECT vec_id AS idx, round({Q._DOT.format('embedding', Q._VEC0)} * 5 / 7, 6) AS emb FROM embeddings",
    "bm25_postings": Q.SQL["bm25_postings"],
    "fast_search_stored": Q._MULTI + f" SELECT doc_id, source AS name, round(bm25, 6) AS score FROM (SELECT doc_id, source, bm25 FROM score JOIN documents USING (doc_id) WHERE bm25 > 0 ORDER BY bm25 DESC, doc_id LIMIT {Q.TOP_K})",
    "source_json": _NATION.format(body="CAST(n_nationkey AS VARCHAR)", tags="'a,' || lower(n_name)"),
    "source_yaml": _NATION.format(body="CAST(n_nationkey AS VARCHAR)", tags="'a,' || lower(n_name)"),
    "source_frontmatter": _NATION.format(body="'# no ' || n_nationkey || chr(10) || 'lies in ' || n_regionkey", tags="'a,' || lower(replace(n_name, ' ', '-'))"),
    "source_text": _NATION.replace("n_name AS title", "'' AS title").format(body="n_name || chr(10) || 'no ' || n_nationkey", tags="''"),
    "source_csv": "SELECT p_name || ' \"x\", y' AS title, p_type AS body, array_to_string(string_split(p_brand || ' k' || p_partkey, ' '), ',') AS tags FROM part",
    "source_ndjson": "SELECT p_name AS title, p_type AS body, p_brand || ',' || p_partkey AS tags FROM part",
    "source_xlsx": _NATION.format(body="CAST(n_nationkey AS VARCHAR)", tags="'a,' || lower(replace(n_name, ' ', '-'))"),
}
