"""Config-driven scans of folders: which files, how they are read, which fields they give."""

from __future__ import annotations

import io
import posixpath
import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LONGTEXT, TAGS, TEXT, CorpusSchema, Field, SchemaError
from .formats import READERS, STREAMED

# Spark sends 10,000 pieces at a time.
PIECE, BATCH = 8 << 10, 5_000
ITEM = "source_no int, path string, row_no int, id string, source string, tags array<string>, fields map<string,string>, error string"


@dataclass
class Source:
    dir: str
    format: str
    mapping: dict[str, str] = field(default_factory=dict)
    include: str = "**"
    on_error: str = "skip"


@dataclass
class IndexConfig:
    schema: CorpusSchema
    sources: list[Source]


def parse_config(text: str) -> IndexConfig:
    """A YAML index configuration, checked."""
    d = yaml.safe_load(text) or {}
    s = d.get("schema") or {}
    if not s.get("name"):
        raise SchemaError("schema.name is required")
    if not s.get("fields"):
        raise SchemaError("schema.fields is required")
    fields = []
    for f in s["fields"]:
        kind = f.get("type") or TEXT
        if not f.get("name"):
            raise SchemaError("a field has no name")
        if kind not in (TEXT, LONGTEXT, TAGS):
            raise SchemaError(f"field {f['name']}: unknown type {kind}")
        fields.append(Field(f["name"], kind, float(f.get("weight") or 1.0), *(bool(f.get(k)) for k in ("searchable", "embeddable", "display", "snippet", "strict"))))
    schema = CorpusSchema(s["name"], tuple(fields), s.get("name_field") or "", int(s.get("max_embed_runes") or 0))
    schema.validate()
    sources = [Source(x.get("dir") or "", x.get("format") or "", {str(k): str(v) for k, v in (x.get("mapping") or {}).items()}, x.get("include") or "**", x.get("on_error") or "skip") for x in d.get("sources") or []]
    for i, x in enumerate(sources):
        if not x.dir or not x.format:
            raise SchemaError(f"sources[{i}]: dir and format are required")
        if x.on_error not in ("skip", "fail"):
            raise SchemaError(f"sources[{i}]: on_error must be skip or fail")
    return IndexConfig(schema, sources)


def load_config(path: str) -> IndexConfig:
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read())


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression for Java and Python: ** is any number of segments, the rest never crosses a slash."""
    parts = posixpath.normpath(pattern).lstrip("/").split("/")
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
            continue
        at = 0
        while at < len(part):
            c = part[at]
            if c == "*":
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif c == "[" and "]" in part[at + 2 :]:
                end = part.index("]", at + 2)
                inner = part[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
                out += f"[{inner}]"
                at = end
            elif c == "\\" and at + 1 < len(part):
                at += 1
                out += re.sub(r"(\W)", r"\\\1", part[at])
            else:
                out += re.sub(r"(\W)", r"\\\1", c) if c.isascii() else c
            at += 1
        # "a/**" matches a itself as well: the slash belongs to what follows.
        out += "" if last else "(?:/|$)" if parts[i + 1 :] == ["**"] else "/"
    return f"^{out}$"


def match_glob(pattern: str, name: str) -> bool:
    return bool(re.search(glob_regex(pattern), posixpath.normpath(name).lstrip("/")))


def glob_filter(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


class _Pieces(io.RawIOBase):
    """A file's bytes, piece by piece."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.left = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, to) -> int:
        while not len(self.left):
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.left = memoryview(piece)
        n = min(len(to), len(self.left))
        to[:n] = self.left[:n]
        self.left = self.left[n:]
        return n


def _parser(no: int, src: Source, source_name: str, tags: set[str]):
    """(path, piece) of files, each file's pieces in their order, to items.

    Of a format that is streamed no more than ``BATCH`` items are held: as a file that turns out to be broken has none, the
    ones before are on disk until it has ended.
    """
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.string()]
    schema = pa.schema(list(zip(["source_no", "path", "row_no", "id", "source", "tags", "fields", "error"], kinds)))
    stream = STREAMED.get(src.format) or (lambda file, *rest: READERS[src.format](file.read(), *rest))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], schema=schema)

    def run(batches):
        pieces = ((b.column(0)[i].as_py(), b.column(1)[i].as_py() or b"") for b in batches for i in range(b.num_rows))
        rows: list[tuple] = []  # of files that have ended
        for rel, own in groupby(pieces, key=lambda x: x[0]):
            with tempfile.TemporaryFile() as spilled:
                held: list[tuple] = []
                writer = None
                try:
                    for k, (item, fields, found) in enumerate(stream(io.BufferedReader(_Pieces(x[1] for x in own)), rel, src.mapping, tags), 1):
                        held.append((no, rel, k, item, source_name, found, list(fields.items()), None))
                        if len(held) >= BATCH:
                            writer = writer or pa.ipc.new_stream(spilled, schema)
                            writer.write_batch(batch(held))
                            held = []
                except Exception as e:
                    if src.on_error == "fail":
                        raise ValueError(f"{rel}: {e}") from e
                    rows.append((no, rel, 0, rel, source_name, [], [], f"{type(e).__name__}: {e}"))
                else:
                    if writer:
                        writer.close()
                        spilled.seek(0)
                        yield from pa.ipc.open_stream(spilled)
                    rows += held
            if len(rows) >= BATCH:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return run


def in_pieces(found: DataFrame) -> DataFrame:
    """(path, piece): the content of each file in pieces of ``PIECE`` bytes, in order; one of an empty file."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.octet_length("content") - 1).cast("int") / PIECE).cast("int"))).alias("k")
    return found.select("path", "content", at).select("path", F.substring("content", F.col("k") * PIECE + 1, F.lit(PIECE)).alias("piece"))


def files(spark: SparkSession, folder: str, include: str, streaming: bool = False) -> DataFrame:
    """(path relative to the folder, content, length, modified) of the files that match a glob; unreadable ones are left out.

    Paths that name files are pruned before their content is read.
    """
    base = folder.rstrip("/")
    reader = spark.readStream if streaming else spark.read
    if streaming:
        reader = reader.schema("path string, modificationTime timestamp, length bigint, content binary")
    last = include.rpartition("/")[2]
    if "**" not in last and not re.search(r"[{}\\\[^]", last):
        reader = reader.option("pathGlobFilter", last)
    raw = reader.format("binaryFile").option("recursiveFileLookup", True).load(base)
    prefix = re.escape(base.split("://", 1)[-1]).replace("/", "/+")
    decoded = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    rel = F.regexp_replace(decoded, f"^.*?{prefix}/+", "")
    return raw.withColumn("rel", rel).where(glob_filter(F.col("rel"), include)).select(F.col("rel").alias("path"), "content", "length", "modificationTime")


def scan(spark: SparkSession, config: IndexConfig) -> DataFrame:
    """The items of all sources; a file that can't be read gives a row with its ``error`` (skip) or ends the job (fail)."""
    tags = {f.name for f in config.schema.tags()}
    parts = []
    for no, src in enumerate(config.sources):
        if src.format not in READERS:
            raise SchemaError(f"sources[{no}]: unknown format {src.format}")
        found = files(spark, src.dir, src.include).select("path", "content")
        parts.append(in_pieces(found).mapInArrow(_parser(no, src, config.schema.name, tags), ITEM))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ITEM)


def scan_stats(items: DataFrame) -> dict[str, int]:
    """The dry run: how many items, how many files skipped."""
    row = items.agg(F.sum(F.when(F.col("error").isNull(), 1).otherwise(0)).alias("items"), F.sum(F.when(F.col("error").isNotNull(), 1).otherwise(0)).alias("skipped")).first()
    return {"items": row["items"] or 0, "skipped": row["skipped"] or 0}


SKILLS = CorpusSchema("skills", (
    Field("name", TEXT, 5, True, True, True, False, True), Field("description", LONGTEXT, 2, True, True, True, True, True),
    Field("tags", TAGS, 3, True, True, True), Field("category", TEXT, 1, True, True, True), Field("full_content", LONGTEXT, 1, True, False, False, True),
), "name")
WIKI = CorpusSchema("wiki", (Field("name", TEXT, 3, True, True, True, False, True), Field("category", TEXT, 1, True, True, True), Field("content", LONGTEXT, 1, True, True, True, True, True)), "name")
_META = r"(?i)^(?:.*/)?(?:README|LICENSE(?:-[^/]*)?|CHANGELOG(?:-[^/]*)?|CONTRIBUTING(?:-[^/]*)?)\.md$"


def scan_skills(spark: SparkSession, folder: str) -> DataFrame:
    """The skills corpus: files called SKILL.md."""
    return files(spark, folder, "**/SKILL.md").select("path", "content").transform(in_pieces).mapInArrow(_parser(0, Source(folder, "skill"), "skill", set()), ITEM)


def scan_wiki(spark: SparkSession, folder: str) -> DataFrame:
    """The notes corpus: Markdown files but for README, LICENSE, CHANGELOG and CONTRIBUTING."""
    found = files(spark, folder, "**").where(F.col("path").rlike(r"(?i)\.md$") & ~F.col("path").rlike(_META))
    return in_pieces(found).mapInArrow(_parser(0, Source(folder, "wiki"), "wiki", set()), ITEM)
