"""Readers of one file's bytes: each gives items (id, fields, tags) or raises."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import yaml

from ..functions.extract import MISSING, get_path, stringify, to_tags

BODY = ("__body__", "__text__")
MAX_LINE = 16 << 20
Item = tuple[str, dict[str, str], list[str]]


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def build(root, body: str, item_id: str, mapping: dict[str, str], tags: set[str]) -> Item:
    """Fields by their paths. Lists and texts of tags fields become tags, those of several fields in the mapping's order."""
    fields, found = {}, []
    for name, path in mapping.items():
        if path in BODY:
            fields[name] = body
            continue
        value = get_path(root, path)
        as_tags = to_tags(value) if name in tags and value is not MISSING else None
        if as_tags is None:
            fields[name] = stringify(value)
        else:
            found += as_tags
    return item_id, fields, found


def read_json(data: bytes, rel: str, mapping, tags) -> list[Item]:
    return [build(json.loads(_text(data)), "", rel, mapping, tags)]


def read_yaml(data: bytes, rel: str, mapping, tags) -> list[Item]:
    return [build(yaml.safe_load(_text(data)), "", rel, mapping, tags)]


def split_frontmatter(text: str, typed: bool = False) -> tuple[dict, str, bool]:
    """(metadata, body, found). With ``typed`` (the presets) a +++ block that can't be read is still stripped."""
    head = text.lstrip(" \t\r\n")
    for fence in ("---", "+++"):
        if not head.startswith(fence):
            continue
        rest = re.sub(r"^\r?\n", "", head[3:].lstrip(" \t"), count=1)
        end = rest.find("\n" + fence)
        if end < 0:
            break
        body = rest[end + 4 :].lstrip(" \t\r\n")
        try:
            meta = yaml.safe_load(rest[:end])
        except yaml.YAMLError:
            meta = MISSING
        if meta is None or isinstance(meta, dict):
            return meta or {}, body, True
        return {}, body if typed and fence == "+++" else text, False
    return {}, text, False


def read_frontmatter(data: bytes, rel: str, mapping, tags) -> list[Item]:
    meta, body, _ = split_frontmatter(_text(data))
    return [build(meta, body, rel, mapping, tags)]


def read_text(data: bytes, rel: str, mapping, tags) -> list[Item]:
    body = _text(data)
    return [(rel, {name: body if path in BODY else "" for name, path in mapping.items()}, [])]


def column_index(header: list[str], name: str) -> int:
    """A number is a position, anything else a trimmed heading; -1 if there is none."""
    if re.fullmatch(r"\+?[0-9]+", name):
        return int(name)
    return next((i for i, h in enumerate(header) if h.strip() == name), -1)


def _table(rows: Iterable[list[str]], rel: str, mapping, tags, what: str) -> Iterator[Item]:
    rows = iter(rows)
    header = next(rows, None)
    if header is None:
        raise ValueError(f"the {what} has no rows")
    at = {name: column_index(header, col) for name, col in mapping.items()}
    for n, row in enumerate(rows, 1):
        fields, found = {}, []
        for name, i in at.items():
            cell = row[i] if 0 <= i < len(row) else ""
            if name in tags:
                found += to_tags(cell) or []
            else:
                fields[name] = cell
        yield f"{rel}#{n}", fields, found


def stream_csv(file: io.BufferedIOBase, rel: str, mapping, tags) -> Iterator[Item]:
    csv.field_size_limit(1 << 30)
    text = io.TextIOWrapper(file, encoding="utf-8", errors="replace", newline="")
    return _table((r for r in csv.reader(text, strict=True) if r), rel, mapping, tags, "file")


def stream_ndjson(file: io.BufferedIOBase, rel: str, mapping, tags) -> Iterator[Item]:
    n = 0
    for line in iter(lambda: file.readline(MAX_LINE + 2), b""):
        if len(line.removesuffix(b"\n")) > MAX_LINE:
            raise ValueError("a line is too long")
        if line.strip():
            n += 1
            yield build(json.loads(_text(line.removesuffix(b"\n"))), "", f"{rel}#{n}", mapping, tags)


def read_csv(data: bytes, rel: str, mapping, tags) -> list[Item]:
    return list(stream_csv(io.BytesIO(data), rel, mapping, tags))


def read_ndjson(data: bytes, rel: str, mapping, tags) -> list[Item]:
    return list(stream_ndjson(io.BytesIO(data), rel, mapping, tags))


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_rows(data: bytes) -> list[list[str]]:
    """The first sheet's cells, at the columns they name; rich text is joined."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        if "xl/worksheets/sheet1.xml" not in names:
            raise ValueError("the workbook has no first sheet")
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t") or t.tag == "t") for si in root]
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    rows = []
    for row in (e for e in sheet.iter() if e.tag.rpartition("}")[2] == "row"):
        cells: list[str] = []
        for cell in (e for e in row if e.tag.rpartition("}")[2] == "c"):
            at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
            value = next((e.text or "" for e in cell if e.tag.rpartition("}")[2] == "v"), "")
            kind = cell.get("t")
            if kind == "s":
                value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
            elif kind == "inlineStr":
                value = "".join(e.text or "" for e in cell.iter() if e.tag.rpartition("}")[2] == "t")
            cells += [""] * (at + 1 - len(cells))
            cells[at] = value
        rows.append(cells)
    return rows


def read_xlsx(data: bytes, rel: str, mapping, tags) -> list[Item]:
    return list(_table(xlsx_rows(data), rel, mapping, tags, "sheet"))


def read_skill(data: bytes, rel: str, mapping, tags) -> list[Item]:
    """The preset for SKILL.md files: name, description, tags and category from the front matter."""
    meta, body, _ = split_frontmatter(_text(data), typed=True)
    name = stringify(meta.get("name")) or posixpath.basename(posixpath.dirname(rel))
    own = meta.get("tags")
    return [(rel, {"name": name, "description": stringify(meta.get("description")), "category": stringify(meta.get("category")), "full_content": body}, [stringify(t) for t in own] if isinstance(own, list) else [])]


def read_wiki(data: bytes, rel: str, mapping, tags) -> list[Item]:
    """The preset for notes: the name is the file's, the category its folder."""
    _, body, _ = split_frontmatter(_text(data), typed=True)
    folder, file = posixpath.split(rel)
    return [(rel, {"name": posixpath.splitext(file)[0], "category": folder, "content": body}, [])]


READERS = {
    "json": read_json, "yaml": read_yaml, "yml": read_yaml, "frontmatter": read_frontmatter, "markdown": read_frontmatter,
    "text": read_text, "csv": read_csv, "ndjson": read_ndjson, "jsonl": read_ndjson, "xlsx": read_xlsx, "skill": read_skill, "wiki": read_wiki,
}
# Formats whose items follow each other in a file of any size: read piece by piece.
STREAMED = {"csv": stream_csv, "ndjson": stream_ndjson, "jsonl": stream_ndjson}
