import io
import json
import zipfile

import pytest

from siltwork.operators.index import build_index, load_index, normalise_items
from siltwork.plans.search import search
from siltwork.plans.service import Service
from siltwork.schema import SchemaError, SearchOptions
from siltwork.sources.formats import READERS, column_index, split_frontmatter
from siltwork.sources.scan import parse_config, scan, scan_skills, scan_stats, scan_wiki

CONFIG = """
schema:
  name: config
  name_field: title
  fields:
    - {display: true, searchable: true, weight: 5, name: title}
    - {snippet: true, display: true, searchable: true, type: longtext, name: content}
    - {weight: 3, display: true, searchable: true, type: tags, name: keys}
sources:
  - {dir: DIR, include: "**/*.json", format: json, mapping: {title: title, content: body, keys: keys}}
  - {dir: DIR, include: "*.csv", format: csv, mapping: {title: title, content: "1"}}
"""


def xlsx(rows: str, shared: str = "") -> bytes:
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{shared}</sst>")
    return out.getvalue()


def test_formats():
    tags = {"keys"}
    m = {k: k for k in ("title", "body", "keys")}
    want = [("r", dict(zip(m, "TB")), list("ab"))]
    assert READERS["json"](b'{"keys": ["a", "b"], "body": "B", "title": "T"}', "r", m, tags) == want
    assert READERS["yaml"](b"keys: [a, b]\nbody: B\ntitle: T", "r", m, tags) == want
    assert [x[0] for x in READERS["csv"](b"title,body\nx,y\nz\n", "r", m, tags)] == ["r#1", "r#2"]
    assert READERS["csv"](b"title,body\nz\n", "r", m, tags)[0][1] == {"title": "z", "body": ""}
    assert [x[0] for x in READERS["ndjson"](b'{"title":1}\n\n  \n{"title":2}\n', "r", m, tags)] == ["r#1", "r#2"]
    for name, bad in (("json", b"{"), ("csv", b""), ("ndjson", b'{"a":1}\n{'), ("xlsx", b"no zip"), ("yaml", b"a: [")):
        with pytest.raises(Exception):
            READERS[name](bad, "r", m, tags)
    assert READERS["text"](b"words", "r", {"a": "__text__", "b": "x"}, set()) == [("r", {"a": "words", "b": ""}, [])]
    assert column_index(["a", " b "], "b") == 1 and column_index(["a"], "7") == 7 and column_index(["a"], "z") == -1


def test_frontmatter():
    m = {"title": "title", "text": "__body__"}
    assert READERS["frontmatter"](b"\n---\ntitle: T\n---\n\nBody", "r", m, set()) == [("r", {"title": "T", "text": "Body"}, [])]
    assert READERS["markdown"](b"--- \ntitle: [\n---\nBody", "r", m, set())[0][1] == {"title": "", "text": "--- \ntitle: [\n---\nBody"}
    assert split_frontmatter("+++\na: [\n+++\nBody") == ({}, "+++\na: [\n+++\nBody", False)
    assert split_frontmatter("+++\na: [\n+++\nBody", typed=True) == ({}, "Body", False)
    assert split_frontmatter("---\nopen")[2] is False and split_frontmatter("")[1] == ""


def test_xlsx():
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>body</t></is></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="s"><v>1</v></c></row>'
    data = xlsx(rows, "<si><t>title</t></si><si><r><t>rich</t></r><r><t> text</t></r></si>")
    assert READERS["xlsx"](data, "r", {"t": "title", "b": "body"}, set()) == [("r#1", {"t": "7", "b": "rich text"}, [])]


def test_config_scan_build_search(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    (src / "deep dir").mkdir(parents=True)
    (src / "a.json").write_text(json.dumps(dict(keys="log config".split(), body="日志配置说明", title="Log4j 配置")))
    (src / "deep dir" / "b+1.json").write_text(json.dumps(dict(keys=["web"], body="代理与缓存", title="Nginx 反向代理")))
    (src / "broken.json").write_text("{")
    (src / "items.csv").write_text("title,content\n" + "".join(f"CSV 条目{n},内容{n}\n" for n in "一二"))
    (tmp_path / "c.yaml").write_text(CONFIG.replace("DIR", str(src)))
    svc = Service(spark)
    assert svc.index(str(tmp_path / "c.yaml"), str(out), dry_run=True) == {"items": 4, "skipped": 1} and not out.exists()
    assert svc.index(str(tmp_path / "c.yaml"), str(out)) == {"items": 4, "skipped": 1}
    ix = load_index(spark, str(out))
    got = [(r.path, r.id, round(r.score, 6), round(r.bm25, 6)) for r in search(ix, SearchOptions("nginx 反向代理")).collect()]
    assert got[0] == ("deep dir/b+1.json", "deep dir/b+1.json", 0.88, 22.029365) and [g[2] for g in got[1:]] == [0, 0, 0]
    got = [(r.id, round(r.score, 6), round(r.bm25, 6)) for r in search(ix, SearchOptions("CSV 条目一")).collect()]
    assert got[:2] == [("items.csv#1", 0.96, 12.951336), ("items.csv#2", 0.443643, 6.931472)]
    failing = parse_config(CONFIG.replace("DIR", str(src)))
    failing.sources[0].on_error = "fail"
    with pytest.raises(Exception):
        scan(spark, failing).collect()


def test_config_rules():
    for bad in ("schema: {}", "schema: {name: x}", "schema: {name: x, fields: [{name: a, type: odd}]}", "schema: {name: x, fields: [{searchable: true}]}", CONFIG.replace("format: json", "on_error: maybe, format: json"), CONFIG.replace("format: csv, ", "")):
        with pytest.raises(SchemaError):
            parse_config(bad)


def test_presets(spark, tmp_path):
    (tmp_path / "s" / "tool").mkdir(parents=True)
    (tmp_path / "s" / "tool" / "SKILL.md").write_text("---\ndescription: does things\ntags: [x, y]\n---\nHow to")
    (tmp_path / "s" / "README.md").write_text("no")
    rows = scan_skills(spark, str(tmp_path / "s")).collect()
    assert len(rows) == 1 and rows[0].fields == {"name": "tool", "description": "does things", "category": "", "full_content": "How to"} and rows[0].tags == ["x", "y"] and rows[0].source == "skill"
    (tmp_path / "w" / "sub").mkdir(parents=True)
    for name in ("note.md", "README.md", "LICENSE-MIT.md", "sub/README-x.MD", "sub/b.txt", "changelog.md"):
        (tmp_path / "w" / name).write_text("body of " + name)
    rows = {r.path: r.fields for r in scan_wiki(spark, str(tmp_path / "w")).collect()}
    assert set(rows) == {"note.md", "sub/README-x.MD"} and rows["sub/README-x.MD"] == {"name": "README-x", "category": "sub", "content": "body of sub/README-x.MD"}
    assert scan_stats(scan_wiki(spark, str(tmp_path / "w"))) == {"items": 2, "skipped": 0}
    stats = Service(spark).build_preset("wiki", str(tmp_path / "w"), str(tmp_path / "out"))
    assert stats["items"] == 2 and search(load_index(spark, str(tmp_path / "out")), SearchOptions("note")).first().path == "note.md"


def test_item_defaults(spark):
    from tests.test_search import ITEM, TEST

    df = spark.createDataFrame([("", "p", "", None, {"name": "n"}), (None, None, None, ["a b"], None)], ITEM)
    got = normalise_items(df, TEST).orderBy("id").collect()
    assert [(r.id, r.source, r.tags, r.f0, r.f1) for r in got] == [("", "item", ["a", "b"], "", ""), ("p", "item", [], "n", "")]


def test_partitioning_does_not_matter(spark, tmp_path):
    from tests.test_search import A, ITEM, TEST, docs

    for i, n in enumerate((1, 5)):
        build_index(spark.createDataFrame(docs(A), ITEM).repartition(n), TEST, str(tmp_path / str(i)))
    one, two = (search(load_index(spark, str(tmp_path / str(i))), SearchOptions("nginx 部署")).collect() for i in range(2))
    assert one == two
