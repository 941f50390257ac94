"""What a corpus looks like: fields, their weights and roles, and the JSON that is stored beside an index."""

from __future__ import annotations

import json
from dataclasses import dataclass, field as _default
from pathlib import Path

TEXT, LONGTEXT, TAGS = "text", "longtext", "tags"
TYPES = (TEXT, LONGTEXT, TAGS)
MAX_EMBED_CHARS = 512


class SchemaError(ValueError):
    """A schema that can't be used."""


@dataclass(frozen=True)
class Field:
    name: str
    type: str = TEXT
    weight: float = 1.0
    searchable: bool = False
    embeddable: bool = False
    display: bool = False
    snippet: bool = False
    strict: bool = False

    @property
    def boost(self) -> float:
        """The weight used in scores: zero means one."""
        return self.weight or 1.0


@dataclass(frozen=True)
class CorpusSchema:
    name: str
    fields: tuple[Field, ...]
    name_field: str = ""
    max_embed_chars: int = 0

    @staticmethod
    def of(name: str, fields: list[Field], name_field: str = "", max_embed_chars: int = 0) -> CorpusSchema:
        """A checked schema: no duplicate names; a weight of zero becomes one."""
        names = [f.name for f in fields]
        if len(set(names)) != len(names):
            raise SchemaError(f"schema {name}: a field name occurs twice")
        made = CorpusSchema(name, tuple(Field(**{**f.__dict__, "weight": f.boost}) for f in fields), name_field, max_embed_chars)
        made.validate()
        return made

    def validate(self) -> None:
        if not self.name:
            raise SchemaError("a schema needs a name")
        for f in self.fields:
            if not f.name:
                raise SchemaError(f"schema {self.name}: a field has no name")
            if f.weight < 0:
                raise SchemaError(f"field {f.name}: negative weight")
            if f.type not in TYPES:
                raise SchemaError(f"field {f.name}: unknown type {f.type}")
        if not self.searchable():
            raise SchemaError(f"schema {self.name}: no searchable field")
        if self.name_field and self.lookup(self.name_field) is None:
            raise SchemaError(f"schema {self.name}: no field {self.name_field}")
        if self.max_embed_chars < 0:
            raise SchemaError("max_embed_chars is negative")

    def lookup(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def index(self, name: str) -> int:
        return next(i for i, f in enumerate(self.fields) if f.name == name)

    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def searchable(self) -> list[Field]:
        return [f for f in self.fields if f.searchable]

    def embeddable(self) -> list[Field]:
        return [f for f in self.fields if f.embeddable]

    def displayed(self) -> list[Field]:
        return [f for f in self.fields if f.display]

    def snippets(self) -> list[Field]:
        return [f for f in self.fields if f.snippet]

    def strict(self) -> list[Field]:
        return [f for f in self.fields if f.strict]

    def tags(self) -> list[Field]:
        return [f for f in self.fields if f.type == TAGS]

    def primary(self) -> Field | None:
        """The name field: the one declared, else one called name, else the first displayed text."""
        if self.name_field:
            return self.lookup(self.name_field)
        return self.lookup("name") or next((f for f in self.fields if f.display and f.type == TEXT), None)

    def description(self) -> Field | None:
        """The first long text."""
        return next((f for f in self.fields if f.type == LONGTEXT), None)

    def embed_chars(self) -> int:
        return self.max_embed_chars or MAX_EMBED_CHARS

    def to_json(self) -> str:
        rows = [{"Name": f.name, "Type": TYPES.index(f.type), "Searchable": f.searchable, "Embeddable": f.embeddable, "FieldWeight": f.weight, "Display": f.display, "Snippet": f.snippet, "Strict": f.strict} for f in self.fields]
        return json.dumps({"Name": self.name, "Fields": rows, "NameField": self.name_field, "MaxEmbedRunes": self.embed_chars()}, ensure_ascii=False, indent=2)

    @staticmethod
    def from_json(text: str) -> CorpusSchema:
        d = json.loads(text)
        fields = [Field(r["Name"], TYPES[r.get("Type", 0)], float(r.get("FieldWeight", 0)), bool(r.get("Searchable")), bool(r.get("Embeddable")), bool(r.get("Display")), bool(r.get("Snippet")), bool(r.get("Strict"))) for r in d["Fields"]]
        made = CorpusSchema(d["Name"], tuple(fields), d.get("NameField", ""), int(d.get("MaxEmbedRunes", 0)))
        made.validate()
        return made

    def save(self, path: str | Path) -> None:
        Path(path).write_text(self.to_json(), encoding="utf-8")

    @staticmethod
    def load(path: str | Path) -> CorpusSchema:
        return CorpusSchema.from_json(Path(path).read_text(encoding="utf-8"))

    def __str__(self) -> str:
        return f"{self.name}(" + ", ".join(f"{f.name}:{f.type}*{f.boost:g}" for f in self.fields) + ")"


@dataclass
class SearchOptions:
    """A query and how its signals are weighed; a weight of zero stands for the default."""

    query: str
    fields: list[str] = _default(default_factory=list)
    top_k: int = 10
    strict: bool = False
    w_bm25: float = 0.40
    w_emb: float = 0.45
    w_phrase: float = 0.10
    w_strict: float = 0.30
    w_exact: float = 0.20
    w_prefix: float = 0.10
    rerank_top: int = 100
    w_rerank: float = 0.20

    def resolved(self) -> SearchOptions:
        base = SearchOptions(self.query)
        out = SearchOptions(**self.__dict__)
        for k, v in base.__dict__.items():
            if k.startswith("w_") or k in ("top_k", "rerank_top"):
                mine = getattr(self, k)
                if mine == 0 or (k in ("w_rerank", "top_k", "rerank_top") and mine < 0):
                    setattr(out, k, v)
        return out
