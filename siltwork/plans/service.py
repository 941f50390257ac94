"""The commands: build, dry run, describe, search, fast search; one engine for each index folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import storage
from ..operators.index import build_index, current, load_index
from ..schema import CorpusSchema, SearchOptions
from ..sources.scan import SKILLS, WIKI, load_config, scan, scan_skills, scan_stats, scan_wiki
from .search import Engine


class CommandError(ValueError):
    """A command that can't be carried out as given."""


class Service:
    def __init__(self, spark: SparkSession, encoder=None):
        self.spark, self.encoder, self.engines = spark, encoder, {}

    def _engine(self, folder: str) -> Engine:
        if not storage.is_folder(self.spark, folder):
            raise CommandError(f"{folder} is not a folder")
        snap = current(self.spark, folder)
        held = self.engines.get(folder)
        if held is None or held.index.path != snap:
            if held is not None:
                held.close()
            held = self.engines[folder] = Engine(load_index(self.spark, folder, self.encoder))
        return held

    def search(self, index: str, query: str, k: int = 10, fields: list[str] | None = None, strict: bool = False) -> list[dict]:
        schema = self._engine(index).index.schema
        for f in fields or []:
            if schema.lookup(f) is None:
                raise CommandError(f"unknown field {f} (available: {', '.join(schema.names())})")
        rows = self._engine(index).search(SearchOptions(query, list(fields or []), k, strict))
        return [{c: r[c] for c in ("id", "score", "path", "source", "tags", "fields", "snippet")} for r in rows]

    def fastsearch(self, index: str, text: str, k: int = 10) -> list[dict]:
        if not text.strip():
            raise CommandError("the text is empty")
        return self._engine(index).fast_search(text, k)

    def schema(self, index: str) -> dict:
        s = CorpusSchema.from_json(storage.read_bytes(self.spark, f"{index}/schema.json").decode())
        return {"name": s.name, "fields": [{"name": f.name, "type": f.type, "searchable": f.searchable, "embeddable": f.embeddable, "weight": f.weight, "display": f.display, "snippet": f.snippet, "strict": f.strict} for f in s.fields]}

    def index(self, config: str, output: str, max_embed_chars: int = 0, emb_cache: str = "", dry_run: bool = False) -> dict[str, int]:
        cfg = load_config(config)
        if max_embed_chars > 0:
            cfg.schema = CorpusSchema(cfg.schema.name, cfg.schema.fields, cfg.schema.name_field, max_embed_chars)
        return self._built(scan(self.spark, cfg), cfg.schema, output, emb_cache, dry_run)

    def _built(self, items, schema: CorpusSchema, output: str, emb_cache: str, dry_run: bool) -> dict[str, int]:
        """Count the items, or build with them; either way the sources are read once."""
        if dry_run:
            return scan_stats(items)
        storage.make_folder(self.spark, output)
        probe = f"{output.rstrip('/')}/.writable"
        try:
            storage.write_bytes(self.spark, probe, b"")
            storage.delete(self.spark, probe)
        except Exception as e:
            raise CommandError(f"{output} can't be written to: {e}") from e
        return build_index(items, schema, output, self.encoder, emb_cache)

    def build_preset(self, kind: str, folder: str, output: str, emb_cache: str = "", dry_run: bool = False) -> dict[str, int]:
        """A preset's index. Its schema has embeddable fields, so that an encoder is required."""
        if kind not in ("skills", "wiki"):
            raise CommandError(f"unknown preset {kind}")
        if not storage.is_folder(self.spark, folder):
            raise CommandError(f"{folder} is not a folder")
        if self.encoder is None and not dry_run:
            raise CommandError("a preset needs an encoder")
        items = (scan_skills if kind == "skills" else scan_wiki)(self.spark, folder)
        return self._built(items, SKILLS if kind == "skills" else WIKI, output, emb_cache, dry_run)

    def watch(self, config: str, output: str, emb_cache: str = "", interval: float = 5.0):
        """A watcher that keeps an index in step with a configuration's sources; ``run()`` it, and ``stop()`` it from another thread."""
        from ..streaming.live import Watcher

        return Watcher(self.spark, load_config(config), output, self.encoder, emb_cache, interval)

    def close(self) -> None:
        for e in self.engines.values():
            e.close()
        self.engines.clear()
