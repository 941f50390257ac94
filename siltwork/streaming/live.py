"""Change-driven indexing: signatures of folders, a watcher that rebuilds and publishes, readers that follow."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators.index import build_index, clean_stale, current, load_index
from ..plans.search import Engine
from ..schema import SearchOptions
from ..sources.scan import IndexConfig, files, scan

STALE_SECONDS = 30


def signature(spark: SparkSession, config: IndexConfig) -> DataFrame:
    """(path, size, modified) of every file that the sources match, without reading content."""
    out = None
    for i, s in enumerate(config.sources):
        one = files(spark, s.dir, s.include).select(F.concat(F.lit(f"{i}:"), F.col("path")).alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "path string, size bigint, modified bigint")


def difference(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """(key, change): what was added, changed or deleted between two listings; any other column may differ."""
    rest = [c for c in before.columns if c != key]
    a, b = (df.select(F.col(key).alias(key), F.struct(*rest).alias(n), F.lit(True).alias(f"has_{n}")) for df, n in ((before, "a"), (after, "b")))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("has_a").isNull(), "added").when(F.col("has_b").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


class Locked(RuntimeError):
    """Another watcher is at work."""


class WatchLock:
    """One watcher for an index: a file with its name and a heartbeat. It is stale if it has been silent for ``STALE_SECONDS``.

    While it is held a thread beats, so that a rebuild of any length leaves it alive. A stale lock is taken away by renaming
    it, which one taker can do, and then made anew, which one taker can do: of two that see it stale one gets it.
    """

    def __init__(self, spark: SparkSession, path: str, stale: float = STALE_SECONDS):
        self.spark, self.folder, self.path, self.stale = spark, path.rstrip("/"), f"{path.rstrip('/')}/.watch.lock", stale
        self.name, self.stopped, self.thread = uuid.uuid4().hex, threading.Event(), None

    def _held(self) -> dict:
        try:
            return json.loads(storage.read_bytes(self.spark, self.path))
        except (OSError, ValueError):
            return {}

    def acquire(self) -> None:
        storage.make_folder(self.spark, self.folder)
        if not storage.create(self.spark, self.path, self._mark()):
            held = self._held()
            if time.time() - held.get("beat", 0) <= self.stale:
                raise Locked(self.path)
            old = f"{self.folder}/.watch.stale-{uuid.uuid4().hex}"
            try:
                storage.move(self.spark, self.path, old)
            except Exception as e:  # another taker was first
                raise Locked(self.path) from e
            moved = json.loads(storage.read_bytes(self.spark, old) or b"{}")
            storage.delete(self.spark, old)
            if moved.get("name") != held.get("name"):  # it had just been taken over: give it back
                storage.create(self.spark, self.path, json.dumps(moved).encode())
                raise Locked(self.path)
            if not storage.create(self.spark, self.path, self._mark()):
                raise Locked(self.path)
        self.stopped.clear()
        self.thread = threading.Thread(target=self._beats, daemon=True)
        self.thread.start()

    def _mark(self) -> bytes:
        return json.dumps({"name": self.name, "pid": os.getpid(), "beat": time.time()}).encode()

    def _beats(self) -> None:
        while not self.stopped.wait(self.stale / 6):
            self.beat()

    def beat(self) -> None:
        if self._held().get("name") == self.name:
            storage.write_bytes(self.spark, self.path, self._mark())

    def release(self) -> None:
        self.stopped.set()
        if self.thread is not None:
            self.thread.join()
            self.thread = None
        if self._held().get("name") == self.name:
            storage.delete(self.spark, self.path)


class Watcher:
    """Keep an index in step with its sources. A failed rebuild leaves the published index and is tried again."""

    def __init__(self, spark: SparkSession, config: IndexConfig, output: str, encoder=None, cache_dir: str = "", interval: float = 5.0, stale: float = STALE_SECONDS):
        if interval <= 0:
            raise ValueError("the interval must be positive")
        self.spark, self.config, self.output, self.encoder, self.interval = spark, config, output, encoder, interval
        self.cache_dir = cache_dir or f"{output}/.embcache"
        self.lock, self.seen, self.failed = WatchLock(spark, output, stale), None, None
        self.stopped = threading.Event()

    def start(self) -> None:
        self.lock.acquire()
        clean_stale(self.spark, self.output)
        self.tick()

    def _listing(self) -> list[tuple]:
        # A listing is metadata of the watched folders; the comparison of large ones is ``difference``.
        return sorted(tuple(r) for r in signature(self.spark, self.config).collect())

    def tick(self) -> bool:
        """Rebuild if something changed; whether it did."""
        now = self._listing()
        if now == self.seen:
            return False
        try:
            build_index(scan(self.spark, self.config), self.config.schema, self.output, self.encoder, self.cache_dir)
        except Exception as e:
            self.failed = e
            return False
        self.seen, self.failed = now, None
        return True

    def run(self) -> None:
        self.start()
        try:
            while not self.stopped.wait(self.interval):
                self.tick()
        finally:
            self.lock.release()

    def stop(self) -> None:
        self.stopped.set()


def watch_stream(spark: SparkSession, config: IndexConfig, source_no: int, checkpoint: str, on_change, interval: str = "5 seconds", once: bool = False):
    """Added and modified files of a source as a stream: ``on_change(batch, number)`` for each batch of (path, length).

    The file source doesn't report deletions; :func:`difference` of two signatures does.
    """
    s = config.sources[source_no]
    writer = files(spark, s.dir, s.include, streaming=True).select("path", "length").writeStream.foreachBatch(on_change).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


class LiveEngine:
    """Searches the current snapshot; a newer one is taken up at the next search after ``interval`` seconds.

    Searches run side by side: the lock is held only while an engine is taken or given back. One that was replaced is
    closed when its last search is done.
    """

    def __init__(self, spark: SparkSession, path: str, interval: float = 5.0, encoder=None):
        self.spark, self.path, self.interval, self.encoder = spark, path, interval, encoder
        self.lock, self.closed = threading.RLock(), False
        self.engine, self.checked = Engine(load_index(spark, path, encoder)), time.monotonic()
        self.busy: dict[int, list] = {}  # engines with searches under way: [engine, how many]

    def refresh(self, force: bool = False) -> bool:
        """Take up a newer snapshot; a pointer that is missing for a moment is tried again later."""
        with self.lock:
            if not force and time.monotonic() - self.checked < self.interval:
                return False
            self.checked = time.monotonic()
            try:
                if current(self.spark, self.path) == self.engine.index.path:
                    return False
                new = Engine(load_index(self.spark, self.path, self.encoder))
            except OSError:
                return False
            old, self.engine = self.engine, new
            if id(old) not in self.busy:
                old.close()
            return True

    def _with(self, ask):
        with self.lock:
            if self.closed:
                raise RuntimeError("the engine is closed")
            self.refresh()
            engine = self.engine
            self.busy.setdefault(id(engine), [engine, 0])[1] += 1
        try:
            return ask(engine)
        finally:
            with self.lock:
                entry = self.busy[id(engine)]
                entry[1] -= 1
                if not entry[1]:
                    del self.busy[id(engine)]
                    if self.closed or engine is not self.engine:
                        engine.close()

    def search(self, options: SearchOptions) -> list[dict]:
        return self._with(lambda engine: engine.search(options))

    def fast_search(self, text: str, k: int = 10) -> list[dict]:
        return self._with(lambda engine: engine.fast_search(text, k))

    def close(self) -> None:
        with self.lock:
            if not self.closed:
                self.closed = True
                if id(self.engine) not in self.busy:
                    self.engine.close()


class Registry:
    """Engines by folder, counted by those who hold them; the last release closes."""

    def __init__(self):
        self.held: dict[str, list] = {}
        self.lock = threading.Lock()

    def open(self, spark: SparkSession, path: str, encoder=None) -> Engine:
        with self.lock:
            if path not in self.held:
                self.held[path] = [Engine(load_index(spark, path, encoder)), 0]
            self.held[path][1] += 1
            return self.held[path][0]

    def release(self, path: str) -> None:
        with self.lock:
            entry = self.held.get(path)
            if entry:
                entry[1] -= 1
                if entry[1] <= 0:
                    entry[0].close()
                    del self.held[path]

    def remove(self, path: str) -> None:
        """Close an engine whoever holds it."""
        with self.lock:
            entry = self.held.pop(path, None)
            if entry:
                entry[0].close()

    def close_all(self) -> None:
        for path in list(self.held):
            self.remove(path)

    def __len__(self) -> int:
        return len(self.held)

    def instances(self) -> list[tuple[str, int]]:
        return sorted((p, n) for p, (_, n) in self.held.items())
