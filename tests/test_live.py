import json
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from siltwork.operators.index import build_index
from siltwork.schema import SearchOptions
from siltwork.sources.scan import parse_config
from siltwork.streaming import live
from siltwork.streaming.live import LiveEngine, Locked, Registry, WatchLock, Watcher, difference, signature, watch_stream
from tests.test_search import A, B, ITEM, TEST, docs
from tests.test_sources import CONFIG


def put(spark, path, rows):
    build_index(spark.createDataFrame(docs(rows), ITEM), TEST, str(path))


def test_live_engine(spark, tmp_path):
    put(spark, tmp_path, A)
    engine = LiveEngine(spark, str(tmp_path), interval=0)
    assert engine.search(SearchOptions("markdown"))[0]["path"] == "c.md"
    put(spark, tmp_path, B)
    assert engine.search(SearchOptions("网络"))[0]["path"] == "net.md" and engine.fast_search("网络")[0]["path"] == "net.md"
    assert not engine.refresh(force=True)
    engine.close()
    engine.close()
    with pytest.raises(RuntimeError):
        engine.search(SearchOptions("x"))


def test_registry(spark, tmp_path):
    put(spark, tmp_path / "a", A)
    put(spark, tmp_path / "b", B)
    r = Registry()
    one, again, other = (r.open(spark, str(tmp_path / x)) for x in "aab")
    assert one is again and one is not other and len(r) == 2 and r.instances() == [(str(tmp_path / "a"), 2), (str(tmp_path / "b"), 1)]
    r.release(str(tmp_path / "a"))
    assert len(r) == 2
    r.release(str(tmp_path / "a"))
    r.remove(str(tmp_path / "b"))
    r.release("unknown")
    assert len(r) == 0
    r.open(spark, str(tmp_path / "a"))
    r.close_all()
    assert len(r) == 0


def test_lock(spark, tmp_path):
    a, b = WatchLock(spark, str(tmp_path)), WatchLock(spark, f"file://{tmp_path}")
    a.acquire()
    with pytest.raises(Locked):
        b.acquire()
    a.stopped.set()
    (tmp_path / ".watch.lock").write_text(json.dumps({"name": "gone", "pid": 1, "beat": time.time() - 100}))
    # Of several that find it stale, one takes it.
    many = [WatchLock(spark, str(tmp_path)) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda x: x.acquire() is None if not _locked(x) else False, many))
    assert sum(got) <= 1 and sum(x.thread is not None for x in many) == 1
    for x in many:
        x.release()
    a.release()  # it isn't a's any more
    assert not (tmp_path / ".watch.lock").exists()


def _locked(lock):
    try:
        lock.acquire()
    except Locked:
        return True
    lock.acquire = lambda: None
    return False


def test_long_rebuild_keeps_its_lock(spark, tmp_path, monkeypatch):
    """A rebuild that takes longer than a lock lives isn't taken for dead, and its unfinished snapshot stays."""
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.json").write_text('{"title":"one","body":"x"}')
    cfg = parse_config(CONFIG.replace("DIR", str(src)))
    real = live.build_index
    monkeypatch.setattr(live, "build_index", lambda *a, **k: (time.sleep(4), real(*a, **k))[1])
    first, second = (Watcher(spark, cfg, str(tmp_path / "out"), interval=0.1, stale=1.5) for _ in range(2))
    with ThreadPoolExecutor(1) as pool:
        done = pool.submit(first.start)
        time.sleep(3)
        (tmp_path / "out" / "snapshot-unfinished").mkdir()
        with pytest.raises(Locked):
            second.start()
        assert (tmp_path / "out" / "snapshot-unfinished").exists()
        done.result()
    assert first.failed is None and len(LiveEngine(spark, str(tmp_path / "out")).search(SearchOptions("one"))) == 1
    first.lock.release()


def test_searches_side_by_side(spark, tmp_path, monkeypatch):
    """Two searches overlap, and an engine that is replaced meanwhile is closed after its last search."""
    put(spark, tmp_path, A)
    engine = LiveEngine(spark, str(tmp_path), interval=0)
    old = engine.engine
    closed, both = [], threading.Barrier(2, timeout=60)
    monkeypatch.setattr(old, "close", lambda: closed.append(1))
    real = old.search
    monkeypatch.setattr(old, "search", lambda o: (both.wait(), real(o))[1])
    with ThreadPoolExecutor(2) as pool:
        one, two = (pool.submit(engine.search, SearchOptions(q)) for q in ("markdown", "nginx"))
        assert one.result()[0]["path"] == "c.md" and two.result() and not closed
    monkeypatch.setattr(old, "search", lambda o: (put(spark, tmp_path, B), engine.refresh(force=True), closed == [], real(o))[2:])
    kept, rows = engine.search(SearchOptions("markdown"))
    assert kept and rows[0]["path"] == "c.md" and closed == [1] and engine.engine is not old


def test_watcher_and_stream(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.json").write_text('{"title":"one","body":"x"}')
    cfg = parse_config(CONFIG.replace("DIR", str(src)))
    w = Watcher(spark, cfg, str(tmp_path / "out"), interval=0.1)
    w.start()
    engine = LiveEngine(spark, str(tmp_path / "out"), interval=0)
    assert len(engine.search(SearchOptions("one"))) == 1 and not w.tick()
    before = spark.createDataFrame(signature(spark, cfg).collect(), "path string, size bigint, modified bigint")
    (src / "b.json").write_text('{"title":"two","body":"y"}')
    assert w.tick() and len(engine.search(SearchOptions("two"))) == 2
    (src / "a.json").unlink()
    (src / "b.json").write_text('{"title":"three","body":"y"}')
    assert {r.path: r.change for r in difference(before, signature(spark, cfg)).collect()} == {"0:a.json": "deleted", "0:b.json": "added"}
    assert w.tick()
    (src / "b.json").unlink()
    assert not w.tick() and w.failed is not None and engine.search(SearchOptions("three"))[0]["path"] == "b.json"
    w.lock.release()
    with pytest.raises(ValueError):
        Watcher(spark, cfg, str(tmp_path / "o"), interval=0)
    seen = []
    (src / "c.json").write_text("{}")
    q = watch_stream(spark, cfg, 0, str(tmp_path / "cp"), lambda df, n: seen.extend(r.path for r in df.collect()), once=True)
    q.awaitTermination(60)
    assert seen == ["c.json"]
