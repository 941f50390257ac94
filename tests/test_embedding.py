import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltwork.operators.embedding import BertEncoder, HashEncoder, WordPiece, _erf, load_cache, read_safetensors, read_vocabulary, save_cache
from siltwork.operators.index import build_index, load_index
from siltwork.schema import LONGTEXT, CorpusSchema, Field

V, H, P, TV, L, FFN = 32, 8, 4, 2, 4, 16
BODY = CorpusSchema.of("embedding", [Field("body", LONGTEXT, 1, True, True, True)])
ITEM = "id string, path string, source string, tags array<string>, fields map<string,string>"


def tensors(seed=0):
    r = np.random.default_rng(seed)
    t = {"embeddings.word_embeddings.weight": (V, H), "embeddings.position_embeddings.weight": (P, H), "embeddings.token_type_embeddings.weight": (TV, H)}
    norm = ["embeddings.LayerNorm"]
    for k in range(L):
        at = f"encoder.layer.{k}"
        norm += [f"{at}.attention.output.LayerNorm", f"{at}.output.LayerNorm"]
        for n, (o, i) in {"attention.self.query": (H, H), "attention.self.key": (H, H), "attention.self.value": (H, H), "attention.output.dense": (H, H), "intermediate.dense": (FFN, H), "output.dense": (H, FFN)}.items():
            t[f"{at}.{n}.weight"], t[f"{at}.{n}.bias"] = (o, i), (o,)
    for n in norm:
        t[f"{n}.weight"], t[f"{n}.bias"] = (H,), (H,)
    return {k: r.normal(0, 1, s).astype("<f4") for k, s in t.items()}


def write(path, t):
    head, body = {}, b""
    for k, x in t.items():
        head[k] = {"dtype": "F32", "shape": list(x.shape), "data_offsets": [len(body), len(body) + x.nbytes]}
        body += x.tobytes()
    h = json.dumps(head).encode()
    path.write_bytes(len(h).to_bytes(8, "little") + h + body)


@pytest.fixture
def model(tmp_path):
    write(tmp_path / "m.safetensors", tensors())
    (tmp_path / "vocab.txt").write_text("\n".join("[PAD] [CLS] [SEP] [UNK] a ##b 配".split()) + "\n")
    return BertEncoder(str(tmp_path / "m.safetensors"), str(tmp_path / "vocab.txt"))


def slow(t, ids):
    """One sequence, loop by loop."""
    norm = lambda x, n: [(a - sum(x) / H) / math.sqrt(sum((b - sum(x) / H) ** 2 for b in x) / H + 1e-12) * t[n + ".weight"][i] + t[n + ".bias"][i] for i, a in enumerate(x)]
    dense = lambda x, n: [sum(w * a for w, a in zip(row, x)) + b for row, b in zip(t[n + ".weight"], t[n + ".bias"])]
    h = [norm([t["embeddings.word_embeddings.weight"][d][i] + t["embeddings.position_embeddings.weight"][p][i] + t["embeddings.token_type_embeddings.weight"][0][i] for i in range(H)], "embeddings.LayerNorm") for p, d in enumerate(ids)]
    for k in range(L):
        at = f"encoder.layer.{k}"
        q, key, v = ([dense(x, f"{at}.attention.self.{n}") for x in h] for n in ("query", "key", "value"))
        seen = []
        for i in range(len(h)):
            row = []
            for head in range(8):  # one number each: hidden 8, heads 8
                e = [math.exp(q[i][head] * key[j][head]) for j in range(len(h))]
                row.append(sum(x / sum(e) * v[j][head] for j, x in enumerate(e)))
            seen.append(row)
        h = [norm([a + b for a, b in zip(x, dense(s, f"{at}.attention.output.dense"))], f"{at}.attention.output.LayerNorm") for x, s in zip(h, seen)]
        up = [[a * 0.5 * (1 + math.erf(a / math.sqrt(2))) for a in dense(x, f"{at}.intermediate.dense")] for x in h]
        h = [norm([a + b for a, b in zip(x, dense(u, f"{at}.output.dense"))], f"{at}.output.LayerNorm") for x, u in zip(h, up)]
    n = math.sqrt(sum(a * a for a in h[0]))
    return [a / n for a in h[0]]


def test_forward_pass(model):
    t = tensors()
    batch = model.forward([[1, 4, 2], [1, 4, 5, 2], [1, 2]])
    for got, ids in zip(batch, ([1, 4, 2], [1, 4, 5, 2], [1, 2])):
        assert np.allclose(got, slow(t, ids), atol=1e-4)
    assert model.config() == {"vocab": V, "hidden": H, "layers": L, "heads": 8, "ffn": FFN, "positions": P, "types": TV}
    assert model.forward([]).shape == (0, H) and abs(_erf(np.array([0.3]))[0] - math.erf(0.3)) < 1e-6


def test_word_pieces(tmp_path, model):
    w = model.tokens
    assert w.tokenize("ab a配ba。 A") == ["a", "##b", "a", "配", "[UNK]", "[UNK]", "[UNK]"]
    assert w.ids("ab") == [1, 4, 5, 2] and w.ids("") == [1, 2] and len(WordPiece(w.vocab, 8).ids("a " * 50)) == 8
    (tmp_path / "bad.txt").write_text("a\n")
    with pytest.raises(ValueError):
        read_vocabulary(str(tmp_path / "bad.txt"))


def test_bad_models(tmp_path, model):
    t = tensors()
    for drop in ("encoder.layer.3", "embeddings.word_embeddings", "encoder.layer.0.intermediate"):
        write(tmp_path / "b", {k: v for k, v in t.items() if not k.startswith(drop)})
        with pytest.raises(ValueError):
            BertEncoder(str(tmp_path / "b"), str(tmp_path / "vocab.txt"))
    (tmp_path / "short").write_bytes(b"123")
    with pytest.raises(ValueError):
        read_safetensors(str(tmp_path / "short"))


def test_query_cache(model):
    a = model.encode("a")
    assert model.encode("a") is a
    model.reset_cache()
    assert np.allclose(model.encode("a"), a)


def test_cache_round_trip(spark, tmp_path):
    two = spark.createDataFrame([("k1", [1.0, 2.0]), ("k2", [3.0, 4.0])], "key string, vec array<float>")
    save_cache(two, str(tmp_path))
    assert {r.key: r.vec for r in load_cache(spark, str(tmp_path), 2).collect()} == {"k1": [1, 2], "k2": [3, 4]}
    assert load_cache(spark, str(tmp_path), 3).count() == 0 and load_cache(spark, str(tmp_path / "no"), 2).count() == 0


def test_incremental_embedding(spark, tmp_path):
    class Counting(HashEncoder):
        def column(self, text):
            seen = str(tmp_path / "seen")

            @F.udf("array<float>")
            def enc(t):
                with open(seen, "a") as f:
                    f.write(t + "\n")
                return [1.0] * 512

            return enc(text)

    rows = [(str(i), str(i), "", [], {"body": f"text {i}"}) for i in range(3)]
    for n, entries in ((2, 2), (3, 3), (2, 2)):
        build_index(spark.createDataFrame(rows[:n], ITEM), BODY, str(tmp_path / "ix"), Counting(), str(tmp_path / "cache"))
        assert load_cache(spark, str(tmp_path / "cache"), 512).count() == entries
        assert load_index(spark, str(tmp_path / "ix")).vectors.count() == n
    assert sorted((tmp_path / "seen").read_text().split("\n")[:-1]) == ["text 0", "text 1", "text 2"]


def test_model_column(spark, model):
    got = spark.createDataFrame([("a",), ("ab",)], "t string").select(model.column(F.col("t"))).collect()
    assert np.allclose(got[1][0], model.encode("ab"), atol=1e-5)


def test_hash_embed_covers_documents(spark, data):
    """Every document, nulls as the zero vector, against counting piece by piece."""
    from siltwork.functions.hashing import BUCKETS, bucket
    from siltwork.plans.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["hash_embed"](spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got[::5]:
        low, want = texts[r.doc_id].lower(), np.zeros(BUCKETS)
        raw, words = low.encode(), low.split()
        for piece, n in [(raw[i : i + 3], 1) for i in range(len(raw) - 2)] + [(w.encode(), 2) for w in words if len(w.encode()) > 1] + [(f"{a} {b}".encode(), 3) for a, b in zip(words, words[1:])]:
            want[bucket(piece)] += n
        assert np.array_equal(np.array(r.vec, np.float32), (want / (np.linalg.norm(want) or 1)).astype(np.float32)) or np.allclose(r.vec, want / (np.linalg.norm(want) or 1), atol=1e-7)
