"""Text encoders (hash buckets, or a small BERT on NumPy) and the embedding of fields with a content-hash cache."""

from __future__ import annotations

import json
import math
import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import BUCKETS, hash_embed, hash_embedding
from .. import storage
from ..schema import CorpusSchema

LAYERS, HEADS, BATCH, QUERY_CACHE, MAX_TOKENS = 4, 8, 8, 4096, 512


class HashEncoder:
    """The embedding without a model: the same on the documents' and on the query's side."""

    dim = BUCKETS
    name = "hash-512"

    def encode(self, text: str) -> np.ndarray:
        return hash_embedding(text)

    def column(self, text: Column) -> Column:
        return hash_embed(text)


def read_vocabulary(path: str) -> dict[str, int]:
    """Token ids by the order of the non-empty lines; [CLS] must be there."""
    vocab: dict[str, int] = {}
    with open(path, encoding="utf-8") as f:
        for line in f.read().split("\n"):
            line = line.removesuffix("\r")
            if line:
                vocab[line] = len(vocab)
    if "[CLS]" not in vocab:
        raise ValueError("the vocabulary has no [CLS]")
    return vocab


def _punctuation(c: str) -> bool:
    return "　" <= c <= "〿"


def _ideograph(c: str) -> bool:
    return "一" <= c <= "鿿"


class WordPiece:
    """Greedy longest-match pieces of words between blanks; ideographs and CJK punctuation stand alone; no lower-casing."""

    def __init__(self, vocab: dict[str, int], most: int = MAX_TOKENS):
        self.vocab, self.most = vocab, most

    def pieces(self, word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            mark = "##" if at else ""
            end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in self.vocab), 0)
            if not end:
                return ["[UNK]"]
            out.append(mark + word[at:end])
            at = end
        return out

    def tokenize(self, text: str) -> list[str]:
        words: list[str] = []
        joined = False
        for c in text:
            if c in " \t\n\r":
                joined = False
            elif _punctuation(c) or _ideograph(c):
                words.append(c)
                joined = False
            elif joined:
                words[-1] += c
            else:
                words.append(c)
                joined = True
        return [p for w in words for p in ([w] if _ideograph(w[0]) else self.pieces(w))]

    def ids(self, text: str) -> list[int]:
        unk = self.vocab.get("[UNK]", 0)
        body = [self.vocab.get(t, unk) for t in self.tokenize(text)][: max(1, self.most - 2)]
        return [self.vocab["[CLS]"], *body, self.vocab.get("[SEP]", 0)]


def read_safetensors(path: str) -> dict[str, np.ndarray]:
    """The float32 tensors of a safetensors file."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) < 8:
        raise ValueError("safetensors: the file is too short")
    size = int.from_bytes(data[:8], "little")
    if len(data) < 8 + size:
        raise ValueError("safetensors: the header is cut off")
    body, out = data[8 + size :], {}
    for name, spec in json.loads(data[8 : 8 + size]).items():
        if name == "__metadata__":
            continue
        if spec.get("dtype") != "F32":
            raise ValueError(f"safetensors: {name} is {spec.get('dtype')}, not F32")
        a, b = spec["data_offsets"]
        if not 0 <= a <= b <= len(body) or (b - a) % 4:
            raise ValueError(f"safetensors: {name} lies outside of the file")
        out[name] = np.frombuffer(body[a:b], "<f4").reshape(spec["shape"])
    return out


def _erf(x: np.ndarray) -> np.ndarray:
    """erf to about 1e-7, by the usual Chebyshev fit of erfc; the same for batches of any size."""
    z = np.abs(x)
    t = 1 / (1 + 0.5 * z)
    poly = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    e = np.zeros_like(z)
    for c in reversed(poly):
        e = e * t + c
    return np.sign(x) * (1 - t * np.exp(-z * z + e))


class BertEncoder:
    """Four transformer layers on NumPy: the first token's state at unit length. The weights are broadcast once for all columns."""

    name = "bert"

    def __init__(self, weights: str, vocabulary: str):
        t = read_safetensors(weights)
        for need in ("embeddings.word_embeddings.weight", "embeddings.position_embeddings.weight", "embeddings.token_type_embeddings.weight", "encoder.layer.0.intermediate.dense.weight"):
            if need not in t:
                raise ValueError(f"safetensors: {need} is missing")
        layers = 1 + max(int(k.split(".")[2]) for k in t if k.startswith("encoder.layer."))
        if layers != LAYERS:
            raise ValueError(f"safetensors: {layers} layers; {LAYERS} are supported")
        self.t, self.tokens = t, WordPiece(read_vocabulary(vocabulary))
        self.dim = t["embeddings.word_embeddings.weight"].shape[1]
        self.positions = t["embeddings.position_embeddings.weight"].shape[0]
        self.files = {"model.safetensors": weights, "vocab.txt": vocabulary}
        self.queries: dict[str, np.ndarray] = {}
        self.shared = None

    def config(self) -> dict[str, int]:
        word = self.t["embeddings.word_embeddings.weight"]
        return {"vocab": word.shape[0], "hidden": word.shape[1], "layers": LAYERS, "heads": HEADS, "ffn": self.t["encoder.layer.0.intermediate.dense.weight"].shape[0], "positions": self.positions, "types": self.t["embeddings.token_type_embeddings.weight"].shape[0]}

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        mean = x.mean(axis=-1, keepdims=True)
        var = ((x - mean) ** 2).mean(axis=-1, keepdims=True)
        return (x - mean) / np.sqrt(var + 1e-12) * self.t[f"{name}.weight"] + self.t[f"{name}.bias"]

    def _dense(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.t[f"{name}.weight"].T + self.t[f"{name}.bias"]

    def forward(self, batch: list[list[int]]) -> np.ndarray:
        """One row for each list of ids; shorter lists are padded and masked, longer ones cut at the positions there are."""
        if not batch:
            return np.zeros((0, self.dim), np.float32)
        length = max(1, min(self.positions, max(map(len, batch))))
        pad = self.tokens.vocab.get("[PAD]", 0)
        ids = np.array([(x + [pad] * length)[:length] for x in batch])
        mask = np.array([[1.0] * min(len(x), length) + [0.0] * (length - min(len(x), length)) for x in batch])
        h = self.t["embeddings.word_embeddings.weight"][ids] + self.t["embeddings.position_embeddings.weight"][:length] + self.t["embeddings.token_type_embeddings.weight"][0]
        h = self._norm(h, "embeddings.LayerNorm")
        n, width = len(batch), self.dim // HEADS
        for k in range(LAYERS):
            at = f"encoder.layer.{k}"
            split = lambda x: x.reshape(n, length, HEADS, width).transpose(0, 2, 1, 3)
            q, key, v = (split(self._dense(h, f"{at}.attention.self.{p}")) for p in ("query", "key", "value"))
            scores = q @ key.transpose(0, 1, 3, 2) / math.sqrt(width) + np.where(mask > 0, 0.0, -1e9)[:, None, None, :]
            scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
            seen = (scores / scores.sum(axis=-1, keepdims=True)) @ v
            h = self._norm(h + self._dense(seen.transpose(0, 2, 1, 3).reshape(n, length, self.dim), f"{at}.attention.output.dense"), f"{at}.attention.output.LayerNorm")
            up = self._dense(h, f"{at}.intermediate.dense")
            h = self._norm(h + self._dense(up * 0.5 * (1 + _erf(up / math.sqrt(2))), f"{at}.output.dense"), f"{at}.output.LayerNorm")
        first = h[:, 0]
        size = np.linalg.norm(first, axis=1, keepdims=True)
        return (first / np.where(size > 0, size, 1)).astype(np.float32)

    def encode_all(self, texts: list[str]) -> np.ndarray:
        """Batches of texts of like length."""
        ids = [self.tokens.ids(t) for t in texts]
        out = np.zeros((len(texts), self.dim), np.float32)
        order = sorted(range(len(ids)), key=lambda i: len(ids[i]))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            out[some] = self.forward([ids[i] for i in some])
        return out

    def encode(self, text: str) -> np.ndarray:
        """A query's vector, from the cache if it is there; a full cache is emptied."""
        if text not in self.queries:
            if len(self.queries) >= QUERY_CACHE:
                self.queries.clear()
            self.queries[text] = self.encode_all([text])[0]
        return self.queries[text]

    def reset_cache(self) -> None:
        self.queries.clear()

    def __getstate__(self):
        return {**self.__dict__, "queries": {}, "shared": None}

    def column(self, text: Column) -> Column:
        context = SparkSession.active().sparkContext
        if self.shared is None or self.shared[0] is not context:
            self.shared = context, context.broadcast(self)
        shared = self.shared[1]

        @F.pandas_udf("array<float>")
        def encode(texts: pd.Series) -> pd.Series:
            return pd.Series(shared.value.encode_all([t or "" for t in texts]).tolist())

        return encode(text)


def save_encoder(spark: SparkSession, encoder, folder: str) -> None:
    """Copy an encoder's files beside the index that it made; the hash encoder has none."""
    for name, path in getattr(encoder, "files", {}).items():
        with open(path, "rb") as f:
            storage.write_bytes(spark, f"{folder}/{name}", f.read())


def load_encoder(spark: SparkSession, folder: str, name: str):
    """The encoder whose files a snapshot holds; None if it isn't one that can be restored."""
    if name == HashEncoder.name:
        return HashEncoder()
    if name != BertEncoder.name:
        return None
    with tempfile.TemporaryDirectory() as here:  # read by the driver alone, and only until the weights are in memory
        for file in ("model.safetensors", "vocab.txt"):
            with open(os.path.join(here, file), "wb") as f:
                f.write(storage.read_bytes(spark, f"{folder}/{file}"))
        made = BertEncoder(os.path.join(here, "model.safetensors"), os.path.join(here, "vocab.txt"))
    made.files = {}
    return made


def content_key(text: Column, encoder_name: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(encoder_name), text), 256)


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct (key, text) that the cache (key, vec) doesn't hold."""
    return texts.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def load_cache(spark, folder: str, dim: int) -> DataFrame:
    """The cached (key, vec); empty if there is no cache, it can't be read or has another dimension."""
    empty = spark.createDataFrame([], "key string, vec array<float>")
    if not folder or not storage.is_folder(spark, f"{folder}/entries"):
        return empty
    try:
        cache = spark.read.parquet(f"{folder}/entries")
        first = cache.select(F.size("vec")).first()
    except Exception as e:  # a broken cache is an empty one
        print(f"embedding cache left out: {e}")
        return empty
    return cache if first and first[0] == dim else empty


def save_cache(entries: DataFrame, folder: str) -> None:
    """Replace the cache: written beside, then renamed; what isn't current any more goes."""
    spark = entries.sparkSession
    new = f"{folder}/entries-{uuid.uuid4().hex}"
    entries.select("key", "vec").dropDuplicates(["key"]).write.parquet(new)
    storage.move(spark, new, f"{folder}/entries")


def embed_fields(items: DataFrame, schema: CorpusSchema, encoder, out: str, cache_dir: str = "") -> None:
    """Write (idx, field, vec) for the embeddable fields, encoding only texts that aren't cached; refresh the cache."""
    from .index import field_rows

    spark = items.sparkSession
    rows = field_rows(items, schema).where(F.col("field").isin([f.name for f in schema.embeddable()]))
    rows = rows.withColumn("text", F.substring("text", 1, schema.embed_chars())).withColumn("key", content_key(F.col("text"), encoder.name))
    cache = load_cache(spark, cache_dir, encoder.dim)
    fresh = cache_misses(rows, cache).select("key", encoder.column(F.col("text")).alias("vec"))
    fresh.write.parquet(f"{out}-fresh")
    known = cache.unionByName(spark.read.parquet(f"{out}-fresh"))
    rows.select("idx", "field", "key").join(known, "key").select("idx", "field", "vec").write.partitionBy("field").parquet(out)
    if cache_dir:
        save_cache(known.join(rows.select("key").distinct(), "key", "left_semi"), cache_dir)
    storage.delete(spark, f"{out}-fresh")
