"""Hashes and the hash embedding, which needs no model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS, AT_ONCE = 512, 1 << 20


def fnv64(data: bytes) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def bucket(data: bytes) -> int:
    """FNV-1a, 32 bits, into the embedding's buckets."""
    return _fnv32(data) % BUCKETS


def _fnv32(data: bytes, h: int = 0x811C9DC5) -> int:
    for b in data:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def bucket_column(text: Column) -> Column:
    """:func:`bucket` of a text's bytes inside the JVM."""
    code = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(text))), lambda i: F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), i, F.lit(1))), 16, 10).cast("bigint"))
    folded = F.aggregate(code, F.lit(0x811C9DC5).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(F.octet_length(text) == 0, F.lit(0x811C9DC5 % BUCKETS)).otherwise(folded % BUCKETS).cast("int")


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch, and the number of the text that each belongs to."""
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    return raw, np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _fold(raw: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """FNV-1a of many runs of bytes at once, going on from ``h``: the k-th step folds the k-th byte of those that have one."""
    h = h.copy()
    order = np.argsort(-size, kind="stable")
    left = size[order]
    k = 0
    while len(order) and left[0] > k:
        order = order[: np.searchsorted(-left, -k)]
        left = left[: len(order)]
        h[order] = (h[order] ^ raw[start[order] + k]) * np.uint32(0x01000193)
        k += 1
    return h


def hash_embeddings(texts: list[str]) -> np.ndarray:
    """For each text the counts of byte trigrams (1), words of two bytes or more (2) and pairs of words (3) in 512 buckets, at unit length."""
    n = len(texts)
    low = [t.lower() for t in texts]
    at: list[np.ndarray] = []
    weight: list[np.ndarray] = []

    def add(of: np.ndarray, h: np.ndarray, w: float) -> None:
        at.append(of * BUCKETS + h % BUCKETS)
        weight.append(np.full(len(of), w))

    raw, of = _flat([t.encode("utf-8", "replace") for t in low])
    if len(raw) > 2:
        h = np.full(len(raw) - 2, 0x811C9DC5, np.uint32)
        for k in range(3):
            h = (h ^ raw[k : len(raw) - 2 + k]) * np.uint32(0x01000193)
        whole = of[2:] == of[:-2]
        add(of[:-2][whole], h[whole], 1.0)
    # A blank after each word, so that no word runs into the next text.
    raw, of = _flat([" ".join([*t.split(), ""]).encode("utf-8", "replace") for t in low])
    end = np.flatnonzero(raw == 32)
    start = np.concatenate([[0], end[:-1] + 1]).astype(np.int64) if len(end) else end
    size, word_of = end - start, of[end]
    h = _fold(raw, start, size, np.full(len(end), 0x811C9DC5, np.uint32))
    add(word_of[size >= 2], h[size >= 2], 2.0)
    pair = np.flatnonzero(word_of[1:] == word_of[:-1])
    add(word_of[pair], _fold(raw, start[pair + 1], size[pair + 1], (h[pair] ^ np.uint32(32)) * np.uint32(0x01000193)), 3.0)
    out = np.bincount(np.concatenate(at), np.concatenate(weight), minlength=n * BUCKETS).reshape(n, BUCKETS)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def hash_embedding(text: str) -> np.ndarray:
    return hash_embeddings([text])[0]


def embed_all(texts: pd.Series) -> list[np.ndarray]:
    """The vectors of texts, of which so many are hashed at once that they have ``AT_ONCE`` letters or are a single one:
    hashing takes some 60 bytes for each."""
    out: list[np.ndarray] = []
    part: list[str] = []
    size = 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        if part and (size + len(t) > AT_ONCE or len(part) == 256):
            out += list(hash_embeddings(part))
            part, size = [], 0
        part.append(t)
        size += len(t)
    return out + list(hash_embeddings(part)) if part else out


def hash_embed(text: Column) -> Column:
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(embed_all(texts), dtype=object)

    return embed(text)
