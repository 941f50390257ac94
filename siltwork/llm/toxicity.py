"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has the probability sigmoid(bias + sum of its features' weights) of being
toxic; a document is toxic if any sentence is (noisy-or). Only documents are labelled: the weights are fitted to
document labels through the noisy-or, and the fitted sentence model then says which sentences offend.

The model is fitted on at most ``max_train`` labelled documents, the first by a hash of their id; a fifth of them is
held out to choose the threshold. Every document is scored over its whole text.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import relieve

MAX_TRAIN = 12_000
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
_WORD = re.compile(r"\w+")
STEM = 5


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text that have a word."""
    return [m.span() for m in _SENTENCE.finditer(text) if _WORD.search(m.group())]


def features(words: set[str]) -> set[str]:
    """A sentence's words and their beginnings."""
    return words | {"^" + w[:STEM] for w in words if len(w) > STEM}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    threshold: float

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability and the (start, end, probability) of its sentences that raise it: those at 0.5 or at
        the threshold, if that is lower; if a toxic document has none, those of the highest probability."""
        total, found = 0.0, []
        low, cache = text.lower(), self.weights
        if len(low) != len(text):  # lower-casing may change the length; then positions are those of single letters
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        n, least = 0, min(0.5, self.threshold)
        base = 1 / (1 + np.exp(-self.bias))
        most, top = 0.0, []
        for m in _SENTENCE.finditer(low):
            words = _WORD.findall(m.group())
            if not words:
                continue
            n += 1
            hit = [x for x in map(cache.get, features(set(words))) if x]
            z = self.bias + sum(hit)
            p = base
            if hit:
                p = 1 / (1 + np.exp(-max(-50.0, min(50.0, z))))
                total += np.log1p(-min(p, 1 - 1e-12))
                n -= 1
            if p >= least:
                found.append((m.start(), m.end(), float(p)))
            elif p >= most:
                top = [*(top if p == most else []), (m.start(), m.end(), float(p))]
                most = p
        total += n * np.log1p(-min(base, 1 - 1e-12))
        q = float(-np.expm1(total))
        return q, found or (top if q >= self.threshold else [])


def fit(texts: list[str], labels: list[int], epochs: int = 300, least_docs: int = 2, l1: float = 1e-5) -> Model | None:
    """Fit by gradient descent (Adam) on the documents' log likelihood; None unless both labels occur.

    Copies of a text count once, a feature must occur in ``least_docs`` documents.
    """
    once = {}
    for t, y in zip(texts, labels):
        once[t] = max(y, once.get(t, 0))
    texts, y = list(once), np.array(list(once.values()), float)
    if len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(texts)) % 5 == 4

    def bag(text: str) -> list[set[str]]:
        low = text.lower()
        return [features(set(_WORD.findall(low[i:j]))) for i, j in sentences(low)]

    # Only what occurs in toxic documents is counted, and no bag is kept: the vocabulary of the rest isn't needed.
    pos: dict[str, int] = {}
    for t, label in zip(texts, y):
        if label:
            for f in set().union(*bag(t)):
                pos[f] = pos.get(f, 0) + 1
    df = {f: 0 for f, n in pos.items() if n >= least_docs}
    for t in texts:
        for f in df.keys() & set().union(*bag(t)):
            df[f] += 1
    base = y.mean()
    # A feature that is no more usual in toxic documents than elsewhere can't raise a sentence's probability.
    names = sorted(f for f, n in df.items() if pos[f] / n > base)
    index = {f: i for i, f in enumerate(names)}
    # Pairs of a sentence and a feature, by sentence, in four bytes each: they are most of what the driver holds here.
    feats, size, docs_ = array("i"), array("i"), array("i")
    plain = np.zeros(len(texts))
    for d, t in enumerate(texts):
        for sent in bag(t):
            ids = [index[f] for f in sent if f in index]
            if ids:
                feats.extend(ids)
                size.append(len(ids))
                docs_.append(d)
            else:
                plain[d] += 1
    feat_of, size, doc_of = (np.frombuffer(x, np.int32) if x else np.empty(0, np.int32) for x in (feats, size, docs_))
    s = len(size)
    # The same pairs by feature: the sentences of each. Every sentence has a feature and every feature a sentence.
    sent_of = np.repeat(np.arange(s, dtype=np.int32), size)[np.argsort(feat_of, kind="stable")]
    by_sent, by_feat = (np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else np.empty(0, np.int64) for n in (size, np.bincount(feat_of, minlength=len(names))))

    def sums(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, begins) if len(begins) else np.zeros(0)

    w, b = np.zeros(len(names)), -4.0
    train = (~held).astype(float)
    n_train = max(1.0, train.sum())
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0

    def logs(w, b):
        z = b + sums(w[feat_of], by_sent)
        p = np.clip(1 / (1 + np.exp(-z)), 1e-12, 1 - 1e-12)
        p0 = min(max(1 / (1 + np.exp(-b)), 1e-12), 1 - 1e-12)
        return p, p0, np.bincount(doc_of, np.log1p(-p), minlength=len(texts)) + plain * np.log1p(-p0)

    for t in range(1, epochs + 1):
        p, p0, log_none = logs(w, b)
        q = np.clip(-np.expm1(log_none), 1e-9, 1 - 1e-9)
        pull = np.where(y > 0, (1 - q) / q, -1.0) * train / n_train  # d loglik / d(-log_none)
        gz = pull[doc_of] * p
        gw = sums(gz[sent_of], by_feat) - l1 * np.sign(w)
        gb = gz.sum() + (pull * plain).sum() * p0
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w + 0.15 * (mw / c1) / (np.sqrt(vw / c2) + 1e-10)
        b = b + 0.15 * (mb / c1) / (np.sqrt(vb / c2) + 1e-10)
        w = np.where(np.abs(w) < 1e-3, 0.0, w)
    q = -np.expm1(logs(w, b)[2])
    check = held if y[held].sum() >= 5 else np.ones(len(y), bool)
    best, threshold = -1.0, 0.5
    for cut_at in np.linspace(0.05, 0.95, 19):
        said = q[check] >= cut_at
        f1 = 2 * (said & (y[check] > 0)).sum() / max(1, said.sum() + y[check].sum())
        if f1 > best + 1e-9 or (abs(f1 - best) <= 1e-9 and abs(cut_at - 0.5) < abs(threshold - 0.5)):
            best, threshold = f1, float(cut_at)
    return Model({f: float(x) for f, x in zip(names, w) if abs(x) > 0.05}, float(b), threshold)


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model | None:
    """The model fitted on up to ``max_train`` labelled documents; None if they don't have both labels.

    Null ids, labels and texts are left out; an id that is labelled twice counts with its highest label.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id IS NOT NULL AND __y IS NOT NULL")
    known = known.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t")).where("__id IS NOT NULL AND __t IS NOT NULL")
    # Of ids that rows repeat, too, no more than max_train rows come to the driver.
    chosen = rows.join(F.broadcast(known), "__id").select(F.xxhash64("__id").alias("__h"), "__id", "__t", "__y").orderBy("__h", "__id", F.xxhash64("__t")).limit(max_train)
    got = chosen.select("__t", "__y").toArrow()
    texts, labels = got.column(0).to_pylist(), [int(y > 0) for y in got.column(1).to_pylist()]
    del got  # the texts are held once
    relieve(docs.sparkSession)  # what fetching them left in the JVM is not to stand beside the fit
    return fit(texts, labels)


_SCHEMA = "doc_id bigint, toxicity double, is_toxic boolean, offending array<struct<start:int,end:int,score:double>>"


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, toxicity, is_toxic, offending`` for each row with an id; ``offending`` are the sentences' places.

    A null, empty or wordless text has toxicity 0. Ids are integers, or are cast to such. Without labels of both kinds nothing can be learned: toxicity is
    null and ``is_toxic`` false. Repeated rows are scored each. Empty in, empty out.
    """
    return _scored(docs, train_toxicity(docs, labels, id_col, text_col, label_col, max_train), id_col, text_col)


def _scored(docs: DataFrame, model: Model | None, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    if model is None:
        none = "CAST(NULL AS DOUBLE) AS toxicity", "false AS is_toxic", "CAST(array() AS array<struct<start:int,end:int,score:double>>) AS offending"
        return rows.selectExpr("doc_id", *none)
    offending = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def score(batches):
        for batch in batches:
            got = [model.score(t) for t in batch.column(1).to_pylist()]
            q = pa.array([x for x, _ in got], pa.float64())
            places = [[{"start": a, "end": b, "score": p} for a, b, p in found] for _, found in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), q, pa.array([x >= model.threshold for x, _ in got], pa.bool_()), pa.array(places, offending)], ["doc_id", "toxicity", "is_toxic", "offending"])

    return rows.mapInArrow(score, _SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, in one pass without a join; rows with a null id go."""
    model = train_toxicity(docs, labels, id_col, text_col, label_col, max_train)
    rows = docs.where(F.col(id_col).isNotNull())
    if model is None:
        return rows

    @F.pandas_udf("boolean")
    def clean(text):
        return text.map(lambda t: not t or model.score(t)[0] < model.threshold)

    return rows.where(clean(F.col(text_col).cast("string")))
