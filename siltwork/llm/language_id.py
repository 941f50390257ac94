"""Language identification by words first, backing off to character n-grams.

For each language the model has the relative frequencies of words and of character n-grams (1 to ``MAX_GRAM``, words
padded with blanks). A known word scores minus the log of its frequency in each language, a fixed penalty where a
language doesn't have it. An unseen word is scored by its longest n-grams of which any is known, on average; if none
is, by those one shorter, down to single characters. A text scores the average of its words; the lowest wins.

The model is fitted on at most ``max_train`` labelled rows, the first by a hash of their id. All texts are scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers

MAX_TRAIN, MAX_GRAM, PENALTY, LEAST_WORD, LEAST_GRAM = 4_000, 5, 7.0, 2, 3
_SIGNS = r"[^\pL\pM]+"


def split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, each word's place among them, how many words each text has): runs of letters, in lower case."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), _SIGNS, " "), " "), " ")
    coded = lists.flatten().dictionary_encode()
    # A text without a word is split into one empty string.
    none = pc.index(coded.dictionary, pa.scalar("", pa.large_string())).as_py()
    index, size = coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    if none >= 0:
        keep = index != none
        size = np.bincount(np.repeat(np.arange(len(size)), size)[keep], minlength=len(size))
        index = index[keep]
    return coded.dictionary.to_pylist(), index, size


def words(text: str) -> list[str]:
    distinct, index, _ = split(pa.array([text]))
    return [distinct[i] for i in index]


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _codes(strings: list[str]) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def _hashes(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n characters from each place."""
    up, _ = powers(n)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out += mix(codes[at + k] + np.uint64(1)) * up[k]
    return mix(out)


@dataclass
class Model:
    languages: list[str]
    word: dict[str, np.ndarray]
    gram: dict[str, np.ndarray]
    max_gram: int = MAX_GRAM
    penalty: float = PENALTY

    def word_score(self, word: str) -> np.ndarray:
        """The scores of one word in each language."""
        known = self.word.get(word)
        if known is not None:
            return known
        for n in range(self.max_gram, 0, -1):
            found = [self.gram[g] for g in grams(word, n) if g in self.gram]
            if found:
                return np.mean(found, axis=0)
        return np.full(len(self.languages), self.penalty)

    @cached_property
    def tables(self) -> tuple[dict[str, int], np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """Words' rows, their scores, and by length the grams' sorted hashes and scores."""
        by_size: dict[int, list[str]] = {}
        for g in self.gram:
            by_size.setdefault(len(g), []).append(g)
        sized = {}
        for n, several in by_size.items():
            h = _hashes(_codes(several), np.arange(len(several)) * n, n)
            order = np.argsort(h)
            sized[n] = h[order], np.stack([self.gram[several[i]] for i in order])
        known = np.stack(list(self.word.values())) if self.word else np.empty((0, len(self.languages)))
        return {w: i for i, w in enumerate(self.word)}, known, sized

    def word_scores(self, several: list[str]) -> np.ndarray:
        """:meth:`word_score` of many words at once."""
        row_of, known, sized = self.tables
        row = np.fromiter((row_of.get(w, -1) for w in several), np.int64, len(several))
        out = np.full((len(several), len(self.languages)), self.penalty)
        out[row >= 0] = known[row[row >= 0]]
        open_ = np.flatnonzero(row < 0)
        padded = [f" {several[i]} " for i in open_]
        codes, size = _codes(padded), np.array([len(p) for p in padded], np.int64)
        start = np.cumsum(size) - size
        for n in range(self.max_gram, 0, -1):
            if not len(open_):
                break
            have, scores = sized.get(n, (np.empty(0, np.uint64), None))
            if not len(have):
                continue
            count = np.maximum(size - n + 1, 0)
            of = np.repeat(np.arange(len(open_)), count)
            at = np.repeat(start, count) + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            h = _hashes(codes, at, n)
            place = np.minimum(np.searchsorted(have, h), len(have) - 1)
            hit = have[place] == h
            found = np.bincount(of[hit], minlength=len(open_))
            some = np.flatnonzero(found)
            for k in range(len(self.languages)):
                total = np.bincount(of[hit], scores[place[hit], k], minlength=len(open_))
                out[open_[some], k] = total[some] / found[some]
            rest = found == 0
            open_, size, start = open_[rest], size[rest], start[rest]
        return out

    def batch_scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the average of each text's words' scores, how many words it has); each distinct word is scored once."""
        distinct, index, size = split(texts)
        table = self.word_scores(distinct)
        of = np.repeat(np.arange(len(size)), size)
        total = np.stack([np.bincount(of, table[index, k], minlength=len(size)) for k in range(len(self.languages))], axis=1)
        return total / np.maximum(size, 1)[:, None], size

    def scores(self, text: str) -> np.ndarray | None:
        """The average of the words' scores, None without a word."""
        got, size = self.batch_scores(pa.array([text]))
        return got[0] if size[0] else None


def fit(texts: list[str], langs: list[str], max_gram: int = MAX_GRAM, penalty: float = PENALTY, least_word: int = LEAST_WORD, least_gram: int = LEAST_GRAM) -> Model | None:
    """Relative frequencies by language; None without a labelled word."""
    by_lang: dict[str, Counter] = {}
    for lang in set(langs):
        distinct, index, _ = split(pa.array([t for t, x in zip(texts, langs) if x == lang], pa.string()))
        by_lang[lang] = Counter({distinct[i]: n for i, n in enumerate(np.bincount(index, minlength=len(distinct)).tolist()) if n})
    languages = sorted(x for x, c in by_lang.items() if c)
    if not languages:
        return None

    def table(counts: list[dict[Counter]], least: int) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for k, c in enumerate(counts):
            total = sum(c.values())
            for x, n in c.items():
                if n >= least:
                    out.setdefault(x, np.full(len(languages), penalty))[k] = min(penalty, -math.log10(n / total))
        return out

    word = table([by_lang[x] for x in languages], least_word)
    gram: dict[str, np.ndarray] = {}
    for n in range(1, max_gram + 1):
        counts = []
        for x in languages:
            c: Counter = Counter()
            for w, k in by_lang[x].items():
                for g in grams(w, n):
                    c[g] += k
            counts.append(c)
        gram |= table(counts, least_gram)
    return Model(languages, word, gram, max_gram, penalty)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> Model | None:
    """The model of up to ``max_train`` rows that have a language and a text, also where ids are repeated."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("i IS NOT NULL AND t IS NOT NULL AND l IS NOT NULL AND l <> ''")
    ids = rows.select("i", "l", F.xxhash64("i").alias("h")).orderBy("h", "i", "l").limit(max_train).select("i").distinct()
    chosen = rows.join(F.broadcast(ids), "i").orderBy(F.xxhash64("i"), "i", "l", F.xxhash64("t")).limit(max_train)
    got = chosen.select("t", "l").toPandas()
    return fit(got["t"].tolist(), got["l"].tolist())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN, model: Model | None = None) -> DataFrame:
    """``doc_id, language, score, margin`` for each row with an id; lower scores are better, ``margin`` is to the next language.

    A text without a word (null, empty, digits) or a corpus without labels gives 'und' with null score and margin. Of
    equal scores the first language in alphabetical order wins. Margin is null if there is one language. Repeated rows
    are scored each. Ids are integers, or are cast to such. Null ids are left out. Empty in, empty out.
    """
    model = model or train(docs, id_col, text_col, lang_col, max_train)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    if model is None:
        return rows.selectExpr("doc_id", "'und' AS language", "CAST(NULL AS DOUBLE) AS score", "CAST(NULL AS DOUBLE) AS margin")
    # The model's size is bounded by max_train, not by the data scored.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            got, size = m.batch_scores(batch.column(1))
            best, none = got.argmin(axis=1), size == 0
            low = got[np.arange(len(got)), best]
            margin = np.partition(got, 1, axis=1)[:, 1] - low if len(m.languages) > 1 else np.zeros(len(got))
            langs = names[np.where(none, len(m.languages), best)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(low.round(6), mask=none), pa.array(margin.round(6), mask=none if len(m.languages) > 1 else np.ones(len(got), bool))], ["doc_id", "language", "score", "margin"])

    return rows.mapInArrow(score, "doc_id bigint, language string, score double, margin double")


_SQL = r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, lang FROM documents WHERE doc_id IS NOT NULL),
w AS MATERIALIZED (SELECT r, word, CAST(count(*) AS DOUBLE) AS k FROM (SELECT r, unnest(regexp_extract_all(lower(text), '[\pL\pM]+')) AS word FROM docs) GROUP BY ALL),
train AS MATERIALIZED (SELECT lang, word, sum(k) AS k FROM w JOIN docs USING (r) WHERE lang <> '' GROUP BY ALL),
langs AS (SELECT DISTINCT lang FROM train),
wl AS MATERIALIZED (SELECT lang, word, least({penalty}, -log10(k / t)) AS s FROM train JOIN (SELECT lang, sum(k) AS t FROM train GROUP BY lang) USING (lang) WHERE k >= {least_word}),
known AS MATERIALIZED (SELECT DISTINCT word FROM wl),
open_ AS MATERIALIZED (SELECT DISTINCT word FROM w WHERE word NOT IN (SELECT word FROM known)),
sizes AS (SELECT unnest(range(1, {max_gram} + 1)) AS n),
g AS MATERIALIZED (SELECT lang, n, gram, sum(k) AS c FROM (SELECT lang, k, n, unnest({grams}) AS gram FROM train, sizes) GROUP BY ALL),
gl AS MATERIALIZED (SELECT lang, n, gram, least({penalty}, -log10(c / t)) AS s FROM g JOIN (SELECT lang, n, sum(c) AS t FROM g GROUP BY ALL) USING (lang, n) WHERE c >= {least_gram}),
hit AS MATERIALIZED (SELECT word, n, gram FROM (SELECT word, n, unnest({grams}) AS gram FROM open_, sizes) JOIN (SELECT DISTINCT n, gram FROM gl) USING (n, gram)),
longest AS (SELECT word, max(n) AS n FROM hit GROUP BY word),
score AS MATERIALIZED (
  SELECT word, langs.lang, coalesce(s, {penalty}) AS s FROM known CROSS JOIN langs LEFT JOIN wl USING (word, lang)
  UNION ALL SELECT word, lang, avg(s) FROM (SELECT word, langs.lang, coalesce(s, {penalty}) AS s FROM hit JOIN longest USING (word, n) CROSS JOIN langs LEFT JOIN gl USING (lang, n, gram)) GROUP BY ALL
  UNION ALL SELECT word, lang, {penalty} FROM open_ CROSS JOIN langs WHERE word NOT IN (SELECT word FROM hit)),
ranked AS (SELECT r, lang, x, row_number() OVER (PARTITION BY r ORDER BY round(x, 9), lang) AS p FROM (SELECT r, lang, sum(k * s) / sum(k) AS x FROM w JOIN score USING (word) GROUP BY ALL))
SELECT doc_id, coalesce(a.lang, 'und') AS language, round(a.x, 6) AS score, round(b.x - a.x, 6) AS margin
FROM docs LEFT JOIN (SELECT * FROM ranked WHERE p = 1) AS a USING (r) LEFT JOIN (SELECT * FROM ranked WHERE p = 2) AS b USING (r)"""


def identify_sql() -> str:
    """:func:`identify` of ``documents``, where no more than ``MAX_TRAIN`` rows are labelled, so that all of them are fitted on."""
    grams = "list_transform(range(1, length(word) + 4 - n), lambda i: substring(' ' || word || ' ', i, n))"
    return _SQL.format(penalty=f"CAST({PENALTY} AS DOUBLE)", least_word=LEAST_WORD, least_gram=LEAST_GRAM, max_gram=MAX_GRAM, grams=grams)
