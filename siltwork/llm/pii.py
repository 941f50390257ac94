"""Personal identifiers by bootstrapped contextual extraction.

1. Candidates are the spans of a text that look like an identifier: around an @, or of digits, or mixed with digits.
2. Seed entities are candidates that a strict recogniser knows (or that the caller lists): e-mail addresses, IPv4
   addresses, telephone numbers, card numbers, secrets behind a cue. Of the recognisers' values a share, chosen by hash,
   seeds the graph; the others are there for the patterns to find.
3. Every candidate is an instance; its lexical patterns are its shape, its contexts (the word before it, the words before
   it, the word after it, the words on both sides), and the shape together with a context. Seeds induce the patterns they
   occur in. A context without the shape carries a score to identifiers of another form, whose shape the next round uses.
4. The graph of patterns and instances is scored in rounds. An instance can be of a kind if it passes the kind's own check
   (Luhn, octets, an @ in an address, 7 to 15 digits in a telephone number). A pattern's confidence in a kind is the
   summed score of its instances of that kind, over the scores of all kinds, half the seeds' share of the instances that
   could be of the kind but aren't scored (a seed among them would have been one with that chance), and one. An
   instance's score is the noisy-or of its confident patterns.
5. What confident patterns find is reported, seed or not.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

ROUNDS, LEAST_CONFIDENCE, LEAST_SCORE, LEAST_SEEDS, SEED_SHARE = 3, 0.5, 0.5, 2, 0.2
# Whole identifiers come before runs of digits, and a run of digits ends before a place where a whole one begins, so that two
# that stand side by side aren't taken for one, whichever comes first. Nor does a run take the first digits of another word.
_NUMBER = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)|(?<!\w)(?:\d{13,19}|[0-9a-fA-F]{16,})(?!\w)|(?<!\w)[3-6]\d{3}(?:[ -]\d{4}){3}(?!\w)"
_BEGINS = rf"(?<![\w.+%'-])[\w.+%'-]++@[\w.-]*\w|{_NUMBER}|(?<= )\d+[^\W\d]"
_CANDIDATE = re.compile(rf"[\w.+%'-]+@[\w.-]*\w|\+\d{{1,3}} \(\d{{3}}\) \d{{3}}-\d{{4}}(?!\d)|{_NUMBER}|\+?\(?(?!(?<!\w)\d+[^\W\d])\d(?:\d|[().\-: ]{{1,2}}(?!{_BEGINS})\d)+|(?<!\w)[^\W\d]*\d\w*")
_RUN = re.compile(r"[^\W\d_]+")
_CUE = re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|key)\W{1,4}$")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+(?:com|org|net|edu|gov|io)")
_IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_PHONE = re.compile(r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}")
_HEX = re.compile(r"[0-9a-fA-F]{32,}")
_CARD = re.compile(r"[3-6]\d{12,18}")
KINDS = ("card", "email", "ip", "phone", "secret")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def valid(kind: str, value: str) -> bool:
    """A kind's own check: the check digit of a card, the octets or the @ of an address, the digits of a telephone number."""
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        parts = value.split(".")
        return len(parts) == 4 and all(p.isdigit() and int(p) <= 255 for p in parts)
    if kind == "email":
        return "@" in value
    if kind == "phone":
        return 7 <= sum(c.isdigit() for c in value) <= 15 and not any(c.isalpha() for c in value)
    return True


def seed_kind(value: str, before: str) -> str | None:
    """What the strict recognisers say of a candidate."""
    if _EMAIL.fullmatch(value):
        return "email"
    if _IP.fullmatch(value) and valid("ip", value):
        return "ip"
    if _PHONE.fullmatch(value):
        return "phone"
    if _CARD.fullmatch(value) and luhn(value):
        return "card"
    if _HEX.fullmatch(value) and _CUE.search(before):
        return "secret"
    return None


def shape(value: str) -> str:
    """Letters as a; digits as 9, each where the number has one piece, as one where lengths vary."""
    if "@" in value:
        return "a@" + ".".join("a" for _ in value.rpartition("@")[2].split(".")[:1]) + ".a"
    if re.fullmatch(r"[0-9a-fA-F]{16,}", value) and not value.isdigit():
        return f"hex{len(value)}"
    out = _RUN.sub("a", value)
    return re.sub(r"\d+", "9", out) if "." in value or "a" in out else re.sub(r"\d", "9", out)


def _words_before(text: str, at: int, n: int, least: int) -> str:
    """The ``n`` words before a place, and a word's beginning that adjoins it; nothing from before ``least``."""
    i = at
    for _ in range(n):
        i = text.rfind(" ", least, i)
        if i < 0:
            return text[least:at]
    return text[i + 1 : at]


def _words_after(text: str, at: int, n: int, most: int) -> str:
    i = at - 1
    for _ in range(n):
        i = text.find(" ", i + 1, most)
        if i < 0:
            return text[at:most]
    return text[at:i]


def candidates(text: str) -> list[tuple[int, int, str, str | None, list[str]]]:
    """(start, end, value, seed kind, patterns) of a text's candidates.

    A context is up to three whole words; it ends where the third candidate away does, so that a text without blanks costs
    no more than any other.
    """
    out = []
    found = list(_CANDIDATE.finditer(text))
    for k, m in enumerate(found):
        value = m.group()
        a, b = m.span()
        before = _words_before(text, a, 3, found[k - 3].end() if k > 2 else 0)
        after = _words_after(text, b, 3, found[k + 3].start() if k + 3 < len(found) else len(text))
        s = shape(value)
        left = re.sub(r"\d", "9", before.lower()).split(" ")
        right = re.sub(r"\d", "9", after.lower()).split(" ")
        near, far = left[-1] or (left[-2] if len(left) > 1 else ""), " ".join(left)
        next_ = right[0] or (right[1] if len(right) > 1 else "")
        patterns = {s, f"{near} <{s}>", f"{far} <{s}>", f"<{s}> {next_}"}
        # Without the shape; the edge of a text is no context.
        patterns |= {p for p, words in ((f"{near} <>", near), (f"{far} <>", far.strip()), (f"<> {next_}", next_), (f"{far} <> {' '.join(right[:2])}", near and next_)) if words}
        out.append((a, b, value, seed_kind(value, before), sorted(patterns)))
    return out


def _mentions(batches):
    kinds = {"start": pa.int32(), "end": pa.int32(), "value": pa.string(), "seed": pa.string(), "patterns": pa.list_(pa.string())}
    for batch in batches:
        ids, cols = [], ([], [], [], [], [])
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for got in candidates(t):
                ids.append(i)
                for c, x in zip(cols, got):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds.values()))], ["doc_id", *kinds])


def find_identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: DataFrame | None = None, rounds: int = ROUNDS, least_confidence: float = LEAST_CONFIDENCE, least_score: float = LEAST_SCORE, seed_share: float = SEED_SHARE) -> DataFrame:
    """``doc_id, start, end, kind, value, score, is_seed``: the identifiers and their places (characters).

    Of the values that the strict recognisers know, ``seed_share`` are seeds, the first by a hash; ``seeds`` (kind, value) adds
    seed entities, all of which count. Null and empty texts have none. Repeated rows report once. A value that scores
    alike in two kinds gets the alphabetically first. Ids are integers, or are cast to such. Null ids are left out. Empty
    in, empty out.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    schema = "doc_id bigint, start int, end int, value string, seed string, patterns array<string>"
    mentions = cut(rows.mapInArrow(_mentions, schema), "mentions")
    chosen = F.pmod(F.xxhash64("value"), F.lit(1 << 20)) < round(seed_share * (1 << 20))
    known = mentions.where("seed IS NOT NULL").where(chosen).select("value", F.col("seed").alias("kind"))
    if seeds is not None:
        known = known.unionByName(seeds.select(F.col("value").cast("string").alias("value"), F.col("kind").cast("string").alias("kind")).where("value IS NOT NULL AND kind IS NOT NULL"))
    known = cut(known.distinct(), "pii-seeds")
    kinds = sorted(r[0] for r in known.select("kind").distinct().collect())  # few, as recognisers and callers name them

    @F.pandas_udf("array<string>")
    def possible(value: pd.Series) -> pd.Series:
        return pd.Series([[k for k in kinds if valid(k, v)] for v in value])

    values = mentions.select("value").distinct().withColumn("kind", F.explode(possible("value"))).unionByName(known.select("value", "kind")).distinct()
    patterns = mentions.select("value", F.explode("patterns").alias("pattern")).distinct()
    graph = cut(patterns.join(cut(values, "pii-values"), "value"), "pii-graph")
    sizes = graph.groupBy("pattern", "kind").agg(F.count("*").alias("n"))
    scores = known.withColumn("score", F.lit(1.0))
    for k in range(rounds):
        hits = graph.join(scores, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("hit"), F.count("*").alias("scored"))
        hits = hits.join(hits.groupBy("pattern").agg(F.sum("hit").alias("all")), "pattern").where(F.col("hit") >= LEAST_SEEDS).join(sizes, ["pattern", "kind"])
        unknown = seed_share / 2 * (F.col("n") - F.col("scored"))
        confident = hits.withColumn("conf", F.col("hit") / (F.col("all") + unknown + 1)).where(F.col("conf") >= least_confidence)
        found = graph.join(confident.select("pattern", "kind", "conf"), ["pattern", "kind"]).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("conf", F.lit(0.999)))))).alias("score"))
        both = found.unionByName(known.withColumn("score", F.lit(1.0)))
        scores = cut(both.groupBy("value", "kind").agg(F.max("score").alias("score")), f"pii-scores-{k}")

    seed = known.select("value", "kind", F.lit(True).alias("is_seed"))
    best = scores.where(F.col("score") >= least_score).groupBy("value").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind")).alias("b")).select("value", "b.kind", F.round(-F.col("b.s"), 6).alias("score"))
    best = best.join(seed, ["value", "kind"], "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    return mentions.select("doc_id", "start", "end", "value").distinct().join(best, "value").select("doc_id", "start", "end", "kind", "value", "score", "is_seed")
