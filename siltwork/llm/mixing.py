"""Mixing sources to target weights by temperature.

The share q of every source in the tokens is exponentiated: weights are q**a / sum(q**a). The exponent a is bisected in
[0, 1]: it is the largest whose weights reach the target entropy (a fraction of the greatest, log of the number of
sources), raised as far as needed that no source is repeated more than ``max_repeats`` times within the budget. The
weights are then realised: each source gets its share of the token budget, filled by blocks. A block is one permutation
of all of the source's documents (ordered by md5 of seed, block and id); whole blocks come first, the last block is
cut where the budget is met.

The permutation is cut without sorting a source in one place: documents fall into 4096 hash buckets of a block, whose
token sums are added up; within a bucket they are ordered row by row. Nor are the sources collected, of which there may be
many: each pass of the bisection sums up a grid of 1,023 exponents at once, which is ten halvings.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, relieve, words_of

ENTROPY, MAX_REPEATS, SEED, STEPS = 0.95, 4.0, "mix-1", 50


def weights(tokens: dict, exponent: float) -> dict:
    """Normalised q**exponent of the sources that have tokens."""
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent for s, n in tokens.items() if n > 0}
    z = sum(raw.values())
    return {s: x / z for s, x in raw.items()}


def entropy(w: dict) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def solve_exponent(tokens: dict, budget: float, target: float = ENTROPY, max_repeats: float = MAX_REPEATS, steps: int = STEPS) -> float:
    """The exponent, by two bisections of [0, 1].

    One source, or none, gives 1. If not even the natural shares (1) respect the repetition limit, the result is 1.
    """
    have = {s: n for s, n in tokens.items() if n > 0}
    if len(have) < 2:
        return 1.0
    goal = target * math.log(len(have))

    def repeats(a: float) -> float:
        w = weights(have, a)
        return max(w[s] * budget / have[s] for s in have)

    def bisect(fits_low) -> tuple[float, float]:
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if fits_low(mid) else (lo, mid)
        return lo, hi

    by_entropy = 1.0 if entropy(weights(have, 1.0)) >= goal else bisect(lambda a: entropy(weights(have, a)) >= goal)[0]
    by_repeats = 0.0 if repeats(0.0) <= max_repeats else bisect(lambda a: repeats(a) > max_repeats)[1]
    return max(by_entropy, by_repeats)


def _plan(sources: DataFrame, factor: float, target: float, max_repeats: float) -> DataFrame:
    """(source, tok, whole, rest): how many whole blocks of a source's tokens, and how many tokens of a last one."""
    total, n = sources.agg(F.sum("tok"), F.count("*")).first()
    if not n:
        return sources.select("source", "tok", F.col("tok").alias("whole"), F.col("tok").alias("rest"))
    budget = factor * total
    shares = sources.withColumn("q", F.col("tok").cast("double") / F.lit(float(total)))
    a = 1.0 if n < 2 else _exponent(shares, budget, target * math.log(n), max_repeats)
    p = F.pow("q", F.lit(a))
    z = shares.agg(F.sum(p)).first()[0]
    goal = F.floor(p / F.lit(z) * F.lit(float(budget)) + 0.5)
    whole = F.floor(goal / F.col("tok"))
    return shares.select("source", "tok", whole.alias("whole"), (goal - whole * F.col("tok")).alias("rest"))


def _exponent(shares: DataFrame, budget: float, goal: float, max_repeats: float) -> float:
    """:func:`solve_exponent` over a table: both bisections at once, ten halvings for each pass over the sources."""

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        """(entropy, most repeats) of the weights with each exponent."""
        at = F.array(*[F.lit(x) for x in exponents])
        each = shares.select("q", "tok", F.posexplode(at).alias("i", "a")).select("i", "tok", F.pow("q", F.col("a")).alias("p"), (F.col("a") * F.log("q")).alias("l"))
        got = each.groupBy("i").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.col("l")).alias("pl"), F.max(F.col("p") / F.col("tok")).alias("r")).collect()
        relieve(shares.sparkSession)
        return [(math.log(x["z"]) - x["pl"] / x["z"], x["r"] / x["z"] * budget) for x in sorted(got, key=lambda x: x["i"])]

    (low_entropy, low_repeats), (natural, _) = sums([0.0, 1.0])
    by_entropy, by_repeats = natural < goal, low_repeats > max_repeats
    e = r = (0.0, 1.0)
    for _ in range(STEPS // 10):
        grid = [lo + k * (hi - lo) / 1024 for lo, hi in (e, r) for k in range(1, 1024)]
        got = sums(grid)
        # As exponents grow the entropy falls and the repeats fall: the halvings end beside the last that is still too small.
        k = sum(h >= goal for h, _ in got[:1023])
        j = sum(x > max_repeats for _, x in got[1023:])
        e, r = (tuple(lo + (hi - lo) * x / 1024 for x in (i, i + 1)) for (lo, hi), i in ((e, k), (r, j)))
    return max(e[0] if by_entropy else 1.0, r[1] if by_repeats else 0.0)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_factor: float = 1.0, target: float = ENTROPY, max_repeats: float = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """``doc_id, source, block, position, n_tokens``: the schedule that realises the weights.

    The budget is ``budget_factor`` times all tokens (words). A document is taken while the tokens before it in its
    source's blocks are below the source's budget, so a source exceeds its budget by less than a document. A source
    without a token is weightless and left out, as are wordless (null, empty) texts: they can't fill a budget. A null
    source is a source of its own, written as ''. Repeated rows are taken once, the one with most tokens. Ties of the
    hash are ordered by id. Ids are integers, or are cast to such. Null ids are left out. Empty in, empty out.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), words_of(F.col(text_col).cast("string")).alias("n_tokens"))
    rows = cut(rows.where("doc_id IS NOT NULL AND n_tokens > 0").groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("m")).select("doc_id", "m.source", "m.n_tokens"), "mix-lengths")
    plan = _plan(cut(rows.groupBy("source").agg(F.sum("n_tokens").alias("tok")), "mix-sources"), budget_factor, target, max_repeats)
    # Sources may be many in another corpus: no broadcast hint, the join's size is Spark's to judge.
    held = rows.join(plan, "source").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole"))).alias("block"))
    held = held.where("block < whole OR rest > 0").withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), F.col("block"), F.col("doc_id"))))
    held = held.withColumn("bucket", F.substring("h", 1, 3))
    sums = held.groupBy("source", "block", "bucket").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    before = Window.partitionBy("source", "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "block", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    within = Window.partitionBy("source", "block", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = held.join(sums, ["source", "block", "bucket"])
    placed = placed.withColumn("before", F.col("t0") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).withColumn("position", F.col("n0") + F.count("*").over(within))
    return placed.where("block < whole OR before < rest").select("doc_id", "source", F.col("block").cast("bigint").alias("block"), F.col("position").cast("bigint").alias("position"), "n_tokens")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The rows of ``docs`` as the schedule takes them: a document comes once for every block that holds it.

    Of rows with the same id all are repeated alike. The other cases are those of :func:`mixture`.
    """
    times = cut(mixture(docs, id_col, text_col, source_col, **kw).groupBy(F.col("doc_id").alias("__taken")).agg(F.count("*").alias("__times")), "mix-times")
    joined = docs.join(times.hint("shuffle_hash"), docs[id_col] == times["__taken"])
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__times")))
    return joined.withColumn("__again", again).select(*[docs[c] for c in docs.columns])


MIX_SQL = """
WITH RECURSIVE lengths AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS BIGINT) AS n_tokens
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
rows_ AS (SELECT doc_id, source, n_tokens FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_tokens DESC, source DESC) AS r FROM lengths WHERE n_tokens > 0) WHERE r = 1),
src AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tok FROM rows_ GROUP BY source),
total AS (SELECT CAST(sum(tok) AS DOUBLE) AS t, count(*) AS k FROM src),
q AS MATERIALIZED (SELECT source, tok, CAST(tok AS DOUBLE) / t AS share, t, k FROM src, total),
ent(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN h >= goal THEN mid ELSE lo END, CASE WHEN h >= goal THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, mid, -sum(p / z * ln(p / z)) AS h, any_value(goal) AS goal FROM (
      SELECT i, lo, hi, mid, pow(share, mid) AS p, sum(pow(share, mid)) OVER () AS z, {entropy} * ln(k) AS goal
      FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid FROM ent WHERE i < {steps}) AS e, q) GROUP BY i, lo, hi, mid)),
rep(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN r > {repeats} THEN mid ELSE lo END, CASE WHEN r > {repeats} THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, mid, max(p / z * {factor} * t / tok) AS r FROM (
      SELECT i, lo, hi, mid, t, tok, pow(share, mid) AS p, sum(pow(share, mid)) OVER () AS z
      FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid FROM rep WHERE i < {steps}) AS e, q) GROUP BY i, lo, hi, mid)),
exponent AS (
  SELECT CASE WHEN (SELECT max(k) FROM q) < 2 THEN 1 ELSE greatest(
    CASE WHEN (SELECT -sum(share * ln(share)) FROM q) >= {entropy} * (SELECT ln(max(k)) FROM q) THEN 1 ELSE (SELECT lo FROM ent WHERE i = {steps}) END,
    CASE WHEN (SELECT max(CAST(1 AS DOUBLE) / k * {factor} * t / tok) FROM q) <= {repeats} THEN 0 ELSE (SELECT hi FROM rep WHERE i = {steps}) END) END AS a),
goals AS (SELECT source, tok, CAST(floor(pow(share, a) / sum(pow(share, a)) OVER () * ({factor} * t) + 0.5) AS BIGINT) AS goal FROM q, exponent),
plan AS (SELECT source, goal // tok AS whole, goal - (goal // tok) * tok AS rest FROM goals),
held AS (SELECT doc_id, source, n_tokens, whole, rest, unnest(range(0, whole + 1)) AS block FROM rows_ JOIN plan USING (source)),
ordered AS (SELECT *, coalesce(sum(n_tokens) OVER w, 0) AS before, count(*) OVER w AS position FROM (SELECT *, md5('{seed}|' || block || '|' || doc_id) AS h FROM held)
  WINDOW w AS (PARTITION BY source, block ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(position AS BIGINT) AS position, n_tokens FROM ordered WHERE block < whole OR before < rest
"""


def mix_sql(factor: float = 1.0, entropy_: float = ENTROPY, repeats: float = MAX_REPEATS, steps: int = STEPS, seed: str = SEED) -> str:
    return MIX_SQL.format(factor=f"CAST({factor} AS DOUBLE)", entropy=f"CAST({entropy_} AS DOUBLE)", repeats=f"CAST({repeats} AS DOUBLE)", steps=steps, seed=seed)
