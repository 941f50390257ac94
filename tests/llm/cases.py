"""Rows that every operator must take: nulls, empty and long texts, repeated rows, clashing extra columns."""

import random

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, keeper_id string, id string, name double, a int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def odd_rows():
    base = prose(1, 120)
    rows = [(0, base), (1, base), (2, base + " tail"), (3, ""), (4, None), (5, "..."), (6, prose(2, 30_000)), (7, "one"), (None, base), (8, base), (8, base), (9, "x"), (9, "another text"), (10, ""), (11, "İstanbul ẞ \u0000 end")]
    return [(i, t, "en" if i and i % 2 else None, None if i == 2 else f"s{(i or 0) % 3}", None, "clash", "clash", 1.0, 5) for i, t in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
