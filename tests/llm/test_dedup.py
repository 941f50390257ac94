import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltwork.llm import exact_dedup, minhash, suffix_dedup
from tests.llm.cases import empty, odd, odd_rows, prose


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


# ---- exact ----


def by_hand(rows):
    groups = defaultdict(set)
    for i, t in rows:
        if i is not None and t is not None:
            groups[t].add(i)
    return {(i, min(g), len(g)) for t, g in groups.items() for i in g} | {(i, i, 1) for i, t in rows if i is not None and t is None}


def test_exact_odd(spark):
    rows = [r[:2] for r in odd_rows()]
    got = exact_dedup.exact_duplicates(odd(spark)).collect()
    assert {(r.doc_id, r.keeper_id, r.copies) for r in got} == by_hand(rows) and len(got) == len(set(rows)) - 1  # less the null id
    assert all(r.is_kept == (r.doc_id == r.keeper_id) for r in got)
    assert exact_dedup.exact_duplicates(empty(spark)).collect() == [] and exact_dedup.drop_exact_duplicates(empty(spark)).collect() == []
    kept = exact_dedup.drop_exact_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == {0: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 9: 2, 11: 1}


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_exact_blocks(spark, block):
    r = random.Random(block)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randrange(9)))) for i in range(60)]
    got = exact_dedup.exact_duplicates(texts(spark, rows), block=block).collect()
    assert {(x.doc_id, x.keeper_id, x.copies) for x in got} == by_hand(rows)
    names = exact_dedup.exact_identities(texts(spark, rows), block=block).collect()
    assert len({(x.level, x.name) for x in names}) == len({t for _, t in rows}) and len({x.__getitem__("__id") for x in names}) == 60


def test_blocks_of_long_texts(spark):
    """Cut in three steps, blocks are those of one cut, in order, also of letters of several bytes."""
    rows = [(i, "".join(chr(97 + (i * k) % 26) if k % 5 else "é" for k in range(n))) for i, n in enumerate((0, 1, 2, 5, 64 * 2, 64 * 2 + 1, 64 * 64 * 2, 64 * 64 * 2 + 3, 20_000))]
    got = defaultdict(dict)
    for r in exact_dedup._blocks(texts(spark, rows), "doc_id", "text", 2).collect():
        got[r["__id"]][r["__pos"]] = r["__block"]
    assert all([got[i][k] for k in range(len(got[i]))] == ([t[k : k + 2] for k in range(0, len(t), 2)] or [""]) for i, t in rows)


def test_blocks_that_share_a_hash(spark, monkeypatch):
    """With a hash of two values nearly all blocks collide; their bytes tell them apart."""
    real = exact_dedup._blocks
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "_blocks", lambda *a: real(*a).withColumn("__bh", F.pmod("__bh", F.lit(2))))
    r = random.Random(5)
    rows = [(i, "".join(r.choice("abc") for _ in range(r.randrange(12)))) for i in range(50)]
    assert {(x.doc_id, x.keeper_id, x.copies) for x in exact_dedup.exact_duplicates(texts(spark, rows), block=2).collect()} == by_hand(rows)


# ---- near ----


def brute_near(rows, threshold):
    sets = {i: minhash.shingles(t or "") for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if len(sets[i]) and len(sets[j]) and minhash.jaccard(sets[i], sets[j]) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_near_brute(spark):
    r = random.Random(3)
    rows = []
    for g in range(30):
        base = prose(g, r.choice([8, 40, 200])).split()
        for k in range(r.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(k and max(1, len(words) // 40)):
                words[r.randrange(len(words))] = f"new{r.random()}"
            rows.append((len(rows), " ".join(words)))
    got = {x.doc_id: x.keeper_id for x in minhash.near_groups(texts(spark, rows)).collect()}
    assert got == brute_near(rows, minhash.THRESHOLD)


def test_near_hot_group(spark):
    """Thousands of copies, exact and near, are one group and cost no pairs of each with each."""
    base = prose(9, 60)
    rows = [(i, base) for i in range(2000)] + [(2000 + i, base + f" last{i}") for i in range(300)] + [(5000, prose(77, 60))]
    got = minhash.near_groups(texts(spark, rows)).collect()
    assert {x.keeper_id for x in got} == {0, 5000} and {x.group_size for x in got} == {2300, 1}


def test_near_brute_around_the_threshold(spark):
    """Documents with much in common, on both sides of the threshold: no link between different texts is lost or made."""
    r = random.Random(6)
    rows = []
    for g in range(6):
        base = prose(500 + g, 60).split()
        for _ in range(12):
            words = list(base)
            for _ in range(r.randrange(7)):
                words[r.randrange(len(words))] = f"new{r.random()}"
            rows.append((len(rows), " ".join(words)))
    sets = {i: minhash.shingles(t) for i, t in rows}
    got = {x.doc_id: x.keeper_id for x in minhash.near_groups(texts(spark, rows)).collect()}
    close = [(i, j) for i, _ in rows for j in range(i) if minhash.jaccard(sets[i], sets[j]) >= minhash.THRESHOLD]
    assert len(close) > 60 and sum(got[i] == got[j] for i, j in close) >= 0.98 * len(close)
    want = brute_near(rows, minhash.THRESHOLD)
    assert all(want[i] == want[got[i]] for i, _ in rows)


def test_hot_bucket_of_unlike_documents(spark, monkeypatch):
    """Documents that share a bucket and little else are told apart by their rarest shingles, not pair by pair."""
    asked = []
    real = minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda pairs, *a: (asked.append(pairs.count()), real(pairs, *a))[1])
    monkeypatch.setattr(minhash, "_SALT", minhash._SALT * 0)
    # Half of each text is the same; with all bands' keys made of few hashes, many documents meet.
    common = prose(900, 40)
    rows = [(i, f"{common} {prose(10_000 + i, 40)}") for i in range(600)] + [(700 + i, f"{common} {prose(10_000 + i, 40)} end") for i in range(5)]
    got = {x.doc_id: x.keeper_id for x in minhash.near_groups(texts(spark, rows)).collect()}
    assert got == brute_near(rows, minhash.THRESHOLD) and sum(asked) < 10 * len(rows)


def test_near_odd(spark):
    got = {r.doc_id: (r.keeper_id, r.group_size) for r in minhash.near_groups(odd(spark)).collect()}
    assert got[1] == got[2] == got[8] == (0, 4) and all(got[i] == (i, 1) for i in (3, 4, 5, 6, 7, 9, 10, 11)) and len(got) == 12
    kept = minhash.drop_near_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns and Counter(r.doc_id for r in kept.collect()) == {0: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 9: 2, 10: 1, 11: 1}
    assert minhash.near_groups(empty(spark)).collect() == [] and minhash.drop_near_duplicates(empty(spark)).collect() == []


def test_posterior_bound():
    """The pruning probability is that of the Beta posterior, by integration."""
    least = minhash.least_matches(0.6, 1e-3)
    x = np.linspace(0, 1, 200_001)
    for n, m in least.items():
        def above(m):
            logs = m * np.log(np.maximum(x, 1e-300)) + (n - m) * np.log(np.maximum(1 - x, 1e-300))
            p = np.exp(logs - logs.max())
            return p[x >= 0.6].sum() / p.sum()

        assert above(m) >= 1e-3 > above(m - 1)
    a = np.zeros((2, 128), np.uint16)
    b = np.vstack([np.zeros(128, np.uint16), np.ones(128, np.uint16)])
    assert minhash.survives(a, b, least).tolist() == [0]


def test_signature_estimates():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        n = int(2000 * share)
        est = []
        for _ in range(20):
            common, x, y = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, (2000 - n) // 2, (2000 - n) // 2))
            est.append((minhash.signature(np.concatenate([common, x])) == minhash.signature(np.concatenate([common, y]))).mean())
        assert abs(np.mean(est) - share) < 0.03


# ---- maximal repeats ----


def brute_repeats(docs, least):
    occ = defaultdict(set)
    for d, w in docs.items():
        for i in range(len(w)):
            for n in range(least, len(w) - i + 1):
                occ[tuple(w[i : i + n])].add((d, i))
    out = set()
    for k, o in occ.items():
        left = {docs[d][i - 1] if i else (d, i) for d, i in o}
        right = {docs[d][i + len(k)] if i + len(k) < len(docs[d]) else (d, i) for d, i in o}
        if len(o) > 1 and len(left) > 1 and len(right) > 1:
            out.add((len(k), tuple(sorted(o))))
    return out


def spelled(rows, docs):
    """The repeats as (length, occurrences), with their counts checked; a text's least id stands for its copies in parts of it."""
    by_repeat, copies, known = defaultdict(list), defaultdict(list), {}
    for d, w in docs.items():
        copies[tuple(w)].append(d)
    for x in rows:
        by_repeat[x.repeat_id].append(x)

    def occurrences(repeat):
        """Those of its rows, and those of the longer repeats that they name."""
        if repeat not in known:
            occ = set()
            for x in by_repeat[repeat]:
                w = docs[x.doc_id]
                assert x.n_words == len(w) or x.doc_id == min(copies[tuple(w)])
                occ |= {(d, x.word_start) for d in ([x.doc_id] if x.n_words == len(w) else copies[tuple(w)])}
                if x.longer_id is not None:
                    assert by_repeat[x.longer_id][0].n_words > x.n_words and (x.doc_id, x.word_start) in occurrences(x.longer_id)
                    occ |= occurrences(x.longer_id)
            known[repeat] = occ
        return known[repeat]

    out = set()
    for repeat, several in by_repeat.items():
        occ = occurrences(repeat)
        assert len(several) > 1 and len(occ) == several[0].n_occurrences and len({d for d, _ in occ}) == several[0].n_documents
        assert len({(x.n_words, x.n_occurrences, x.n_documents) for x in several}) == 1
        out.add((several[0].n_words, tuple(sorted(occ))))
    assert len(out) == len(by_repeat)
    return out


def some_docs(seed):
    r = random.Random(seed)
    base = [[r.choice("abcd") for _ in range(r.randint(5, 30))] for _ in range(4)]
    docs = {}
    for d in range(25):
        w = []
        for _ in range(r.randint(1, 3)):
            x = list(r.choice(base))
            if r.random() < 0.5:
                x[r.randrange(len(x))] = r.choice("abcdef")
            w += x[r.randint(0, 5) :]
        docs[d] = w
    docs |= {d: docs[d - 25] for d in range(25, 31)}  # copies
    return docs | {31: ["z"] * 40, 32: ["z"] * 33 + ["q"], 33: ["z"] * 40, 34: ["x", "y", "z"] * 12, 35: ["y", "z", "x"] * 9 + ["z"] * 20}  # runs


@pytest.mark.parametrize("seed,least,gram,per_task,heavy", [(0, 4, 2, 300, 20_000), (1, 6, 3, 40, 20_000), (2, 5, 5, 300, 5), (3, 4, 3, 100, 2), (4, 6, 2, 20_000, 1)])
def test_repeats_brute(spark, monkeypatch, seed, least, gram, per_task, heavy):
    """However the work is divided, and however many groups are heavy: the same repeats."""
    monkeypatch.setattr(suffix_dedup, "STRIDE", 5)
    monkeypatch.setattr(suffix_dedup, "MANY", 1 if heavy < 3 else 50)
    monkeypatch.setattr(suffix_dedup, "COPIES", 1)
    docs = some_docs(seed)
    got = suffix_dedup.maximal_repeats(texts(spark, [(d, " ".join(w)) for d, w in docs.items()]), least=least, gram=gram, per_task=per_task, heavy=heavy).collect()
    assert spelled(got, docs) == brute_repeats(docs, least)


def test_repeats_passage_and_odd(spark):
    passage = prose(100, 55)
    rows = [(i, f"{prose(i, 20)} {passage.upper()}, {prose(50 + i, 30)}") for i in range(5)] + [(9, prose(9, 300))]
    for heavy in (20_000, 2):
        got = suffix_dedup.maximal_repeats(texts(spark, rows), heavy=heavy).collect()
        assert [(x.doc_id, x.n_words, x.word_start) for x in sorted(got)] == [(i, 55, 20) for i in range(5)] and len({x.repeat_id for x in got}) == 1
    found = suffix_dedup.maximal_repeats(odd(spark)).collect()
    assert sorted((x.n_words, x.n_documents, x.doc_id) for x in found) == [(120, 4, i) for i in (0, 1, 2, 8)]
    assert suffix_dedup.maximal_repeats(empty(spark)).collect() == []


def test_repeats_without_blanks(spark):
    """Scripts that have no blanks are compared by letters, and their punctuation isn't part of words."""
    r = random.Random(8)
    letters = [chr(0x4E00 + r.randrange(3000)) for _ in range(400)]
    a, b = "".join(letters[:60]) + "。" + "".join(letters[60:120]), "".join(letters[200:230] + letters[10:110]) + "、" + "".join(letters[230:260])
    got = suffix_dedup.maximal_repeats(texts(spark, [(1, a), (2, b)])).collect()
    assert sorted((x.doc_id, x.word_start, x.n_words) for x in got) == [(1, 10, 100), (2, 30, 100)]
    assert len(minhash.shingles(a)) == 118


def test_long_run_is_linear(spark):
    """A word repeated 20,000 times has as many maximal repeats, and two rows for each."""
    got = suffix_dedup.maximal_repeats(texts(spark, [(1, "spam " * 20_000)]))
    assert tuple(got.selectExpr("count(*)", "count(DISTINCT repeat_id)", "max(n_occurrences)").first()) == (2 * (20_000 - 50), 20_000 - 50, 20_000 - 49)


def test_runs_in_many_documents_cost_what_they_report():
    """The steps of a scan, and its rows, follow the suffixes, for any number of documents, also where each has several runs."""

    def scan(n_docs, gap):
        docs = {d: ["a"] * 300 + (["b", str(d)] + ["a"] * 290) * gap for d in range(n_docs)}
        flat = sorted((w[i:], i and hash(w[i - 1]), d, i) for d, w in docs.items() for i in range(0, len(w), 1 + gap))
        lcp = [0] + [next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))) for (x, *_), (y, *_) in zip(flat, flat[1:])]
        began, rows = time.process_time(), 0
        for _, _, leaves, longer, _ in suffix_dedup.intervals(lcp, [f[1] for f in flat], [f[2] for f in flat], [f[3] for f in flat], 50, lambda i, n: (i, n)):
            rows += len(leaves) + len(longer)
        assert rows <= 2 * len(flat)
        return (time.process_time() - began) / len(flat)

    for gap in (0, 1):
        assert scan(70, gap) < 4 * scan(20, gap) + 1e-6


def test_winnowing():
    h = np.arange(200, dtype=np.uint64)
    at, _ = suffix_dedup.picked(h, 20, 5)
    assert np.diff(at).max() <= 16 and at[0] < 16  # no window goes without


