import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from siltwork.llm import html_extract as H
from siltwork.llm import mixing, packing
from tests.llm.cases import empty, odd, prose

# ---- wrappers ----

PAGE = "<html><title>{t}</title><script>var x='<p>';</script><!-- c --><ul>{li}</ul><p>always</p>{opt}<div><p>{b}</p></div></html>"


def page(i, n, opt):
    return PAGE.format(t=f"T{i}", li="".join(f"<li><a href='/{k}'>L{k}</a></li>" for k in range(n)), opt=f"<em>note {i}</em>" if opt else "", b=f"body {i} &amp; more")


def test_wrapper_and_slots(spark):
    rows = [(i, f"https://User@A.example.com:80/{i}?q", page(i, 1 + i % 4, i % 2)) for i in range(12)] + [(100, "http://b.example.com", page(100, 2, True))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    wraps = {r.host: r.wrapper for r in H.wrappers(df).collect()}
    assert wraps["a.example.com"] == "<html><title>#</title><ul>(<li><a>#</a></li>)+</ul><p>#</p>(<em>#</em>)?<div><p>#</p></div></html>"
    got = defaultdict(dict)
    for r in H.extract_pages(df).collect():
        got[r.page_id][r.slot] = r.texts
    for i in range(12):
        texts = sorted(map(tuple, got[i].values()))
        # The same paragraph on every page is template; titles, links, notes and bodies are data.
        want = [(f"T{i}",), tuple(f"L{k}" for k in range(1 + i % 4)), (f"body {i} & more",)] + ([(f"note {i}",)] if i % 2 else [])
        assert texts == sorted(want)
    assert len(got[100]) == 5  # a host with one page: every slot is data


def folded(stream):
    return H.show(H.expression(H.tree([(t, "x") for t in stream.split()])))


def test_fold_and_show():
    assert folded("a # /a a # /a a # /a") == "(<a>#</a>)+" and folded("b a /a c /c b a /a a /a c /c") == "(<b/>(<a></a>)+<c></c>)+"
    assert folded("a # /a a # b /b /a") == "(<a>#(<b></b>)?</a>)+" and folded("br # br # br # /x") == "(<br/>#)+</x/>"
    for e in ("<a>#((<b>(#<c/>)+</b>)+)?</a>", "(<x></x>)+", "(<p/><q>#</q>)+</z/>"):
        assert H.show(H.parse(e)) == e


@pytest.mark.parametrize("size", [2, 24, 25, 300])
def test_runs_of_any_length_are_groups(size):
    """A record of any number of siblings is one group, and the same field of each record is one slot."""
    names = [f"t{i}" for i in range(size)]
    record = "".join(f"<{n}>v</{n}>" for n in names)
    for copies, before, after in ((2, "", ""), (3, "<h>x</h>", ""), (5, "<h>x</h>", "<f>y</f>")):
        page = before + record * copies + after
        expr = H.expression(H.tree(H.tokens(page)))
        groups = [n for n in expr if isinstance(n[0], tuple)]
        assert len(groups) == 1 and groups[0][0] == tuple(names) and groups[0][2] and len(expr) == 1 + bool(before) + bool(after)
        slots = H.Reader(H.show(expr)).slots(page)
        assert len(slots) == size + bool(before) + bool(after) and sum(v == ["v"] * copies for v in slots.values()) == size


def test_folding_against_every_run():
    """The copies that are grouped first are the shortest, from the left, as trying all runs says."""
    for seed in range(300):
        r = random.Random(seed)
        x = [r.choice("abcde") for _ in range(r.randint(0, 14))]
        want = next(((n, i) for n in range(2, len(x) // 2 + 1) for i in range(len(x) - 2 * n + 1) if x[i : i + n] == x[i + n : i + 2 * n]), None)
        got = H._copies(x)
        assert (got and (got[0], got[1][0][0])) == want
        for at, n in got[1] if got else ():
            assert x[at : at + got[0]] * n == x[at : at + got[0] * n]


def test_extraction_brute(spark, data):
    """Slots, template and data of every page, against the wrapper applied page by page in plain Python."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    host = lambda u: (u or "").split("://")[-1].split("/")[0].split("@")[-1].split(":")[0].lower()
    by_host = defaultdict(list)
    for i, u, h in rows:
        by_host[host(u)].append((i, h or ""))
    want = set()
    for name, pages in by_host.items():
        wrapper = H.infer(list({H.show(H.expression(H.tree(H.tokens(h)))) for _, h in pages}))
        assert all(derives(H.parse(wrapper), [t for n in H.tree(H.tokens(h)) for t in flat(n)]) for _, h in pages[:5])
        held = [(i, H.Reader(wrapper).slots(h)) for i, h in pages]
        for slot in {s for _, f in held for s in f}:
            texts = [(i, tuple(f[slot])) for i, f in held if slot in f]
            if len(texts) == 1 or len({t for _, t in texts}) > 1:
                want |= {(i, name, t) for i, t in texts}
    got = {(r.page_id, r.host, tuple(r.texts)) for r in H.extract_pages(spark.read.parquet(f"{data}/pages.parquet")).collect()}
    assert got == want and len(got) > 20


def test_many_streams_of_a_host(spark, monkeypatch):
    """However many streams a host has, they are merged few at a time; the wrapper derives each of them."""
    monkeypatch.setattr(H, "FAN", 3)
    r = random.Random(7)
    rows = [(i, "http://a.b/", "".join(f"<{t}>w</{t}>" for t in ("h", "p", "q", "s", "u", "v") if r.random() < 0.7)) for i in range(60)]
    got = H.wrappers(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == 1 and all(derives(H.parse(got[0].wrapper), [t for n in H.tree(H.tokens(h)) for t in flat(n)]) for _, _, h in rows)


def flat(node):
    label, held = node
    if label == "#" or label.endswith("/"):
        return [label.removesuffix("/") if label != "#" else label]
    return [label, *(t for n in held for t in flat(n)), "/" + label]


def derives(expr, stream):
    """Brute force: does the union-free expression derive the stream of tokens?"""

    def ends(nodes, at):
        here = {at}
        for label, body, repeated, optional in nodes:
            def once(p):
                if isinstance(label, tuple):
                    return ends(body, p)
                if label == "#" or label.endswith("/"):
                    return {p + 1} if p < len(stream) and stream[p] == label.removesuffix("/") else set()
                inside = ends(body, p + 1) if p < len(stream) and stream[p] == label else set()
                return {q + 1 for q in inside if q < len(stream) and stream[q] == "/" + label}

            got = set().union(*map(once, here)) if here else set()
            new = got
            while repeated and new:
                new = set().union(*map(once, new)) - got
                got |= new
            here = got | here if optional else got
        return here

    return len(stream) in ends(expr, 0)


@pytest.mark.parametrize("seed", range(25))
def test_wrapper_derives_its_pages(seed):
    r = random.Random(seed)

    def stream():
        out = ["h", "#", "/h"] if r.random() < 0.7 else []
        for _ in range(r.randint(1, 3)):
            out += ["s"] + ["p", "#", "/p"] * r.randint(0, 3) + r.choice([[], ["#", "br"] * r.randint(1, 3) + ["#"], ["q", "p", "/p", "/q"]]) + ["/s"]
        for _ in range(r.randint(0, 3)):
            out += ["b", "#", "br"] + ["p", "#", "/p"] * r.randint(1, 2)
        return out + (["f", "#", "/f"] if r.random() < 0.5 else [])

    pages = [stream() for _ in range(12)]
    exprs = [H.show(H.expression(H.tree([(t, "x") for t in s]))) for s in pages]
    whole = H.parse(H.infer(exprs))
    parts = H.parse(H.infer([H.infer(exprs[:6]), H.infer(exprs[6:])]))
    assert all(derives(H.parse(e), s) for e, s in zip(exprs, pages))
    assert all(derives(whole, s) for s in pages) and all(derives(parts, s) for s in pages)
    # Reading loses no text and finds a slot of the wrapper for each.
    for s in pages:
        html = "".join(f"t{i}" if t == "#" else f"<{t}>" for i, t in enumerate(s))
        got = H.Reader(H.show(whole)).slots(html)
        assert sorted(x for v in got.values() for x in v) == sorted(f"t{i}" for i, t in enumerate(s) if t == "#")
        assert not any("x" in k for k in got)


def test_html_odd(spark):
    rows = [(1, None, None), (2, "nonsense", ""), (None, "http://a.b/", "<p>x</p>"), (3, "http://a.b/", "<p>x</p>"), (3, "http://a.b/", "<p>x</p>"), (4, "http://a.b/", "a < b <3 " + "<i>w</i> " * 5000), (5, "http://a.b/", "<unclosed")]
    df = spark.createDataFrame([(a, b, c, "x", "y") for a, b, c in rows], "page_id bigint, url string, html string, host string, slot string")
    got = H.extract_pages(df).collect()
    assert {r.page_id for r in got} == {3, 4, 5} and len([r for r in got if r.page_id == 3]) == 1
    assert H.extract_pages(df.where("false")).collect() == []


# ---- packing ----


def test_packing_is_lossless(spark):
    r = random.Random(0)
    rows = [(i, prose(i, min(900, int(r.lognormvariate(3, 1.2)) + 1))) for i in range(400)] + [(1000, prose(5, 2500)), (7, prose(3, 5))]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), capacity=256, shard_items=150).collect()
    words = Counter()
    bins = defaultdict(list)
    for x in got:
        words[x.doc_id, x.copy] += x.length
        bins[x.bin].append((x.bin_offset, x.length))
        assert x.word_start == x.piece * 256
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(len(t.split()))
    assert words == {(i, k): n for i, ns in want.items() for k, n in enumerate(sorted(ns, reverse=True))}
    for parts in bins.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 256
    assert len(bins) <= 1.05 * sum(words.values()) / 256 + 5


def optimum(lengths, capacity):
    """The fewest bins, by trying them all."""
    best = len(lengths)

    def place(k, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if k == len(lengths):
            best = len(fills)
            return
        for i in sorted(set(range(len(fills)))):
            if fills[i] + lengths[k] <= capacity:
                place(k + 1, fills[:i] + [fills[i] + lengths[k]] + fills[i + 1 :])
        place(k + 1, fills + [lengths[k]])

    place(0, [])
    return best


def test_search_only_improves():
    better, gap = 0, 0
    for seed in range(60):
        r = random.Random(seed)
        lengths = [r.randint(10, 60) for _ in range(9)]
        start = packing.best_fit(lengths, 100)
        squares = lambda bs: sum(sum(lengths[i] for i in b) ** 2 for b in bs)
        end = packing.improve([list(b) for b in start], lengths, 100)
        assert sorted(i for b in end for i in b) == list(range(9)) and all(sum(lengths[i] for i in b) <= 100 for b in end)
        assert squares(end) >= squares(start) and len(end) <= len(start)
        better += squares(end) > squares(start)
        gap += len(end) - optimum(sorted(lengths, reverse=True), 100)
    assert better > 5 and gap <= 6
    # Best fit leaves (6,4),(5,5) for a worse order; the exchange of one for one empties a bin.
    assert len(packing.improve([[0, 1], [2], [3]], [4, 4, 6, 6], 10)) == 2


def best_shift(a, b, capacity):
    """The largest shift from the emptier bin to the fuller that a move or exchange of up to two for one makes, by trying all."""
    if sum(a) > sum(b):
        a, b = b, a
    room = capacity - sum(b)
    pairs = lambda xs: {x + y for i, x in enumerate(xs) for y in xs[:i]}
    shifts = [*a, *pairs(a), *(x - y for x in [*a, *pairs(a)] for y in b), *(x - y for x in a for y in pairs(b))]
    return max((d for d in shifts if 0 < d <= room), default=0)


@pytest.mark.parametrize("pieces", [5, 64, 65, 300])
def test_exchanges_for_any_number_of_pieces(pieces):
    for seed in range(20):
        r = random.Random(seed)
        low = r.choice([1, 7, 11])
        lengths = [low * r.randint(1, 12) for _ in range(pieces)] + [low * r.randint(1, 12) for _ in range(pieces)]
        a, b = lengths[:pieces], lengths[pieces:]
        capacity = max(sum(a), sum(b)) + r.randint(1, 4)
        want = best_shift(a, b, capacity)
        x, y = packing.Bin(list(range(pieces)), lengths), packing.Bin(list(range(pieces, 2 * pieces)), lengths)
        high = max(x.fill, y.fill)
        assert packing._step(x, y, capacity) == (want > 0)
        assert max(x.fill, y.fill) == high + want and x.fill + y.fill == sum(lengths)
        assert sorted(x.items() + y.items()) == list(range(2 * pieces)) and all(z.fill == sum(lengths[i] for i in z.items()) for z in (x, y))
    # Seven ones and one of seven against a bin of nines with room for one: only two for one fits.
    assert packing._step(packing.Bin([0, 1] + [2] * pieces, [5, 5, 20, 9]), packing.Bin([3] * (3 * pieces), [5, 5, 20, 9]), 27 * pieces + 1)


@pytest.mark.parametrize("seed", range(6))
def test_search_ends_at_a_local_optimum(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 70) for _ in range(r.choice([40, 200]))]
    end = packing.improve(packing.best_fit(lengths, 256), lengths, 256)
    assert sorted(i for b in end for i in b) == list(range(len(lengths)))
    bins = [[lengths[i] for i in b] for b in end]
    assert not any(sum(a) < 256 and sum(b) < 256 and best_shift(a, b, 256) for i, a in enumerate(bins) for b in bins[:i])


def test_packing_odd(spark):
    got = packing.pack(odd(spark)).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 5, 6, 7, 8, 9, 11} and Counter(r.doc_id for r in got)[8] == 2 and Counter(r.doc_id for r in got)[9] == 2
    assert sum(r.length for r in got if r.doc_id == 6) == 30_000
    assert packing.pack(empty(spark)).collect() == []


# ---- mixing ----

TOKENS = {"a": 8000, "b": 900, "c": 100}


def test_exponent():
    for target in (0.5, 0.8, 0.99):
        a = mixing.solve_exponent(TOKENS, 9000, target, 1e9)
        h = mixing.entropy(mixing.weights(TOKENS, a))
        assert a == 1 if mixing.entropy(mixing.weights(TOKENS, 1)) >= target * math.log(3) else abs(h - target * math.log(3)) < 1e-6
    a = mixing.solve_exponent(TOKENS, 9000, 0.99, 4)
    w = mixing.weights(TOKENS, a)
    assert max(w[s] * 9000 / n for s, n in TOKENS.items()) == pytest.approx(4) and sum(w.values()) == pytest.approx(1)
    assert mixing.solve_exponent({}, 0) == mixing.solve_exponent({"a": 5}, 5) == 1 and mixing.solve_exponent({"a": 9, "b": 1}, 100, 0.9, 2) == 1


def test_exponent_over_a_table(spark):
    """The passes over a table of sources find what halving finds on a dictionary."""
    r = random.Random(9)
    for n, target, most in ((2, 0.95, 4), (5, 0.99, 1e9), (40, 0.7, 1.5), (40, 0.999, 3)):
        tokens = {f"s{i}": max(1, int(r.lognormvariate(5, 2))) for i in range(n)}
        total = sum(tokens.values())
        want = mixing.solve_exponent(tokens, total, target, most)
        table = spark.createDataFrame([(s, t, t / total) for s, t in tokens.items()], "source string, tok bigint, q double")
        assert mixing._exponent(table, total, target * math.log(n), most) == pytest.approx(want, abs=1e-12)


def corpus(spark, n=300):
    r = random.Random(2)
    return spark.createDataFrame([(i, prose(i, r.randint(1, 60)), "hot" if i % 10 else f"s{i % 3}") for i in range(n)], "doc_id bigint, text string, source string")


def test_schedule(spark):
    docs = corpus(spark)
    got = mixing.mixture(docs, max_repeats=3).collect()
    tokens, taken = Counter(), Counter()
    for r in docs.collect():
        tokens[r.source] += len(r.text.split())
    blocks = defaultdict(list)
    for x in got:
        taken[x.source] += x.n_tokens
        blocks[x.source, x.block].append(x)
    total = sum(tokens.values())
    w = mixing.weights(tokens, mixing.solve_exponent(tokens, total, mixing.ENTROPY, 3))
    for s in tokens:
        assert 0 <= taken[s] - math.floor(w[s] * total + 0.5) < 60
        last = max(b for t, b in blocks if t == s)
        for b in range(last + 1):
            xs = sorted(blocks[s, b], key=lambda x: x.position)
            assert [x.position for x in xs] == list(range(len(xs))) and len({x.doc_id for x in xs}) == len(xs)
            if b < last:  # whole blocks are permutations of the source
                assert sum(x.n_tokens for x in xs) == tokens[s]
    assert max(taken[s] / tokens[s] for s in tokens) < 3.5 and any(b for _, b in blocks)
    rows = mixing.mix_documents(docs, max_repeats=3)
    assert rows.columns == docs.columns and Counter(r.doc_id for r in rows.collect()) == Counter(x.doc_id for x in got)


def test_schedule_is_the_sql(spark):
    docs = corpus(spark)
    documents = docs.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    for kw in ({}, {"budget_factor": 2.5, "max_repeats": 2.6}, {"target": 0.3}):
        want = con.execute(mixing.mix_sql(kw.get("budget_factor", 1.0), kw.get("target", mixing.ENTROPY), kw.get("max_repeats", mixing.MAX_REPEATS))).fetchall()
        got = [tuple(r) for r in mixing.mixture(docs, **kw).collect()]
        assert sorted(got) == sorted(want) and len(got) > 50


def test_mixing_odd(spark):
    got = mixing.mixture(odd(spark)).collect()
    assert {r.source for r in got} <= {"", "s0", "s1", "s2"} and not {3, 4, 10} & {r.doc_id for r in got} and all(r.doc_id is not None for r in got)
    rows = mixing.mix_documents(odd(spark))
    assert rows.columns == odd(spark).columns and rows.count() >= 5
    assert mixing.mixture(empty(spark)).collect() == [] and mixing.mix_documents(empty(spark)).collect() == []


