"""Mixing, collocations and search against plain Python, over odd rows."""

import math
from collections import Counter
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cladespark.llm import collocations, mixing, search
from cladespark.llm.words import Slice, count_words, parts, words


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Rows that repeat an id or a whole row, null ids, a source of one long text, blank slices, a text longer than a part."""
    long = " ".join(f"w{i % 4001} x" for i in range(90_000))
    more = [(3, "one two three. one two three", "fr", "hot", 1, 1, "x", 2, 3, "y", 4), (None, "one two  three", None, "tiny", 1, 1, "x", 2, 3, "y", 4), (90001, long, "en", "alone", 1, 1, "x", 2, 3, "y", 4)]
    out = rows + rows[::5] + more + [(90002 + i, None, None, "blank", 1, 1, "x", 2, 3, "y", 4) for i in range(40)]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, size long, target int, h string, n int, rank long, phrase string, score long").repartition(6), out


def test_parts_cover_a_text_once():
    text = "aa b,cc dd. " * 40 + "y" * 300 + " z"
    raw = np.frombuffer(text.encode(), np.uint8)
    whole = Slice(0, 1, raw, np.array([0, len(raw)]))
    want = words(whole, "phrase")
    for limit in (7, 50, 101):
        for context in (0, 1, 3):
            seen = []
            for s, old in parts(whole, "phrase", limit=limit, context=context):
                w = words(s, "phrase")
                seen += w.code[w.starts >= old].tolist()
                assert context == 0 or not old or (w.starts < old).sum() <= context
            assert seen == want.code.tolist()
    assert count_words(whole, "phrase")[0] == len(want.code)
    several = Slice(0, 4, raw, np.array([0, 0, 5, 13, len(raw)]))
    assert count_words(several).tolist() == words(several).counts.tolist()


def test_targets_and_taken(spark, odd):
    df, rows = odd
    got = mixing.shares(df).collect()
    size = lambda t: len(brute.white(t))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    sums = Counter()
    for r in rows:
        sums[r[3]] += size(r[1])
    names = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, full = Fraction(3, 2) * sum(sums.values()), set()
    while True:  # the excess of those that are full goes to the others by weight
        rest = budget - sum(2 * sums[s] for s in full)
        level = rest / sum(weight[s] for s in names if s not in full)
        new = {s for s in names if 2 * sums[s] <= level * weight[s]} | full
        if new == full:
            break
        full = new
    target = {s: 2 * sums[s] if s in full else level * weight[s] for s in names}
    taken = Counter()
    for r in got:
        assert r["source_size"] == sums[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.shares(df.repartition(3)).collect()))


def test_the_mix_runs_in_order_of_finish_times(odd):
    df, rows = odd
    got = mixing.mixed(df).orderBy("mix_place").collect()
    assert [r["mix_place"] for r in got] == list(range(len(got)))
    target = {r["source"]: r["target"] for r in mixing.shares(df).collect()}
    upto, last, cut = Counter(), 0.0, Counter()
    for r in got:
        n = len(brute.white(r["text"]))
        upto[r["source"]] += n
        assert upto[r["source"]] / target[r["source"]] >= last
        last = upto[r["source"]] / target[r["source"]]
        cut[r["source"]] += r["mix_words"] < n
    assert max(cut.values()) == 1 and got[0].asDict().keys() == {*df.columns, "mix_place", "mix_pass", "mix_words"}
    assert got == mixing.mixed(df).orderBy("mix_place").collect()


def plain_collocations(rows, longest, least, top):
    grams, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang, text = lang or "und", (text or "").translate(brute._LOWER)
        for end in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(end, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            total[lang] += len(w)
            grams.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {g: n for g, n in grams.items() if n >= least and len(g) > 2}
    out, most = {}, Counter()
    for (lang, *w), n in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                most[(lang, *w[i : i + k])] = max(most[(lang, *w[i : i + k])], n)
    for (lang, *w), a in often.items():
        if 100 * most[(lang, *w)] < 50 * a:
            score, k = min((1000000 * a * a // (grams[(lang, *w[:k])] * grams[(lang, *w[k:])]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), a, grams[(lang, *w[:k])], grams[(lang, *w[k:])], total[lang]))
    return {(lang, i + 1, p.decode(), a, l, r, n, -s) for lang, x in out.items() for i, (s, _, p, a, l, r, n) in enumerate(sorted(x)[:top])}  # noqa: E741


@pytest.mark.parametrize("longest, least, top, shard", [(3, 10, 2000, 4 << 20), (4, 4, 500, 30000), (2, 3, 40, 200000)])
def test_collocations(odd, longest, least, top, shard):
    df, rows = odd
    got = collocations.collocations(df, longest, least, top=top, shard=shard).collect()
    assert {tuple(r) for r in got} == plain_collocations(rows, longest, least, top) and got


def test_scores_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**12, 10**12 + 7, 10**12 + 9), (10, 10, 12)], "a long, l long, r long")
    got = [r[0] for r in big.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [10**6 * 10**24 // ((10**12 + 7) * (10**12 + 9)), 10**8 // 120]


def plain_search(rows, items, k):
    docs = [(r[0], brute.alnum(r[1])) for r in rows]
    docs = [(i, Counter(w), len(w)) for i, w in docs if w]
    n, length, df = len(docs), sum(x[2] for x in docs), Counter(t for _, c, _ in docs for t in c)
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, []).extend(brute.alnum(text))
    out = []
    for i, terms in wanted.items():
        found = []
        for doc, c, size in docs:
            m = 25 + (75 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(i, rank + 1, doc, -score) for rank, (score, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize("k, block, impacts", [(10, 1 << 20, 1 << 21), (500, 100, 50)])
def test_search(spark, odd, k, block, impacts):
    df, rows = odd
    texts = [r[1] for r in rows if r[1]][:12]
    items = [*((i, t[:200]) for i, t in enumerate(texts)), (0, "one two one"), (None, "one w7"), (77, None), (78, ""), (79, "nowhere"), (80, "x w7 ONE")]
    got = search.search(df, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)), k, block, impacts)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_search(rows, items, k)


def test_radix_order():
    key = np.random.default_rng(1).integers(0, 1 << 40, 5000)
    key[:100] = 7
    assert (search.radix_order(key) == np.argsort(key, kind="stable")).all()
    assert len(search.radix_order(key[:0])) == 0
