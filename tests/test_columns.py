"""Column functions and relational operators on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from cladespark.functions import numeric
from cladespark.operators import alignment, distance, likelihood, splits, trees
from cladespark.operators.ordering import ranked
from cladespark.sources import newick, phylip


def test_numbers(spark):
    rows = [(12, 18), (0, 5), (7, 0), (2**40, 6**20), (10, 3), (200, 100), (66, 33), (67, 30), (5, 9), (4, 0)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", numeric.gcd(F.col("a"), F.col("b")).alias("g"), numeric.choose(F.col("a"), F.col("b")).alias("c")).collect()
    for r in got:
        assert r["g"] == math.gcd(r["a"], r["b"])
        if r["a"] < 300:
            ways = math.comb(r["a"], r["b"])
            assert r["c"] == (ways if ways < 2**63 else 0)
    z = spark.createDataFrame([(0.5,), (0.975,), (0.0,), (1.5,)], "p double").select(numeric.normal_quantile(F.col("p")).alias("z")).collect()
    assert z[0]["z"] == 0 and z[1]["z"] == pytest.approx(1.959963984540054) and z[2]["z"] is None and z[3]["z"] is None


def test_ranked(spark):
    rows = [(k, (i * 37) % 101, i) for i in range(300) for k in ("hot", "cold")[: 2 if i % 20 == 0 else 1]] + [(None, 5, 1)]
    df = spark.createDataFrame(rows, "k string, x int, i int")
    got = ranked(df, ["k"], [F.col("x"), F.col("i")], "r", "n", value=F.col("x"), running="upto").collect()
    for k in ("hot", "cold", None):
        want = sorted((x, i) for q, x, i in rows if q == k)
        mine = sorted((r["r"], r["x"], r["i"], r["n"], r["upto"]) for r in got if r["k"] == k)
        assert [(x, i) for _, x, i, _, _ in mine] == want and [m[0] for m in mine] == list(range(len(want)))
        assert all(m[3] == len(want) for m in mine) and [m[4] for m in mine] == [sum(x for x, _ in want[: j + 1]) for j in range(len(want))]
    assert ranked(df.where("false"), ["k"], [F.col("x")], "r").count() == 0


def test_deep_trees(spark):
    edges = spark.createDataFrame([("n0", None, 0.0)] + [(f"n{i}", f"n{i - 1}", 1.0) for i in range(1, 40)], "node string, parent string, length double")
    assert {r["node"]: (r["depth"], r["dist"]) for r in trees.depths(edges).collect()} == {f"n{i}": (i, float(i)) for i in range(40)}
    more = edges.union(spark.createDataFrame([("x", "n20", 2.0)], edges.schema))
    assert [(r["a"], r["b"], r["dist"], r["steps"]) for r in trees.patristic(more).collect()] == [("n39", "x", 21.0, 20)]
    assert [(r["a"], r["b"]) for r in trees.patristic(more, of=spark.createDataFrame([("x",)], "leaf string")).collect()] == [("x", "n39")]


def test_blocks_of_pairs(spark, monkeypatch):
    import random

    rng = random.Random(2)
    rows = [(i, [rng.choice((0, 1, 2, 4, 8, 15, 5)) for _ in range(20)]) for i in range(23)]
    monkeypatch.setattr(distance, "BLOCK", 4)
    df = spark.createDataFrame(rows, "tid int, v array<int>")
    for gaps in (False, True):
        got = {(r["i"], r["j"]): (r["fident"], r["n"]) for r in distance.pairs(df, score_gaps=gaps).collect()}
        assert len(got) == 23 * 22 // 2
        for (i, j), (f, n) in got.items():
            sites = [(a or 15 * gaps, b or 15 * gaps) for a, b in zip(rows[i][1], rows[j][1], strict=True)]
            sites = [(a, b) for a, b in sites if a and b]
            assert i < j and n == len(sites) and f == pytest.approx(sum((a & b).bit_count() / a.bit_count() / b.bit_count() for a, b in sites))


def test_phylip_and_render(spark):
    dists = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.5), (1, 2, 3.0)], "i int, j int, d double")
    labels = spark.createDataFrame([(0, "A"), (1, "B"), (2, "a_long_label")], "i int, label string")
    for layout in ("lower", "upper", "full"):
        lines = sorted((r["row"], r["line"]) for r in distance.render_phylip(dists, labels, layout, "%g").collect())
        text = "\n".join(x for _, x in lines)
        assert phylip.parse(text) == (["A", "B", "a_long_label"], [(0, 1, 1.0), (0, 2, 2.5), (1, 2, 3.0)])
    seqs = spark.createDataFrame([(0, "ACGTACGTACGT"), (1, "")], "tid int, seq string")
    assert sorted((r["block"], r["tid"], r["line"]) for r in alignment.render(seqs, 8).collect()) == [(0, 0, "ACGTA CGTAC"), (0, 1, ""), (1, 0, "GT")]


def test_taxa_must_agree(spark):
    got = spark.createDataFrame([(1, "0011"), (2, "011")], "tree_id int, split string")
    with pytest.raises(Exception, match="different taxa"):
        splits.same_taxa(got).collect()
    nan = spark.createDataFrame([(0, 1, float("nan"))], "i int, j int, d double")
    with pytest.raises(Exception, match="no distance"):
        distance.require_defined(nan).collect()


def test_likelihood_of_tables(spark):
    pats = spark.createDataFrame([("x", "AAA", 3), ("x", "ACA", 1), ("y", "TTG", 2)], "dataset string, pattern string, freq long")
    found = spark.createDataFrame([("x", 1, "(A:0.1,B:0.2,C:0.3);"), ("x", 2, "(A:0.1,B:0.2,(C:0.3):0);"), ("y", 1, "(A:1,B:1,C:1);")], "dataset string, tree_id int, newick string")
    models = {"jc": [likelihood.Model()], "g": [likelihood.Model(alpha=0.5, ncat=4)]}
    got = {(r["dataset"], r["tree_id"], r["model"]): r["lnl"] for r in likelihood.tree_lnl(pats, found, models, list("ABC")).collect()}
    assert len(got) == 6 and got["x", 1, "jc"] == pytest.approx(got["x", 2, "jc"])
    want = likelihood.site_lnl("(A:0.1,B:0.2,C:0.3);", list("ABC"), ["AAA", "ACA"], models["g"]) @ [3, 1]
    assert got["x", 1, "g"] == pytest.approx(want)
    two = spark.createDataFrame([("AA", 70), ("AC", 30)], "pattern string, freq long")
    best = likelihood.likeliest_length(two, lambda v: f"(A:0,B:{v!r});", ["A", "B"], models["jc"], 0.01, 2.0, steps=4)
    assert best == pytest.approx(-0.75 * math.log(1 - 0.3 * 4 / 3), abs=0.05)


def test_rewritten_trees(spark):
    df = spark.createDataFrame([(1, "(C:1,(B:2,A:3):4);")], "tree_id int, newick string")
    assert newick.rewrite(df, trees.canonize).first()["newick"] == "((A:3,B:2):4,C:1);"
