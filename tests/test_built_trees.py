"""Trees built from splits by joins, distances of whole collections, linear tree operations, parameters of model rows; against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladespark.operators import consensus, parameters, posterior, splits, trees
from cladespark.sources import newick
from cladespark.sources.randomtrees import draw, random_trees

TAXA = [f"t{k:02d}" for k in range(9)]


def places(spark):
    return spark.createDataFrame(list(enumerate(TAXA, 1)), "place int, taxon string")


def side(s):
    return frozenset(i for i, c in enumerate(s) if c == "1")


@pytest.fixture(scope="module")
def few(spark):
    return newick.splits(random_trees(spark, 40, TAXA, seed=5))


def test_trees_from_splits_have_those_splits(spark, few):
    """Each random tree, built from its splits and drawn, gives back its splits; the parent is the smallest split around."""
    rows = few.withColumn("mean", F.col("length") + 1.5).withColumn("support", F.lit(0.25)).drop("length")
    nodes = consensus.nodes(rows, places(spark), ["tree_id"])
    texts = consensus.newick(nodes, ["tree_id"])
    again = newick.splits(texts)
    want = {(r["tree_id"], r["split"]) for r in few.collect()}
    got = again.collect()
    assert {(r["tree_id"], r["split"]) for r in got} == want and {r["length"] for r in got} == {1.5}
    of = {}
    for t, s in want:
        of.setdefault(t, []).append(s)
    for r in nodes.where("parent is not null").collect():
        mine = side(r["node"])
        around = [s for s in of[r["tree_id"]] if mine < side(s)]
        assert r["parent"] == min(around, key=lambda s: len(side(s)), default="0" * len(TAXA))
        assert (r["taxon"] is None) == (r["support"] == 0.25)


def test_majority_tree(spark):
    a, b = "((t00,t01),(t02,(t03,t04)));", "(t00,(t01,(t02,(t03,t04))));"
    texts = spark.createDataFrame([(1, a), (2, a), (3, b)], "tree_id long, newick string")
    got = newick.splits(consensus.newick(consensus.majority_tree(newick.splits(texts), places(spark).where("place <= 5")), []).withColumn("tree_id", F.lit(0)))
    assert {r["split"] for r in got.collect()} == {"00111", "00011"}


@pytest.mark.parametrize("alike", [False, True])
def test_distances_of_all_trees(spark, few, alike):
    """Alike trees share nearly all splits, so that most are counted by those that lack them."""
    s = few
    if alike:
        base = few.where("tree_id = 0").select("split", "length")
        s = spark.range(40).select(F.col("id").alias("tree_id")).crossJoin(base).where("tree_id % 7 <> 3 or split < '0001'").union(few.where("tree_id in (4, 9)").selectExpr("tree_id", "split", "length")).distinct()
        s = s.union(spark.createDataFrame([(100, None, None)], "tree_id long, split string, length double"))  # a star
    sets = {}
    for r in s.collect():
        sets.setdefault(r["tree_id"], set()).update([r["split"]] if r["split"] else [])
    asked = spark.createDataFrame([(0,), (4,), (5,), (100,)], "a long").where("a < 100" if not alike else "true")
    got = {(r["a"], r["b"]): r["rf"] for r in splits.robinson_foulds_all(s, asked).collect()}
    lack = lambda x, y: len(x - y) / len(x) if x else 0.0
    want = {(a, b): (lack(sets[a], sets[b]) + lack(sets[b], sets[a])) / 2 for (a,) in asked.collect() for b in sets if a != b}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_distances_need_equal_taxa(spark):
    s = spark.createDataFrame([(1, "0011"), (2, "00011")], "tree_id long, split string")
    with pytest.raises(Exception, match="different taxa"):
        splits.robinson_foulds_all(s, s.select(F.col("tree_id").alias("a"))).collect()


def plain_collapse(rows):
    rows, gone = list(rows), 0
    while (hit := next((r for r in rows if r[1] is not None and not r[5] and r[4] <= 0), None)) is not None:
        gone += 1
        last = max(r[2] for r in rows if r[1] == hit[1])
        rows = [(r[0], hit[1], last + 1 + r[2], *r[3:]) if r[1] == hit[0] else r for r in rows if r[0] != hit[0]]
    return [(*r[:4], max(r[4], 0.0), r[5]) if r[5] else r for r in rows], gone


def test_collapse_and_canonize_by_the_plain_way():
    for k in range(30):
        rng = np.random.default_rng(k)
        rows = [(*r[:4], float(rng.integers(-1, 3)), r[5]) for r in newick.parse(draw(TAXA, rng))]
        (got, n), (want, m) = trees.collapse(rows), plain_collapse(rows)
        assert n == m and newick.render(got, True) == newick.render(want, True)
        low = lambda t: min(x[3] for x in below(t))
        kids = {}
        for r in trees.canonize(rows):
            kids.setdefault(r[1], []).append(r)
        below = lambda r: [r] if r[5] else [x for c in kids[r[0]] for x in below(c)]  # noqa: E731, B023
        for own in kids.values():
            assert [r[0] for r in sorted(own, key=lambda r: r[2])] == [r[0] for r in sorted(own, key=low)]


def test_deep_and_wide_trees():
    """A comb and a star of 100,000 leaves: no recursion, no square."""
    n = 100_000
    comb = "(" * n + "z" + "".join(f",t{n - i}:1)" for i in range(n)) + ";"
    star = "(" + ",".join(f"t{n - i}" for i in range(n)) + ");"
    flat = newick.parse(star)
    assert trees.collapse(trees.canonize(newick.parse(comb)))[1] == n - 1
    assert newick.render(trees.canonize(newick.parse(comb))).count("(") == n
    assert newick.render(trees.canonize(flat)) == "(" + ",".join(sorted(f"t{n - i}" for i in range(n))) + ");"


def test_parameters_of_mixtures(spark):
    model = lambda run, step, k, w, classes: (run, step, k, w, 2.0, classes, [1.0 + k, 3.0], 0.5, 0.1 * k, 0.25, [0.5, 0.5])
    models = [model(0, 1, 1, 3.0, "0 1"), model(0, 1, 0, 1.0, "0 0"), model(1, 1, 5, 2.0, "0 1"), model(1, 2, 0, 2.0, "0 1")]
    frame = spark.createDataFrame(models, "run long, step long, model int, weight double, rmult double, rclass string, rates array<double>, w_norm double, alpha double, pinvar double, freqs array<double>")
    samples = spark.createDataFrame([(0, 1, -5.0), (1, 1, -7.0), (1, 2, -6.0), (0, 2, -4.0)], "run long, step long, x double")
    tree = spark.createDataFrame([(0, 1, "(a,b);")], "run long, step long, newick string")
    rows = parameters.joined(samples, frame, tree)
    assert {(r["run"], r["step"]): (r["nmodels"], r["newick"], [m["weight"] for m in r["models"]]) for r in rows.collect()} == {(0, 1): (2, "(a,b);", [1.0, 3.0]), (1, 1): (1, None, [2.0]), (1, 2): (1, None, [2.0]), (0, 2): (0, None, [])}
    got = {(r["parameter"], r["model"], r["k"]): r for r in parameters.summaries(rows).collect()}
    assert got["lnl", 0, 0]["med"] == -5.5 and got["lnl", 0, 0]["n"] == 4 and got["nmodels", 0, 0]["mean"] == 1.0
    assert got["rate", 0, 0]["n"] == 3 and got["rate", 0, 0]["max_cred"] == 6.0 and got["rate", 1, 1]["mean"] == 3.0 and got["nclasses", 0, 0]["med"] == 2.0
    assert {(r["rclass"], r["nobs"], r["nclasses"]) for r in parameters.class_posterior(rows).collect()} == {("0 1", 2, 2), ("0 0", 1, 1)}


def test_explicit_burn_in(spark):
    s = spark.createDataFrame([(0, k, float(k)) for k in range(0, 100, 10)], "run long, step long, x double")
    assert posterior.burn_in(s, 10, skip=7).count() == 3 and posterior.burn_in(s, 10, skip=0).count() == 10 and posterior.burn_in(s, 10).count() == 5
    with pytest.raises(ValueError):
        posterior.burn_in(s, 10, skip=10)
