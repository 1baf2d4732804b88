"""Random trees, greedy consensus and drawn matrices against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladespark.operators import distance, splits
from cladespark.sources import newick
from cladespark.sources.randomtrees import draw, random_trees


@pytest.mark.parametrize("rooted", [False, True])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 40])
def test_random_tree_has_each_taxon_once(n, rooted):
    rows = newick.parse(draw([f"t{k}" for k in range(n)], np.random.default_rng(n), rooted))
    assert sorted(r[3] for r in rows if r[5]) == sorted(f"t{k}" for k in range(n))
    inner = [sum(x[1] == r[0] for x in rows) for r in rows if not r[5]]
    if n > 3:
        assert sorted(inner) == [2] * len(inner) if rooted else sorted(inner) == [2] * (len(inner) - 1) + [3]


def test_random_shapes_are_even():
    seen = {}
    for k in range(3000):
        rows = newick.parse(draw(list("abcd"), np.random.default_rng([1, k])))
        pair = frozenset(r[3] for r in rows if r[5] and r[1] != 0)
        key = pair if "a" in pair else frozenset("abcd") - pair
        seen[key] = seen.get(key, 0) + 1
    assert len(seen) == 3 and all(850 < v < 1150 for v in seen.values())


@pytest.mark.parametrize("block", [1, 5, 64])
def test_greedy_consensus(spark, block):
    trees = random_trees(spark, 60, [f"t{k}" for k in range(8)], seed=2)
    freqs = splits.majority(newick.splits(trees), 60, 0.0)
    got = {r["split"] for r in splits.greedy_consensus(freqs, 8, block=block).collect()}
    want = []
    for r in sorted(freqs.collect(), key=lambda r: (-r["support"], r["split"])):
        a = {i for i, c in enumerate(r["split"]) if c == "1"}
        if len(want) < 5 and all(not a & b or a <= b or b <= a for _, b in want):
            want.append((r["split"], a))
    assert got == {s for s, _ in want}
    assert {r["split"] for r in splits.greedy_consensus(freqs, 8, support=2.0).collect()} == set()


def test_drawn_matrices(spark):
    d = spark.range(6).select(F.col("id").alias("i")).crossJoin(spark.range(6).select(F.col("id").alias("j"))).where("i < j").withColumn("d", F.col("i") * 10.0 + F.col("j"))
    some = distance.sample_taxa(d, 3, seed=1).collect()
    assert len(some) == 3 and len({x for r in some for x in (r["i"], r["j"])}) == 3 and all(r["d"] == r["i"] * 10 + r["j"] for r in some)
    again = distance.shuffle_taxa(d, seed=1).collect()
    assert sorted((r["i"], r["j"]) for r in again) == [(i, j) for i in range(6) for j in range(i + 1, 6)]
    assert sorted(r["d"] for r in again) == sorted(r["d"] for r in d.collect())
    with pytest.raises(ValueError):
        distance.sample_taxa(d, 1)
