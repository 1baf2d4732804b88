"""Joining by rounds over a table of cells, on matrices of path lengths of known trees; and the one-task form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladespark.operators import blockjoin, joining
from cladespark.sources import newick
from cladespark.sources.randomtrees import draw


def path_lengths(rows, n):
    """Distances between leaves t0.. of node rows."""
    up = {r[0]: (r[1], r[4]) for r in rows}
    walk = {}
    for r in rows:
        if r[5]:
            at, far, seen = r[0], 0.0, {}
            while at is not None:
                seen[at] = far
                far += up[at][1]
                at = up[at][0]
            walk[int(r[3][1:])] = seen
    return [(i, j, min(walk[i][k] + walk[j][k] for k in walk[i].keys() & walk[j].keys())) for i in range(n) for j in range(i + 1, n)]


def sides(text, n):
    rows = newick.parse(text)
    below = {r[0]: {int(r[3])} if r[5] else set() for r in rows}
    for r in reversed(rows):
        if r[1] is not None:
            below[r[1]] |= below[r[0]]
    out = set()
    for r in rows:
        s = below[r[0]] if 0 not in below[r[0]] else set(range(n)) - below[r[0]]
        if r[1] is not None and 1 < len(s) < n - 1:
            out.add("".join("1" if k in s else "0" for k in range(n)))
    return out


@pytest.mark.parametrize("seed, n, finish", [(1, 24, 4), (2, 17, 12), (3, 6, 512), (4, 3, 3)])
def test_same_splits_as_in_one_task(spark, seed, n, finish):
    rng = np.random.default_rng(seed)
    rows = [(*r[:4], float(rng.uniform(0.1, 2.0)), r[5]) for r in newick.parse(draw([f"t{k}" for k in range(n)], rng))]
    cells = path_lengths(rows, n)
    d = np.zeros((n, n))
    for i, j, v in cells:
        d[i, j] = d[j, i] = v
    edges = blockjoin.joined_edges(spark.createDataFrame(cells, "i int, j int, d double"), finish)
    got = edges.collect()
    assert len(got) == 2 * n - 3 and abs(sum(r["length"] for r in got) - sum(r[4] for r in rows if r[1] is not None)) < 1e-6
    found = {r["split"] for r in blockjoin.splits(edges, n).collect()}
    assert found == sides(joining.neighbor_joining(d, [str(k) for k in range(n)]), n) and len(found) == max(n - 3, 0)
    assert edges.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def test_closest_of_all_first(spark):
    """Without relaxation, a matrix of no tree gives the splits of the one-task form."""
    rng = np.random.default_rng(9)
    n = 9
    d = rng.uniform(1, 2, (n, n))
    d = np.triu(d, 1) + np.triu(d, 1).T
    cells = [(i, j, float(d[i, j])) for i in range(n) for j in range(i + 1, n)]
    edges = blockjoin.joined_edges(spark.createDataFrame(cells, "i int, j int, d double"), 4, relaxed=False)
    assert {r["split"] for r in blockjoin.splits(edges, n).collect()} == sides(joining.neighbor_joining(d, [str(k) for k in range(n)]), n)
