"""Neighbor joining of one matrix that is larger than a task, by rounds over a table of its cells.

In a round every row finds its closest partner by the neighbor-joining criterion. Of the
pairs that are closest to each other, all whose members keep the same difference of
distances to every other node are joined at once: in a matrix of path lengths these are
just the pairs with one node between them, which don't change each other's criterion, so the
tree is that of joining one pair after another. Nodes that are so next to one and the same
other node are next to each other, too, and are joined in pairs among themselves, so a node of
many branches takes as many rounds as their number can be halved. The first round that finds none ends that;
from then on all mutually closest pairs are joined (relaxed), or only the closest of all.
Distances to the new nodes are means of members' distances less half of each joined pair's
own, which is one grouping of the cells. A round costs a few shuffles of the cells that are
left, and no task holds more than its share of them; row sums and partners are a row for
each node. Once few nodes are left, their matrix is one task's.

Path lengths between leaves need no table of cells: a round finds them by blocks of leaves,
three times over, and only what is a row for each node is stored or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, saved
from . import blocks, trees
from .ordering import ranked

#: Differences of distances, against the largest of them, that count as equal.
EQUAL = 1e-5
#: Nodes whose matrix is finished in one task: a megabyte.
FINISH = 512
#: Nodes of one side whose cells are found at once.
TILE = 256


def _both(cells: DataFrame) -> DataFrame:
    way = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"), "d")
    return cells.select(F.explode(F.array(way("i", "j"), way("j", "i"))).alias("c")).select("c.*")


def _even(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (x, y) whose distances to all other nodes differ by the same."""
    both = _both(cells)
    ours = pairs.select("x", F.col("y").alias("z"))
    rows = both.join(ours, "x").where("y <> z").select("x", "z", "y", F.col("d").alias("dx"))
    diff = rows.join(both.select(F.col("x").alias("z"), "y", F.col("d").alias("dz")), ["z", "y"]).groupBy("x", "z").agg((F.max(F.col("dx") - F.col("dz")) - F.min(F.col("dx") - F.col("dz"))).alias("span"), F.max(F.greatest("dx", "dz")).alias("most"))
    return diff.where(F.col("span") <= EQUAL * F.col("most")).select("x", F.col("z").alias("y"))


def _pairs_of_one(even: DataFrame) -> DataFrame:
    """(x, y) of directed even pairs x -> y, one for each x: those that point at each other, and of the others that point at one node two and two."""
    mutual = even.join(even.select(F.col("x").alias("y"), F.col("y").alias("x")), ["x", "y"])
    rest = even.join(mutual.select("x"), "x", "left_anti")
    two = ranked(rest, ["y"], [F.col("x")], "k").groupBy("y", F.floor(F.col("k") / 2).alias("k")).agg(F.min("x").alias("x"), F.max("x").alias("z"))
    return mutual.where("x < y").select("x", "y").union(two.where("x < z").select("x", F.col("z").alias("y")))


def _finish(cells: DataFrame, base: int) -> DataFrame:
    """The joins of what is left, as one group; new nodes are numbered from base on, and the last pair is one edge."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate((pdf["i"], pdf["j"])))
        d = np.zeros((len(ids), len(ids)))
        a, b = np.searchsorted(ids, pdf["i"]), np.searchsorted(ids, pdf["j"])
        d[a, b] = d[b, a] = pdf["d"]
        nodes, out, new = list(ids), [], base
        while len(nodes) > 2:
            m = len(nodes)
            r = d.sum(1) / (m - 2)
            q = d - (r[:, None] + r[None, :])
            np.fill_diagonal(q, np.inf)
            x, y = sorted(divmod(int(q.argmin()), m))
            v = (d[x, y] + r[x] - r[y]) / 2
            out += [(nodes[x], new, v), (nodes[y], new, d[x, y] - v)]
            row = (d[x] + d[y] - d[x, y]) / 2
            row[x] = 0
            d[x], d[:, x] = row, row
            d = np.delete(np.delete(d, y, 0), y, 1)
            nodes[x] = new
            del nodes[y]
            new += 1
        if len(nodes) == 2:
            out.append((nodes[0], nodes[1], d[0, 1]))
        return pd.DataFrame(out, columns=["node", "parent", "length"])

    return cells.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "node long, parent long, length double")


def joined_edges(dists: DataFrame, finish: int = FINISH, relaxed: bool = True) -> DataFrame:
    """(node, parent, length): the edges of the tree of distances (i, j, d) with i < j over taxa 0 to n - 1; inner nodes are numbered from n on. The edge between the last two nodes goes from one to the other."""
    cells = saved(dists.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("d").cast("double").alias("d")), "cells")
    row = cells.agg(F.max("j").alias("last")).first()
    return _rounds(cells, (row["last"] or 0) + 1, None, finish, relaxed, True)


def _rounds(cells: DataFrame, base: int, edges: DataFrame | None, finish: int, relaxed: bool, additive: bool) -> DataFrame:
    """joined_edges() of what is left as cells: new nodes are numbered from base on, edges are those found before."""
    while True:
        sums = _both(cells).groupBy("x").agg(F.sum("d").alias("r"), F.count("*").alias("others"))
        sums = saved(sums, "sums")
        m = sums.count()
        if m <= max(finish, 3):
            break
        share = sums.select("x", (F.col("r") / (m - 2)).alias("r"))
        side = lambda k: share.select(F.col("x").alias(k), F.col("r").alias(f"r{k}"))
        q = cells.join(side("i"), "i").join(side("j"), "j").withColumn("q", F.col("d") - (F.col("ri") + F.col("rj")))
        way = lambda a, b: F.struct(F.col(a).alias("x"), F.struct("q", F.col(b).alias("y")).alias("c"))
        best = q.select(F.explode(F.array(way("i", "j"), way("j", "i"))).alias("w")).select("w.*").groupBy("x").agg(F.min("c").alias("c")).select("x", "c.y", "c.q")
        best = saved(best, "best")
        pairs = None
        if additive:
            low, high = F.least("x", "y"), F.greatest("x", "y")
            even = saved(_even(cells, best.select(low.alias("x"), high.alias("y")).distinct()), "even")
            towards = best.select("x", "y", low.alias("l"), high.alias("h")).join(even.select(F.col("x").alias("l"), F.col("y").alias("h")), ["l", "h"], "left_semi").select("x", "y")
            pairs = saved(_pairs_of_one(saved(towards, "towards")), "pairs")
            additive = not pairs.isEmpty()
        if not additive:
            pairs = best.join(best.select(F.col("x").alias("y"), F.col("y").alias("x"), "q"), ["x", "y", "q"]).where("x < y").select("x", "y")
        pairs = pairs.join(q.select(F.col("i").alias("x"), F.col("j").alias("y"), "d", "q"), ["x", "y"]).join(share, "x").join(share.select(F.col("x").alias("y"), F.col("r").alias("ry")), "y")
        first = (F.col("d") + F.col("r") - F.col("ry")) / 2
        pairs = saved(pairs.select("x", "y", "q", "d", first.alias("vx"), (F.col("d") - first).alias("vy")), "pairs")
        if not additive and not relaxed:
            least = pairs.agg(F.min(F.struct("q", "x", "y")).alias("m"))
            pairs = pairs.join(F.broadcast(least.select("m.x", "m.y")), ["x", "y"])
        # A pair goes by a new number, dealt by the rank of its smaller member.
        pairs = saved(ranked(pairs, [], [F.col("x")], "k").withColumn("new", F.col("k") + base).drop("k"), "pairs")
        made = pairs.count()
        found = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("node"), F.col("new").alias("parent"), F.col("vx").alias("length")), F.struct(F.col("y").alias("node"), F.col("new").alias("parent"), F.col("vy").alias("length")))).alias("e")).select("e.*")
        edges = found if edges is None else edges.union(found)
        member = pairs.select(F.explode(F.array("x", "y")).alias("x"), F.col("new").alias("g"), (F.col("d") / 2).alias("off"))
        of = sums.select("x").join(member, "x", "left").select("x", F.coalesce("g", F.col("x")).alias("g"), F.coalesce("off", F.lit(0.0)).alias("off"))
        of = saved(of, "members")
        to = lambda k: of.select(F.col("x").alias(k), F.col("g").alias(f"g{k}"), F.col("off").alias(f"o{k}"))
        moved = cells.join(to("i"), "i").join(to("j"), "j").where("gi <> gj")
        moved = moved.select(F.least("gi", "gj").alias("i"), F.greatest("gi", "gj").alias("j"), "d", (F.col("oi") + F.col("oj")).alias("o"))
        last, cells = cells, saved(moved.groupBy("i", "j").agg((F.avg("d") - F.first("o")).alias("d")), "cells")
        dropped(last, sums, best, of)  # the pairs are the edges found so far
        base += made
    rest = _finish(cells, base)
    return rest if edges is None else edges.union(rest)


def _sums(left: pa.Table, right: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
    """(x, r): the sums of a group's cells by node."""
    sides = _ways(left, right)
    sums = [np.zeros(len(v)) for v in sides]
    for i, j, d in _tiles(*sides, same):
        sums[0][i : i + len(d)] += d.sum(1)
        if not (same and i == j):
            sums[0 if same else 1][j : j + d.shape[1]] += d.sum(0)
    for t, r in zip((left, right), sums[: 1 if same else 2]):
        yield pa.RecordBatch.from_arrays([t.column("node").combine_chunks(), pa.array(r)], names=["x", "r"])


def _closest(left: pa.Table, right: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
    """(x, q, y): the closest of a group's nodes by the criterion, of equal ones the first."""
    sides, tables = _ways(left, right), (left, right)
    r = [t.column("r").to_numpy() for t in tables]
    low = [np.full(len(v), np.inf) for v in sides]
    at = [np.zeros(len(v), np.int64) for v in sides]

    def less(k, start, q, where):
        own = slice(start, start + len(q))
        better = q < low[k][own]
        low[k][own], at[k][own] = np.where(better, q, low[k][own]), np.where(better, where, at[k][own])

    for i, j, d in _tiles(*sides, same):
        d -= r[0][i : i + d.shape[0], None]
        d -= r[1][j : j + d.shape[1]]
        if same and i == j:
            np.fill_diagonal(d, np.inf)
        else:
            k = d.argmin(0)
            less(0 if same else 1, j, d[k, np.arange(d.shape[1])], i + k)
        k = d.argmin(1)
        less(0, i, d[np.arange(d.shape[0]), k], j + k)
    for k in range(1 if same else 2):
        known = np.isfinite(low[k])
        other = tables[0 if same else 1 - k].column("node").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(tables[k].column("node").to_numpy()[known]), pa.array(low[k][known]), pa.array(other[at[k][known]])], names=["x", "q", "y"])


def _spans(left: pa.Table, right: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
    """(x, y, low, high, most): for pairs of nodes the range of their differences to a group's other nodes, and the largest distance of both."""
    a, z, b = trees.ways(*((t.column(f"path{k}"), t.column(f"up{k}")) for t, k in ((left, ""), (left, "2"), (right, ""))))
    x, y, node = left.column("node").to_numpy(), left.column("other").to_numpy(), right.column("node").to_numpy()
    low, high, most = np.full(len(x), np.inf), np.full(len(x), -np.inf), np.full(len(x), -np.inf)
    for i in range(0, len(x), TILE):
        own = slice(i, i + TILE)
        for j in range(0, len(node), TILE):
            k = node[j : j + TILE]
            dx, dy = trees.lengths(a[own], b[j : j + TILE])[0], trees.lengths(z[own], b[j : j + TILE])[0]
            r, c = np.nonzero((x[own, None] == k) | (y[own, None] == k)) if np.isin(k, x[own]).any() or np.isin(k, y[own]).any() else ((), ())
            dx[r, c] = dy[r, c] = -np.inf
            most[own] = np.maximum(most[own], np.maximum(dx.max(1), dy.max(1)))
            dx[r, c] = dy[r, c] = 0.0
            dx -= dy
            dx[r, c] = np.inf
            low[own] = np.minimum(low[own], dx.min(1))
            dx[r, c] = -np.inf
            high[own] = np.maximum(high[own], dx.max(1))
    yield pa.RecordBatch.from_arrays([left.column("node").combine_chunks(), left.column("other").combine_chunks(), *map(pa.array, (low, high, most))], names=["x", "y", "low", "high", "most"])


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d of rows with two paths."""
    for batch in batches:
        if len(batch):
            t = pa.Table.from_batches([batch])
            a, b = trees.ways((t.column("path"), t.column("up")), (t.column("path2"), t.column("up2")))
            d = np.concatenate([trees.lengths(a[k : k + 1], b[k : k + 1])[0].ravel() for k in range(len(a))])
            yield pa.RecordBatch.from_arrays([t.column("x").combine_chunks(), t.column("y").combine_chunks(), pa.array(d)], names=["x", "y", "d"])


def _cells(left: pa.Table, right: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
    """(i, j, d) of a group's cells, i < j."""
    a, b = (t.column("node").to_numpy() for t in (left, right))
    for i, j, d in _tiles(*_ways(left, right), same):
        r, c = np.triu_indices(len(d), 1) if same and i == j else map(np.ravel, np.indices(d.shape))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i + r], b[j + c])), pa.array(np.maximum(a[i + r], b[j + c])), pa.array(d[r, c])], names=["i", "j", "d"])


def _ways(*tables: pa.Table) -> list[trees.Ways]:
    return trees.ways(*((t.column("path"), t.column("up")) for t in tables))


def _tiles(a: trees.Ways, b: trees.Ways, same: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """The tiles of a group's cells with their places; of one table's, those on the diagonal and right of it."""
    for i in range(0, len(a), TILE):
        for j in range(i if same else 0, len(b), TILE):
            d = trees.lengths(a[i : i + TILE], b[j : j + TILE])[0]
            if same and i == j:
                np.fill_diagonal(d, 0.0)
            yield i, j, d


def joined_paths(leaves: DataFrame, finish: int = FINISH, relaxed: bool = True) -> DataFrame:
    """joined_edges() of the path lengths between leaves (k, path, up) of trees.paths(), k from 0 to n - 1, whose cells are found by blocks whenever they are read and never stored.

    A joined pair goes on as its first member with the distances less its branch's length, as
    the second one's are the same then. Once no pair agrees on all other nodes, what is left
    goes on as a table of cells.
    """
    order = ranked(leaves.select(F.col("k").cast("long").alias("node"), "path", "up"), [], [F.concat_ws("/", "path"), F.col("node")], "place")
    nodes = saved(order, "nodes")  # in the order of paths, so that most tiles have one ancestor on a side
    m = base = nodes.count()
    edges = None
    while m > max(finish, 3):
        sums = saved(blocks.meet(nodes, "place", _sums, "x long, r double").groupBy("x").agg((F.sum("r") / (m - 2)).alias("r")), "sums")
        asked = nodes.join(sums.withColumnRenamed("x", "node"), "node")
        best = blocks.meet(asked, "place", _closest, "x long, q double, y long").groupBy("x").agg(F.min(F.struct("q", "y")).alias("c")).select("x", "c.y")
        best = saved(best.withColumns({"l": F.least("x", "y"), "h": F.greatest("x", "y")}), "best")
        at = lambda k: nodes.select(F.col("node").alias("h"), *[F.col(c).alias(f"{c}{k}") for c in ("path", "up")])
        two = nodes.join(best.select(F.col("l").alias("node"), "h").distinct(), "node").join(at("2"), "h").withColumnRenamed("h", "other")
        none = nodes.withColumn("other", F.lit(None).cast("long")).withColumns({f"{c}2": F.slice(c, 1, 0) for c in ("path", "up")})
        spans = blocks.meet(two, "place", _spans, "x long, y long, low double, high double, most double", none)
        even = spans.groupBy("x", "y").agg((F.max("high") - F.min("low")).alias("span"), F.max("most").alias("most")).where(F.col("span") <= EQUAL * F.col("most"))
        towards = saved(best.join(even.select(F.col("x").alias("l"), F.col("y").alias("h")), ["l", "h"], "left_semi").select("x", "y"), "towards")
        pairs = _pairs_of_one(towards).withColumnRenamed("y", "h").join(at("2"), "h").withColumnRenamed("h", "y").join(nodes.select(F.col("node").alias("x"), "path", "up"), "x")
        pairs = pairs.select("x", "y", "path", "up", "path2", "up2").mapInArrow(_between, "x long, y long, d double")
        side = lambda k: sums.select(F.col("x").alias(k), F.col("r").alias(f"r{k}"))
        pairs = pairs.join(side("x"), "x").join(side("y"), "y").withColumn("vx", (F.col("d") + F.col("rx") - F.col("ry")) / 2)
        pairs = saved(ranked(pairs, [], [F.col("x")], "k").select("x", "y", (F.col("k") + base).alias("new"), "vx", (F.col("d") - F.col("vx")).alias("vy")), "pairs")
        made = pairs.count()
        if not made:
            cells = saved(blocks.meet(nodes, "place", _cells, "i long, j long, d double"), "cells")
            return _rounds(cells, base, edges, finish, relaxed, False)
        found = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("node"), F.col("new").alias("parent"), F.col("vx").alias("length")), F.struct(F.col("y").alias("node"), F.col("new").alias("parent"), F.col("vy").alias("length")))).alias("e")).select("e.*")
        edges = found if edges is None else edges.union(found)
        kept = nodes.join(pairs.select(F.col("y").alias("node")), "node", "left_anti").join(pairs.select(F.col("x").alias("node"), "new", "vx"), "node", "left")
        off = F.coalesce("vx", F.lit(0.0))
        last, nodes = nodes, saved(kept.select(F.coalesce("new", "node").alias("node"), "path", F.transform("up", lambda u: u - off).alias("up"), "place"), "nodes")
        dropped(last, sums, best, towards)  # the pairs are the edges found so far
        m, base = m - made, base + made
    rest = _finish(blocks.meet(nodes, "place", _cells, "i long, j long, d double"), base)
    return rest if edges is None else edges.union(rest)


def splits(edges: DataFrame, taxa: int) -> DataFrame:
    """(split, length) of the inner edges of joined_edges(), 0/1 text over taxa 0 to taxa - 1 with the first one's side 0. The leaves below a node are gathered as its text, which has a character for each taxon."""
    from .splits import canonical
    from .trees import ancestors

    leaf = edges.where(F.col("node") < taxa).select(F.col("node").alias("leaf"))
    up = ancestors(edges, leaf).select("leaf", F.col("child").alias("node"))
    bits = up.where(F.col("node") >= taxa).groupBy("node").agg(F.collect_set("leaf").alias("below"))

    def marks(below):
        out = bytearray(b"0" * taxa)
        for k in below:
            out[k] = 49
        return out.decode()

    text = F.udf(marks, "string", useArrow=False)("below")  # in one go over a node's leaves, not a search of them for each taxon
    out = bits.join(edges, "node").select(canonical(text).alias("split"), "length")
    return out.where(F.length(F.regexp_replace("split", "0", "")).between(2, taxa - 2))
