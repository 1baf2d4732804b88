"""Trees put together from splits, by joins: each split's parent is the smallest one that holds it.

Splits (0/1 text, canonical: the first taxon's side is 0) that fit in one tree are nested or
apart, so those that hold a split's first member and are larger are just its ancestors. Many
trees, told apart by key columns, are built at once; no list of splits comes to the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..sources.newick import render
from .trees import canonize


def _ones(split: str = "split") -> Column:
    return F.length(F.regexp_replace(split, "0", ""))


def nested(splits: DataFrame, keys: list[str]) -> DataFrame:
    """splits with a column parent: the smallest split of the same keys that holds it, null below the root."""
    own = splits.withColumn("_size", _ones())
    members = _members(own, keys)
    child = own.select(*keys, "split", F.col("_size").alias("_own"), F.instr("split", "1").alias("place"))
    up = child.join(members, [*keys, "place"]).where("_size > _own").groupBy(*keys, "split").agg(F.min_by("holder", "_size").alias("parent"))
    return own.drop("_size").join(up, [*keys, "split"], "left")


def _members(sized: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, holder, _size): each taxon's place, from 1, with the splits that hold it."""
    bits = sized.select(*keys, F.col("split").alias("holder"), "_size", F.posexplode(F.split("split", "")).alias("p", "bit"))
    return bits.where("bit = '1'").select(*keys, (F.col("p") + 1).alias("place"), "holder", "_size")


def nodes(splits: DataFrame, taxa: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, parent, taxon, length, support) of trees over taxa (place, taxon).

    splits: (keys, split, mean, support). Those of one taxon against the rest give the lengths
    of the leaves' edges (0 without one), the others the inner nodes. The root is the node of
    no taxa, `0...0`; every tree has all taxa.
    """
    n = F.length("split")
    inner = nested(splits.where((_ones() >= 2) & (_ones() <= n - 2)), keys).withColumnRenamed("split", "node")
    root = F.repeat(F.lit("0"), F.length("node"))
    inner = inner.select(*keys, "node", F.coalesce("parent", root).alias("parent"), F.lit(None).cast("string").alias("taxon"), F.col("mean").alias("length"), "support")
    every = splits.select(*keys, F.length("split").alias("_n")).distinct()
    tips = every.crossJoin(F.broadcast(taxa)) if keys else taxa.crossJoin(F.broadcast(every))
    alone = splits.where((_ones() == 1) | (_ones() == n - 1)).select(*keys, F.when(_ones() == 1, F.instr("split", "1")).otherwise(1).alias("place"), F.col("mean").alias("length"))
    alone = alone.groupBy(*keys, "place").agg(F.max("length").alias("length"))
    holders = _members(inner.withColumn("_size", _ones("node")).withColumnRenamed("node", "split"), keys)
    low = holders.groupBy(*keys, "place").agg(F.min_by("holder", "_size").alias("parent"))
    tips = tips.join(alone, [*keys, "place"], "left").join(low, [*keys, "place"], "left")
    one = F.expr("overlay(repeat('0', _n) placing '1' from place for 1)")
    tips = tips.select(*keys, one.alias("node"), F.coalesce("parent", F.expr("repeat('0', _n)")).alias("parent"), "taxon", F.coalesce("length", F.lit(0.0)).alias("length"), F.lit(1.0).alias("support"))
    top = every.select(*keys, F.expr("repeat('0', _n)").alias("node"), *[F.lit(None).cast(t).alias(c) for c, t in (("parent", "string"), ("taxon", "string"), ("length", "double"), ("support", "double"))])
    return top.unionByName(inner).unionByName(tips)


def newick(nodes: DataFrame, keys: list[str], value: str = "length", fmt: str = "%.6f") -> DataFrame:
    """(keys, newick) of node rows, children by their smallest taxon; value: the column after the colon, length or support. A tree is gathered as the row that it becomes."""
    ship(nodes.sparkSession)
    trees = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("node", "parent", "taxon", F.col(value).alias("v")))).alias("rows")).select(F.struct(*(keys or [F.lit(0).alias("_all")])).alias("key"), "rows")

    def run(batches):
        for pdf in batches:
            out = []
            for rows in pdf["rows"]:
                number = {r["node"]: i for i, r in enumerate(rows)}
                tree = [(i, None if r["parent"] is None else number[r["parent"]], i, r["taxon"], r["v"] or 0.0, r["taxon"] is not None) for i, r in enumerate(rows)]
                out.append(render(canonize(tree), True, fmt))
            yield pd.DataFrame({"key": pdf["key"], "newick": out})

    out = trees.mapInPandas(run, f"key {trees.schema['key'].dataType.simpleString()}, newick string")
    return out.select(*[f"key.{k}" for k in keys], "newick")


def majority_tree(splits: DataFrame, taxa: DataFrame, support: float = 0.5) -> DataFrame:
    """Node rows of the tree of all splits (tree_id, split, length) in more than the given share of trees, with mean lengths over the trees that have them."""
    total = splits.agg(F.count_distinct("tree_id").alias("_total"))
    seen = splits.groupBy("split").agg(F.count_distinct("tree_id").alias("_n"), F.avg("length").alias("mean")).crossJoin(F.broadcast(total))
    alone = (_ones() == 1) | (_ones() == F.length("split") - 1)
    kept = seen.where(alone | (_ones() == 0) | (F.col("_n") > support * F.col("_total")))
    return nodes(kept.select("split", "mean", (F.col("_n") / F.col("_total")).alias("support")), taxa, [])


def mean_trees(splits: DataFrame, topologies: DataFrame, taxa: DataFrame) -> DataFrame:
    """Node rows of each topology's tree (tree_id, topology) with mean lengths; support is the share of all trees with the split."""
    total = splits.agg(F.count_distinct("tree_id").alias("_total"))
    share = splits.groupBy("split").agg(F.count_distinct("tree_id").alias("_n")).crossJoin(F.broadcast(total)).select("split", (F.col("_n") / F.col("_total")).alias("support"))
    mean = splits.join(topologies.select("tree_id", "topology"), "tree_id").groupBy("topology", "split").agg(F.avg("length").alias("mean"))
    return nodes(mean.join(share, "split"), taxa, ["topology"])
