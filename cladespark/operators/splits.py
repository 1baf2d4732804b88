"""Splits of trees (tree_id, split as 0/1 text, length): frequencies, topologies, distances, consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dropped, saved
from .ordering import ranked


def canonical(split: Column) -> Column:
    """The side without the first taxon."""
    return F.when(F.substring(split, 1, 1) == "1", F.translate(split, "01", "10")).otherwise(split)


def render(split: Column) -> Column:
    return F.translate(split, "01", ".*")


def frequencies(splits: DataFrame, runs: int) -> DataFrame:
    """(split, nobs, mean, var, mse, nruns): how often and how evenly over runs each split was seen; mse = sum of (n_r - mean)^2 / nobs with zeros."""
    per = splits.groupBy("split", "run").agg(F.count("*").alias("n"), F.sum("length").alias("s"), F.sum(F.col("length") * F.col("length")).alias("s2"))
    out = per.groupBy("split").agg(F.sum("n").alias("nobs"), F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("nruns"))
    mean = F.col("s") / F.col("nobs")
    return out.select("split", "nobs", mean.alias("mean"), (F.col("s2") / F.col("nobs") - mean * mean).alias("var"), ((F.col("n2") - F.col("nobs") * F.col("nobs") / runs) / F.col("nobs")).alias("mse"), "nruns")


def topologies(splits: DataFrame) -> DataFrame:
    """(tree_id, run, topology): a tree's sorted splits as one key."""
    return splits.groupBy("tree_id", "run").agg(F.array_join(F.array_sort(F.collect_set("split")), "|").alias("topology"))


def topology_frequencies(trees: DataFrame) -> DataFrame:
    """(topology, nobs, p, cum_p, nruns, rank) by descending count, then key."""
    counts = trees.groupBy("topology").agg(F.count("*").alias("nobs"), F.count_distinct("run").alias("nruns"))
    out = ranked(counts, [], [F.desc("nobs"), F.desc("topology")], "rank", value=F.col("nobs"), running="upto")
    total = trees.count()
    return out.select("topology", "nobs", (F.col("nobs") / total).alias("p"), (F.col("upto") / total).alias("cum_p"), "nruns", "rank")


def same_taxa(splits: DataFrame) -> DataFrame:
    """splits, failing when one is read that isn't over as many taxa as the first."""
    sizes = splits.agg(F.min(F.length("split")).alias("a")).first()["a"]
    wrong = F.length("split") != F.lit(sizes)
    return splits.withColumn("split", F.when(wrong, F.raise_error(F.lit("trees over different taxa")).cast("string")).otherwise(F.col("split")))


def merge(splits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, split): the union of each key's splits of taxa."""
    spots = splits.select(*keys, F.posexplode(F.split("split", "")).alias("k", "bit")).groupBy(*keys, "k").agg(F.max("bit").alias("bit"))
    return spots.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "bit"))), lambda x: x["bit"]), "").alias("split"))


def contains(a: Column, b: Column) -> Column:
    """Whether the taxa of split b are all among those of a."""
    return ~F.exists(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.concat(x, y)), lambda x: x == "01")


def robinson_foulds(pairs: DataFrame, splits: DataFrame) -> DataFrame:
    """(a, b, rf) of tree pairs: the mean of the shares of each tree's splits that the other lacks; 0 for a tree without inner splits."""
    sets = splits.groupBy("tree_id").agg(F.collect_set("split").alias("s"))
    side = lambda p: sets.select(F.col("tree_id").alias(p), F.col("s").alias(f"s{p}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    empty = F.array().cast("array<string>")
    sa, sb = F.coalesce("sa", empty), F.coalesce("sb", empty)
    lack = lambda x, y: F.when(F.size(x) > 0, F.size(F.array_except(x, y)) / F.size(x)).otherwise(0.0)
    return both.select("a", "b", ((lack(sa, sb) + lack(sb, sa)) / 2).alias("rf"))


#: Rows of the result that a task makes, about.
ROWS = 1 << 22


def robinson_foulds_all(splits: DataFrame, of: DataFrame) -> DataFrame:
    """(a, b, rf) of the trees of a column a against all others, by classes of trees with the same splits.

    splits (tree_id, split) may have a row with a null split for a tree without any. Distances
    are found once for each two classes, by an index from splits to classes: shared splits are
    counted by a join on the split. A split of most classes would pair nearly all of them, so
    it is counted from the other side: two classes share all such splits but those that either
    lacks, plus those that both lack, and few lack them. The result has a row for each asked
    tree and other tree, made from its class's distances; nothing larger is made on the way.
    """
    s = saved(same_taxa(splits.select("tree_id", "split")), "index")
    known = saved(s.groupBy("tree_id").agg(F.array_join(F.array_sort(F.collect_set("split")), "|").alias("splits")), "trees")
    classes = saved(ranked(known.select("splits").distinct(), [], [F.col("splits")], "class"), "classes")
    asked = of.select(F.col("a").alias("tree_id")).distinct()
    trees = saved(known.join(classes, "splits").select("tree_id", "class"), "trees")
    asked = saved(trees.join(asked, "tree_id", "left_semi").select(F.col("tree_id").alias("a"), F.col("class").alias("ca")), "asked")
    dropped(s, known)
    far = saved(_between_classes(classes, asked.select("ca").distinct()), "classes")
    n, m = trees.count(), asked.count()
    parts = max(1, n * m // ROWS + 1, int(splits.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    others = trees.select(F.col("tree_id").alias("b"), F.col("class").alias("cb")).repartition(parts, "b")
    return others.join(far, "cb").join(asked, "ca").where("a <> b").select("a", "b", "rf")


def _between_classes(classes: DataFrame, asked: DataFrame) -> DataFrame:
    """(ca, cb, rf) of the classes of a column ca against all (class, splits)."""
    s = saved(classes.select("class", F.explode(F.split("splits", r"\|")).alias("split")).where("split <> ''"), "index")
    sizes = classes.select("class", F.when(F.col("splits") == "", 0).otherwise(F.size(F.split("splits", r"\|"))).alias("n"))
    total = sizes.count()
    often = saved(s.groupBy("split").agg(F.count("*").alias("nobs")).withColumn("hot", F.col("nobs") > total / 2), "often")
    hot = often.where("hot").select("split")
    many = hot.count()
    rest = s.join(often.where("not hot").select("split"), "split")
    # The few pairs of a class and a hot split that it lacks: each hot split's classes are taken from all.
    lacks = sizes.select("class").crossJoin(F.broadcast(hot)).join(s, ["class", "split"], "left_anti") if many else rest.limit(0).select("class", "split")
    lacks = saved(lacks, "lacks")

    def pairs(index: DataFrame, name: str) -> DataFrame:
        a, b = index.select(F.col("class").alias("ca"), "split").join(asked, "ca", "left_semi"), index.select(F.col("class").alias("cb"), "split")
        return a.join(b, "split").groupBy("ca", "cb").agg(F.count("*").alias(name))

    sizes = sizes.join(lacks.groupBy("class").agg(F.count("*").alias("l")), "class", "left").select("class", "n", F.coalesce("l", F.lit(0)).alias("l"))
    side = lambda k: sizes.select(F.col("class").alias(f"c{k}"), F.col("n").alias(f"n{k}"), F.col("l").alias(f"l{k}"))
    out = side("b").crossJoin(side("a").join(asked, "ca", "left_semi"))
    out = out.join(pairs(rest, "common"), ["ca", "cb"], "left").join(pairs(lacks, "both"), ["ca", "cb"], "left")
    shared = F.coalesce("common", F.lit(0)) + many - F.col("la") - F.col("lb") + F.coalesce("both", F.lit(0))
    lack = lambda n: F.when(n > 0, (n - shared) / n).otherwise(0.0)
    return out.select("ca", "cb", ((lack(F.col("na")) + lack(F.col("nb"))) / 2).alias("rf"))


def majority(splits: DataFrame, trees: int | Column, support: float = 0.5) -> DataFrame:
    """(split, support, mean) of splits in over the given share of trees; any two such splits are compatible."""
    out = splits.groupBy("split").agg((F.count_distinct("tree_id") / trees).alias("support"), F.avg("length").alias("mean"))
    return out.where(F.col("support") > support)


def mean_lengths(splits: DataFrame, trees: DataFrame) -> DataFrame:
    """(topology, split, mean): each topology's tree with mean lengths."""
    return splits.join(trees.select("tree_id", "topology"), "tree_id").groupBy("topology", "split").agg(F.avg("length").alias("mean"))


def conflict(a: Column, b: Column) -> Column:
    """Whether two canonical splits can't be in one tree: they meet, and each has taxa that the other lacks."""
    both = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.concat(x, y))
    return F.array_contains(both, "11") & F.array_contains(both, "10") & F.array_contains(both, "01")


def greedy_consensus(freqs: DataFrame, taxa: int, support: float = 0.0, block: int = 64) -> DataFrame:
    """The rows of freqs (split, support, ...) in the consensus tree: from the best supported split on, each that fits those before it.

    Splits are canonical; equal supports go by split. Every round reads the next few
    splits that fit all taken so far, so the driver sees a block of splits, and at most
    taxa - 3 are taken in all. Splits of one taxon against the rest are in every tree and not returned.
    """
    ones = F.length(F.regexp_replace("split", "0", ""))
    inner = freqs.where(ones.between(2, taxa - 2) & (F.col("support") >= support))
    inner = saved(inner, "inner")
    taken: list[str] = []
    while len(taken) < taxa - 3:
        known = F.array(*map(F.lit, taken)).cast("array<string>")
        fits = ~F.array_contains(known, F.col("split")) & ~F.exists(known, lambda s: conflict(F.col("split"), s))
        rows = (inner.where(fits) if taken else inner).orderBy(F.desc("support"), "split").select("split").limit(block).collect()
        if not rows:
            break
        sides: list[int] = []
        for r in rows:
            a = int(r["split"], 2)
            if all(not a & b or a & b in (a, b) for b in sides):
                sides.append(a)
                taken.append(r["split"])
    return inner.where(F.col("split").isin(taken[: taxa - 3]))
