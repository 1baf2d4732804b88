"""Taxa by number: a dense dictionary of labels, lookups both ways, and trees whose labels are numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import newick
from .ordering import ranked


def dictionary(labels: DataFrame, label: str = "label", order: str | None = None) -> DataFrame:
    """(tid, label) of the distinct labels that are not null, numbered from 0 without gaps by code point, or by their least value of order."""
    rows = labels.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"))
    if order is None:
        return ranked(rows.agg(F.lit(0).alias("seen")), [], [F.col("label")], "tid").select("tid", "label")
    return ranked(rows.agg(F.min(order).alias("seen")), [], [F.col("seen"), F.col("label")], "tid").select("tid", "label")


def checked(taxa: DataFrame) -> DataFrame:
    """taxa; an error unless its numbers run from 0 without gaps and no label has two."""
    got = taxa.agg(F.count("*").alias("n"), F.countDistinct("tid").alias("tids"), F.countDistinct("label").alias("labels"), F.min("tid").alias("low"), F.max("tid").alias("high")).first()
    if got["n"] and (got["n"] != got["tids"] or got["low"] != 0 or got["high"] != got["n"] - 1):
        raise ValueError("numbers of taxa must run from 0 without gaps")
    if got["n"] != got["labels"]:
        raise ValueError("a taxon is null or has two numbers")
    return taxa


def index_of(rows: DataFrame, taxa: DataFrame, label: str = "label") -> DataFrame:
    """rows with the number tid of their label; -1 where it has none."""
    return rows.join(taxa.select(F.col("label").alias(label), "tid"), label, "left").withColumn("tid", F.coalesce("tid", F.lit(-1)))


def label_of(rows: DataFrame, taxa: DataFrame, tid: str = "tid") -> DataFrame:
    """rows with the label of their number; null where it has none."""
    return rows.join(taxa.select(F.col("tid").alias(tid), "label"), tid, "left")


def _relabelled(trees: DataFrame, names: DataFrame, lengths: bool, fmt: str) -> DataFrame:
    """Trees with each label replaced by what names (taxon, name) has for it; a label that isn't there is an error."""
    nodes = newick.nodes(trees).join(names, "taxon", "left")
    name = F.when(F.col("taxon").isNotNull() & F.col("name").isNull(), F.raise_error(F.concat(F.lit("unknown taxon "), "taxon"))).otherwise(F.col("name"))
    return newick.texts(nodes.withColumn("taxon", name.cast("string")), lengths, fmt)


def numbered(trees: DataFrame, taxa: DataFrame, lengths: bool = True, fmt: str = "%g") -> DataFrame:
    """(tree_id, newick) with numbers for labels; taxa is joined as a table, so it may be of any size."""
    return _relabelled(trees, taxa.select(F.col("label").alias("taxon"), F.col("tid").cast("string").alias("name")), lengths, fmt)


def named(trees: DataFrame, taxa: DataFrame, lengths: bool = True, fmt: str = "%g") -> DataFrame:
    """The inverse of numbered()."""
    return _relabelled(trees, taxa.select(F.col("tid").cast("string").alias("taxon"), F.col("label").alias("name")), lengths, fmt)
