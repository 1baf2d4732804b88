"""Edits of alignments as a table, and the layouts by row and by column.

An edit is a row (n, kind, row, col, chars): kind `seq` writes chars into row `row` from
column `col` on, kind `char` into column `col` from row `row` on. Rows are numbered from 0
without gaps (operators.taxa), columns from 0. Where edits meet, the greatest n counts,
and of equal ones the greater character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def cells(edits: DataFrame) -> DataFrame:
    """(tid, pos, ch): what each edited cell holds in the end. Only cells are shuffled, combined before it."""
    long = edits.select("n", "kind", "row", "col", F.posexplode(_chars(F.col("chars"))).alias("k", "ch"))
    along = lambda kind: F.when(F.col("kind") == kind, F.col("k")).otherwise(0)
    each = long.select((F.col("row") + along("char")).cast("long").alias("tid"), (F.col("col") + along("seq")).cast("long").alias("pos"), F.struct("n", "ch").alias("x"))
    return each.groupBy("tid", "pos").agg(F.max("x")["ch"].alias("ch"))


def edited(sequences: DataFrame, edits: DataFrame, alphabet: Alphabet | None = None) -> DataFrame:
    """sequences (tid, seq) after all edits. An edit outside of the alignment, of an unknown kind or (with an alphabet) of an undefined code is an error."""
    kind = F.when(F.col("kind").isin("seq", "char"), F.col("kind")).otherwise(F.raise_error(F.lit("the kind of an edit is seq or char")))
    edits = edits.withColumn("kind", kind)
    if alphabet:
        known = F.translate("chars", "".join(alphabet.values()), "") == ""
        edits = edits.withColumn("chars", F.when(known, F.col("chars")).otherwise(F.raise_error(F.lit("an edit has an undefined code"))))
    rows = cells(edits).groupBy("tid").agg(F.map_from_entries(F.collect_list(F.struct("pos", "ch"))).alias("new"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    both = sequences.select(F.col("tid").cast("long").alias("tid"), "seq").join(rows, "tid", "full")
    outside = F.col("seq").isNull() | (F.col("low") < 0) | (F.col("high") >= F.length("seq"))
    merged = F.array_join(F.transform(_chars(F.col("seq")), lambda c, i: F.coalesce(F.try_element_at("new", i.cast("long")), c)), "")
    return both.select("tid", F.when(F.col("new").isNull(), F.col("seq")).when(outside, F.raise_error(F.lit("an edit is outside of the alignment"))).otherwise(merged).alias("seq"))


def columns(sequences: DataFrame, only: list[int] | None = None) -> DataFrame:
    """(pos, chars): the alignment by columns, characters in the order of tid; all, or only some. A column is gathered once, by position."""
    long = sequences.select("tid", F.posexplode(_chars(F.col("seq"))).alias("pos", "ch"))
    if only is not None:
        long = long.where(F.col("pos").isin(only))
    return long.groupBy("pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tid", "ch"))), lambda x: x["ch"]), "").alias("chars"))


def rows(columns: DataFrame) -> DataFrame:
    """(tid, seq) of (pos, chars): the inverse of columns(), with rows numbered from 0."""
    long = columns.select("pos", F.posexplode(_chars(F.col("chars"))).alias("tid", "ch"))
    return long.groupBy(F.col("tid").cast("long").alias("tid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias("seq"))


def with_freqs(columns: DataFrame, changes: DataFrame) -> DataFrame:
    """columns (pos, .., freq) with the last frequency that changes (n, pos, freq) has for each; of equal n the greater one."""
    last = changes.groupBy("pos").agg(F.max(F.struct("n", "freq"))["freq"].alias("new"))
    return columns.join(last, "pos", "left").withColumn("freq", F.coalesce("new", "freq")).drop("new")
