"""Alignments: sites, patterns, compaction and per-site predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet
from .ordering import ranked


def sites(sequences: DataFrame, alphabet: Alphabet) -> DataFrame:
    """(tid, pos, ch, val) of (tid, seq), canonized."""
    known = F.create_map(*[F.lit(x) for kv in alphabet.values().items() for x in kv])
    long = sequences.select("tid", F.posexplode(F.filter(F.split(alphabet.canonize(F.col("seq")), ""), lambda c: c != "")).alias("pos", "ch"))
    return long.withColumn("val", F.element_at(known, F.col("ch")))


def pad(sequences: DataFrame, code: str = "-") -> DataFrame:
    """Ragged rows padded to the longest."""
    longest = sequences.agg(F.max(F.length("seq")).alias("longest"))
    return sequences.crossJoin(F.broadcast(longest)).withColumn("seq", F.expr(f"rpad(seq, longest, '{code}')")).drop("longest")


def pad_by(sequences: DataFrame, columns: int, code: str = "-") -> DataFrame:
    """Rows with so many columns of code appended."""
    return sequences.withColumn("seq", F.concat("seq", F.lit(code * columns)))


def sort_columns(patterns: DataFrame) -> DataFrame:
    """(place, pattern, freq) in the order of the patterns, place from 0."""
    return ranked(patterns, [], [F.col("pattern")], "place").select("place", "pattern", "freq")


def render(sequences: DataFrame, interleave: int = 50) -> DataFrame:
    """(block, tid, line): each row's columns in blocks of interleave (rounded up to groups of five), five by five."""
    width = -(-interleave // 5) * 5
    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("seq") - 1) / width).cast("int")))
    rows = sequences.select("tid", "seq", F.explode(blocks).alias("block"))
    part = F.substring(F.col("seq"), F.col("block") * width + 1, F.lit(width))
    return rows.select("block", "tid", F.regexp_replace(part, r"(.{5})(?=.)", "$1 ").alias("line"))


def render_lines(sequences: DataFrame, freqs: DataFrame, interleave: int = 50) -> DataFrame:
    """(line, value): the alignment (tid, label, seq) as text, with the columns' frequencies (pos, freq) above and offsets below each block.

    Blocks are of interleave columns, rounded up to groups of five, or one of all with 0; an
    empty line is between them, a rule above and below their rows. Lines are dealt by ranges
    of blocks and taxa. Without columns the lines are the labels.
    """
    size = sequences.agg(F.coalesce(F.max(F.length("label")), F.lit(0)).alias("wide"), F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("n")).first()
    wide, n = size["wide"], size["n"]
    if not n:
        return ranked(sequences, [], [F.col("tid")], "line").select("line", F.col("label").alias("value"))
    width = -(-interleave // 5) * 5 or n
    left, none = " " * wide, F.lit(None).cast("long")
    blocks = sequences.sparkSession.range(-(-n // width)).select(F.col("id").alias("block"), F.least(F.lit(width), n - F.col("id") * width).alias("own"))
    rule = F.concat(F.lit(left + " "), F.expr("repeat('=', cast(own + (own - 1) div 5 as int))"))
    offsets = F.transform(F.sequence(F.col("block") * width, F.col("block") * width + F.col("own") - 1, F.lit(5).cast("long")), lambda j: F.rpad(j.cast("string"), F.greatest(F.lit(6), F.length(j.cast("string"))), F.lit(" ")))
    frame = blocks.select("block", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.when(F.col("block") > 0, "").alias("value")), F.struct(F.lit(2).alias("part"), rule.alias("value")), F.struct(F.lit(4).alias("part"), rule.alias("value")), F.struct(F.lit(5).alias("part"), F.rtrim(F.concat(F.lit(left + " "), F.array_join(offsets, ""))).alias("value")))).alias("x"))
    frame = frame.select("block", "x.part", none.alias("tid"), "x.value").where("value is not null")
    cell = F.concat(F.when(F.col("pos") % 5 == 0, " ").otherwise(""), F.when(F.col("freq") < 10, F.col("freq").cast("string")).otherwise(F.format_string("(%d)", "freq")))
    head = freqs.where(F.col("pos") < n).groupBy(F.floor(F.col("pos") / width).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", cell.alias("text")))), lambda x: x["text"]), "").alias("text"))
    head = head.select("block", F.lit(1).alias("part"), none.alias("tid"), F.concat(F.lit(left), "text").alias("value"))
    rows = render(sequences, width).join(sequences.select("tid", "label"), "tid")
    rows = rows.select(F.col("block").cast("long").alias("block"), F.lit(3).alias("part"), F.col("tid").cast("long").alias("tid"), F.concat(F.rpad("label", F.lit(wide), F.lit(" ")), F.lit(" "), "line").alias("value"))
    return ranked(frame.union(head).union(rows), [], [F.col("block"), F.col("part"), F.col("tid")], "line").select("line", "value")


def compact(long: DataFrame) -> DataFrame:
    """(pattern, freq) of sites: equal columns become one, with their number. A column is gathered once, by position."""
    columns = long.groupBy("pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tid", "ch"))), lambda x: x["ch"]), "").alias("pattern"))
    return columns.groupBy("pattern").agg(F.count("*").alias("freq"))


def state_frequencies(long: DataFrame) -> DataFrame:
    return long.groupBy("ch", "val").agg(F.count("*").alias("n"))


def informative(long: DataFrame) -> DataFrame:
    """(pos, nstates, informative): at least three states, or exactly two that are each seen twice."""
    counts = long.where("val <> 0").groupBy("pos", "val").agg(F.count("*").alias("n"))
    out = counts.groupBy("pos").agg(F.count("*").alias("nstates"), F.min("n").alias("least"))
    return out.select("pos", "nstates", ((F.col("nstates") > 2) | ((F.col("nstates") == 2) & (F.col("least") >= 2))).alias("informative"))


def keep_informative(long: DataFrame) -> DataFrame:
    """The sites of parsimony-informative columns."""
    return long.join(informative(long).where("informative").select("pos"), "pos", "left_semi")


def dropped_changes(long: DataFrame, freqs: DataFrame | None = None) -> DataFrame:
    """One row (kept, dropped, changes): columns kept and dropped by keep_informative, and the changes that the dropped ones of two states stand for, one each or by their frequency (pos, freq)."""
    columns = long.select("pos").distinct().join(informative(long), "pos", "left")
    columns = columns.withColumn("freq", F.lit(1).cast("long")) if freqs is None else columns.join(freqs, "pos")
    keep = F.coalesce("informative", F.lit(False))
    return columns.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"), F.coalesce(F.sum(F.when(~keep & (F.col("nstates") == 2), F.col("freq"))), F.lit(0)).alias("changes"))


def fitch_labels(long: DataFrame) -> DataFrame:
    """(pos, tid, label): states of a column renumbered by first appearance over taxa."""
    from pyspark.sql import Window

    first = long.groupBy("pos", "val").agg(F.min("tid").alias("seen"))
    ranked = first.withColumn("label", F.row_number().over(Window.partitionBy("pos").orderBy("seen")) - 1)
    return long.join(ranked, ["pos", "val"]).select("pos", "tid", "label")
