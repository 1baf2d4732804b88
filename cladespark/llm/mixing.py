"""Mixing sources to target weights by weighted fair queueing.

A source's target is its share of the whole budget by weight, but no more than `cap` times
its own words; what it can't take is dealt anew among the others by weight, until none is
above. Each source is a queue of its documents in an order drawn from a hash of doc_id and
pass; from the second pass on they come again. A queued document's virtual finish time is
the words of its queue up to its end, divided by the queue's target, so that at any time
all sources have served the same part of their targets. All queues are range-sorted by
finish time into one stream, which ends where the budget is spent: the documents that are
being served at that moment, one of each source at most, are cut there.

No queue is one task: rows are dealt by ranges of (source, order) and of finish time, and
sums over the ranges before give each row its place. The driver sees three sums for each
round of dealing out the excess, whatever the number of sources or documents.

A null text has size 0; documents of size 0 are never queued and take 0. A null source is a
source of its own, the last one. Rows that repeat a doc_id are queued each; rows that agree
in doc_id, source and text stand for each other. Nulls in doc_id are allowed. Extra
columns are ignored by shares() and kept by mixed(). An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import ranked
from ..session import ship
from .shared import sized, stash
from .words import count_words, slices

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in slices(batch.column("text")):
            own = [batch.column(c).slice(s.lo, s.hi - s.lo) for c in ("doc_id", "source", "x")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(count_words(s))], names=["doc_id", "source", "x", "size"])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, place, source_size, target) of rows (source, size); sources weigh by turns, in the order of their names, null last."""
    each = stash(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    each = ranked(each, [], [F.asc_nulls_last("source")], "place").withColumn("w", turn)
    budget = share * (each.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    most, level, full = F.col("source_size") * cap, 0.0, -1
    while True:
        held = most <= F.col("w") * level
        row = each.agg(F.count_if(held).alias("full"), F.sum(F.when(held, F.col("source_size"))).alias("s"), F.sum(F.when(~held, F.col("w"))).alias("w")).first()
        if row["full"] == full or not row["w"]:
            break
        full, level = row["full"], (budget - cap * (row["s"] or 0)) / row["w"]
    return each.select("source", "place", "source_size", F.least(most, F.col("w") * F.lit(level)).cast("double").alias("target") if full >= 0 else most.cast("double").alias("target"))


def schedule(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, doc_id, source, x, size, source_size, target) of all documents, and the stream (rid, pass, place, words): the served documents in order, from place 0 on."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = docs.select("doc_id", "source", F.xxhash64("text").alias("x"), "text")
    rows = stash(text.mapInArrow(_sizes, f"doc_id {kind}, source {docs.schema['source'].dataType.simpleString()}, x long, size long").withColumn("rid", F.monotonically_increasing_id()), "sizes")
    goal = stash(targets(rows, weights, share, cap), "targets")
    budget = math.floor(goal.agg(F.sum("target").alias("b")).first()["b"] or 0)
    rows = rows.withColumnRenamed("source", "_s").join(sized(goal), F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    queue = rows.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max(0, math.ceil(cap) - 1)))))
    queue = queue.select("rid", "pass", "place", "size", "source_size", "target", F.xxhash64("doc_id", "pass", F.lit(seed)).alias("h"), "x")
    queue = ranked(queue, ["place"], [F.col("pass"), F.col("h"), F.col("x"), F.col("size"), F.col("rid")], "turn", value=F.col("size"), running="upto")
    served = F.least(F.col("size"), F.floor("target") - (F.col("upto") - F.col("size")).cast("long"))
    going = queue.withColumn("words", served).where("words > 0").select("rid", "pass", "words", F.col("place").alias("queue"), "turn", (F.col("upto") / F.col("target")).alias("finish"))
    stream = ranked(going, [], [F.col("finish"), F.col("queue"), F.col("turn")], "place", value=F.col("words"), running="total")
    words = F.least(F.col("words"), F.lit(budget) - (F.col("total") - F.col("words")).cast("long"))
    return rows.drop("place"), stream.withColumn("words", words).where("words > 0").select("rid", "pass", "place", "words")


def shares(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row of docs; taken: its words in the mix, repeats counted."""
    rows, stream = schedule(docs, weights, share, cap, seed)
    taken = stream.groupBy("rid").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "rid", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0) -> DataFrame:
    """The mix itself: rows of docs with mix_place (order, from 0), mix_pass, and mix_words (as many of its first words count; fewer than all only where the stream ends)."""
    rows, stream = schedule(docs, weights, share, cap, seed)
    going = stream.join(rows.select("rid", "doc_id", "source", "x"), "rid").select(F.struct("doc_id", "source", "x").alias("_mix_key"), F.col("place").alias("mix_place"), F.col("pass").alias("mix_pass"), F.col("words").alias("mix_words"))
    keyed = docs.withColumn("_mix_key", F.struct("doc_id", "source", F.xxhash64("text").alias("x"))).dropDuplicates(["_mix_key"])
    return keyed.join(going, keyed["_mix_key"].eqNullSafe(going["_mix_key"])).drop("_mix_key")
