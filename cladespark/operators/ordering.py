"""Ranks and running sums over a whole order, without one task that sees it all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved, ship


def _placed(total: bool):
    """Task, place among the task's rows of a key (from 0), and the sum of the value up to each row; rows come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, key, seen, upto = TaskContext.get().partitionId(), None, 0, 0.0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            h = batch.column("_h").to_numpy()
            new = np.concatenate(([h[0] != key], h[1:] != h[:-1]))
            cut = np.flatnonzero(np.concatenate(([True], new[1:])))
            size = np.diff(np.append(cut, n))
            place = np.arange(n) - np.repeat(cut, size)
            v = batch.column("_v").to_numpy(zero_copy_only=False) if total else np.zeros(n)
            run_ = np.cumsum(v)
            run_ = run_ - np.repeat(run_[cut] - v[cut], size)
            if not new[0]:
                place[: size[0]] += seen
                run_[: size[0]] += upto
            key, seen, upto = h[-1], int(place[-1]) + 1, run_[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, task, np.int32)), pa.array(place), pa.array(run_)], names=[*batch.schema.names, "_task", "_place", "_run"])

    return run


def ranked(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank", size: str | None = None, value: Column | None = None, running: str | None = None) -> DataFrame:
    """df with each row's place (from 0) in its key's order; on demand the key's number of rows, and the sum of value up to the row.

    Rows are dealt by ranges of key and order, so that one key with most rows still is many
    tasks; places start from the counts of the ranges before. The order should tell all
    rows of a key apart. A null in value counts as 0.
    """
    ship(df.sparkSession)
    h = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    rows = df.withColumn("_h", h)
    if value is not None:
        rows = rows.withColumn("_v", F.coalesce(value.cast("double"), F.lit(0.0)))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col("_h"), *order]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _task int, _place long, _run double"
    placed = saved(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_placed(value is not None), schema), "ranked")
    tasks = placed.groupBy("_h", "_task").agg(F.count("*").alias("_n"), F.max_by("_run", "_place").alias("_s"))
    w = Window.partitionBy("_h").orderBy("_task")  # a row for each key and range
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("_h", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_sb"), F.sum("_n").over(Window.partitionBy("_h")).alias("_all"))
    out = placed.join(tasks, ["_h", "_task"])
    more = [(F.col("_place") + F.col("_b")).alias(rank)]
    more += [F.col("_all").alias(size)] if size else []
    more += [(F.col("_run") + F.col("_sb")).alias(running)] if running else []
    return out.select(*df.columns, *more)
