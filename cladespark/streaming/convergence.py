"""Convergence of runs that are still sampling: Rcov after each arrival of log lines, kept in tables.

Every micro-batch of samples becomes a part of its own of the table `samples`, and the
coverage over the last half of what there is then becomes the batch's row of the table
`rcov`. A part is named by its batch and written over when a batch is repeated, so a
restarted stream gives the same tables. Steps before the half are left out by the scan, by
the steps that Parquet keeps for each part; the driver holds bounds of runs only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.posterior import coverage
from .live import follow


def last_half(samples: DataFrame, stride: int = 1) -> DataFrame:
    """Samples from ((last / stride) / 2 + 1) * stride on, with the last step that all runs have reached."""
    last = samples.groupBy("run").agg(F.max("step").alias("last")).agg(F.min("last").alias("last"))
    some = samples.crossJoin(F.broadcast(last)).where(F.col("step") <= F.col("last"))
    return some.where(F.col("step") >= (F.floor(F.floor(F.col("last") / stride) / 2) + 1) * stride).drop("last")


def sampling_coverage(samples: DataFrame, stride: int = 1, alpha: float = 0.05) -> DataFrame:
    """(last, n, rcov) of the last half of all runs; 0 while there is none."""
    half = last_half(samples, stride)
    seen = half.agg(F.max("step").alias("last"), F.count("*").alias("n"))
    return seen.crossJoin(F.broadcast(coverage(half, alpha))).select("last", "n", F.coalesce("rcov", F.lit(0.0)).alias("rcov"))


def watch(spark: SparkSession, folder: str, tables: str, checkpoint: str, stride: int = 1, alpha: float = 0.05, **trigger):
    """Start a query over log files that arrive in a folder; tables: a shared folder that gets `samples` and `rcov`; trigger: as writeStream.trigger() takes it."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{tables}/samples/batch={number}")
        # What a repeated batch has written later than this one is not read.
        every = spark.read.schema("run long, step long, x double, batch long").parquet(f"{tables}/samples").where(F.col("batch") <= number)
        sampling_coverage(every.drop("batch"), stride, alpha).write.mode("overwrite").parquet(f"{tables}/rcov/batch={number}")

    out = follow(spark, folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()
