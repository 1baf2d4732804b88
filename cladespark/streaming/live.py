"""Diagnostics of a sampler that is still running: its growing sample logs as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.logs import scan_samples


def diagnostics(samples: DataFrame) -> DataFrame:
    """(run, n, mean, var, least, most, last) of samples (run, step, x), batch or stream; the state is a row for each run."""
    return samples.groupBy("run").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.min("x").alias("least"), F.max("x").alias("most"), F.max("step").alias("last"))


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """The samples of log files that arrive in a folder, as a stream (run, step, x)."""
    return scan_samples(spark.readStream.text(folder))


def watch(spark: SparkSession, folder: str, name: str, checkpoint: str):
    """Start a query that keeps each run's diagnostics in the table `name` up to date; checkpoint: a folder that all executors share."""
    return diagnostics(follow(spark, folder)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
