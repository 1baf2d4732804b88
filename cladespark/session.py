"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Let executors import this package, by way of Spark's own file distribution; once for each session."""
    sc = spark.sparkContext
    if getattr(sc, "_clade_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), "cladespark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(path)
    sc._clade_shipped = True
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (spark.checkpoint.dir). Only a local master may leave the folder unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found and not (sc.master or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(found or '/tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "part") -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables of saved() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_saved_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
