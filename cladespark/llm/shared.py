"""Helpers that several corpus operators share: scratch tables, id filters and components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A list of ids is broadcast up to this many rows (about 40 MB as a hashed relation); a larger one is joined by a shuffle.
BROADCAST_IDS = 1_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master may do without it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found and not (sc.master or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


def stash(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def sized(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """Mark df for broadcast if it has been counted to be small; leave the join to a shuffle otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs whose key is not in ids (one column); a null key is in no list."""
    return docs.join(sized(ids.distinct()), key, "left_anti")


def with_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(sized(ids.distinct()), key, "left_semi")


#: A column's name that no input is taken to have.
ROW = "_row_key"


def row_key(*columns: str) -> Column:
    """What tells rows apart that repeat a doc_id: the id with a hash of these columns; null for a null id."""
    return F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), F.xxhash64(*columns).alias("x")))


def remainder(key, mod: int, value: int):
    """crc32 of the key as text, modulo mod, equals value; false for a null key."""
    return F.coalesce((F.crc32(F.col(key).cast("string")) % mod) == value, F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b); ids without edges are absent.

    Alternating large-star and small-star rounds: every node hangs its neighbours under
    the smallest one it knows. Each round shuffles the edges once or twice, the rounds
    grow with the logarithm of the longest path, and no node's neighbours are gathered.
    """
    cur = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    n_old, h_old = _mark(cur)
    while True:
        both = cur.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stash(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("e")).select("e.*").where("u <> v")
        nxt = stash(small.distinct(), "cc")
        n_new, h_new = _mark(nxt)
        discard(cur, large)
        cur = nxt
        if (n_new, h_new) == (n_old, h_old):
            break
        n_old, h_old = n_new, h_new
    return cur.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("component")), F.struct(F.col("v").alias("id"), F.col("v").alias("component")))).alias("e")).select("e.*").distinct()


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
