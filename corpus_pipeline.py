"""A training corpus in five stages: each reads what the one before kept, as a Parquet table in the shared folder.

Documents that the quality rules reject go; one document of each class of near copies
(five-word shingles, similarity 0.8) stays; words that repeat earlier passages are taken
out of the text (a document with nothing left goes); documents that hold a benchmark
window go; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm.decontam import without_contaminated
from cladespark.llm.packing import pack
from cladespark.llm.quality import quality_rules
from cladespark.llm.queries import tokenizer_path
from cladespark.llm.setjoin import keep_one
from cladespark.llm.shared import ROW, discard, stash, without_ids
from cladespark.llm.substring import remove_repeats
from cladespark.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    # Rows that repeat a doc_id are judged each.
    keyed = docs.withColumn(ROW, F.struct("doc_id", F.xxhash64("text", "lang", "source")))
    rejected = quality_rules(keyed.select(F.col(ROW).alias("doc_id"), "text", "lang", "source")).where("not kept").select(F.col("doc_id").alias(ROW))
    return without_ids(keyed, stash(rejected, "rejected"), ROW).drop(ROW)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_one(docs, k=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_copies_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]

#: Fitted distances, token ids and a greedy packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stash(stage(spark, docs, sf_dir), name)
        discard(before)  # nothing reads it any more
    return docs
