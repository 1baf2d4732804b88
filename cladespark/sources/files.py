"""Files read record by record and lines written in order: a large file is many tasks both ways.

Readers cut a file at its record separator in byte ranges, by Spark's own text source, so
any path that Spark can open will do. Rows come in no order; numbers come from
operators.taxa. What needs a whole file (a repeated label, a quoted `;`) is left to
fasta.read and newick.parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, Alphabet


def read_fasta(spark: SparkSession, path: str, alphabet: Alphabet = DNA) -> DataFrame:
    """(file, label, seq) of each record; a label that a file has twice gives two rows. A record without a label or without characters, or with an undefined code, is an error."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^>", "").alias("value"))
    rows = rows.where(F.trim("value") != "")
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    label = F.translate(F.regexp_extract("value", r"^(\S+)", 1), "_", " ")
    wrong = (label == "") | (body == "") | (F.translate(body, "".join(alphabet.values()), "") != "")
    seq = F.when(wrong, F.raise_error(F.concat(F.lit("not a FASTA record: "), F.substring("value", 1, 60)))).otherwise(body)
    return rows.select("file", label.alias("label"), seq.alias("seq"))


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """(file, newick) of each tree up to its `;`. Labels and comments must not hold a `;`."""
    rows = spark.read.option("lineSep", ";").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"))
    return rows.where(F.col("value") != "").select("file", F.concat("value", F.lit(";")).alias("newick"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value) of logs, as the functions of sources.logs take them."""
    return spark.read.text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write (line, value) as text files whose names follow the order of line. A value may be of several lines. An existing path is an error."""
    parts = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lines.repartitionByRange(parts, "line").sortWithinPartitions("line").select("value").write.text(path)
