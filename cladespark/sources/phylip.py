"""Distance matrices in the PHYLIP layouts: full, upper and lower."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

_LABEL = re.compile(r"[A-Za-z_][\w\-./]*")
_NUMBER = re.compile(r"[-+]?\d+(\.\d+)?([eE][-+]?\d+)?")


def parse(text: str) -> tuple[list[str], list[tuple[int, int, float]]]:
    """(labels, [(i, j, d) with i < j]); the layout shows from the number of values in the first row."""
    tokens = [(no, t) for no, line in enumerate(text.splitlines(), 1) for t in line.split()]
    if not tokens or not tokens[0][1].isdigit():
        raise ValueError("Line 1: the number of taxa is missing")
    n, rows = int(tokens[0][1]), []
    for no, t in tokens[1:]:
        if _NUMBER.fullmatch(t) and rows:
            rows[-1][1].append(float(t))
        elif _LABEL.fullmatch(t):
            if rows and not rows[-1][1] and not (len(rows) == 1 or len(rows) == n):
                rows[-1][0] += " " + t  # a label may have blanks
            else:
                rows.append([t, []])
        else:
            raise ValueError(f"Line {no}: unexpected {t!r}")
    labels = [r[0] for r in rows]
    if len(rows) != n or len(set(labels)) != n:
        raise ValueError(f"{n} distinct labels are needed")
    counts = [len(r[1]) for r in rows]
    if counts == [n] * n:
        for i in range(n):
            if rows[i][1][i] != 0:
                raise ValueError(f"non-zero distance of {labels[i]!r} to itself")
            for j in range(i):
                if rows[i][1][j] != rows[j][1][i]:
                    raise ValueError(f"distances of {labels[i]!r} and {labels[j]!r} differ")
        out = [(i, j, rows[i][1][j]) for i in range(n) for j in range(i + 1, n)]
    elif counts == list(range(n - 1, -1, -1)):
        out = [(i, j, rows[i][1][j - i - 1]) for i in range(n) for j in range(i + 1, n)]
    elif counts == list(range(n)):
        out = [(i, j, rows[j][1][i]) for i in range(n) for j in range(i + 1, n)]
    else:
        raise ValueError("neither a full, an upper nor a lower matrix")
    return labels, out


def scan(texts: DataFrame) -> DataFrame:
    """(dataset, i, j, label_i, label_j, d) with i < j of whole matrices (dataset, value)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for name, text in zip(pdf["dataset"], pdf["value"], strict=True):
                labels, cells = parse(text)
                rows += [(name, i, j, labels[i], labels[j], d) for i, j, d in cells]
            yield pd.DataFrame(rows, columns=["dataset", "i", "j", "label_i", "label_j", "d"])

    ship(texts.sparkSession)
    return texts.select("dataset", "value").mapInPandas(run, f"dataset {texts.schema['dataset'].dataType.simpleString()}, i int, j int, label_i string, label_j string, d double")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The matrices of files, one task row for each file."""
    return scan(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("dataset"), "value"))


def scan_lines(lines: DataFrame) -> DataFrame:
    """(i, j, label_i, label_j, d) with i < j of one matrix given as lines (row, line): row -1 has the number of taxa, row k the label and the values of taxon k.

    Lines are parsed each for itself, so a matrix may be larger than a task. The layout shows
    from the first row. Lines are read three times: give a table, not a long plan. A wrong
    number of rows, a repeated label, a row of another length, an own distance that isn't 0
    and two distances of one pair that differ are errors.
    """
    number = r"^[-+]?\d+(\.\d+)?([eE][-+]?\d+)?$"
    tokens = F.filter(F.split(F.trim("line"), r"\s+"), lambda t: t != "")
    head = lines.where("row = -1").select(F.trim("line").try_cast("int").alias("n")).take(1)
    if not head or head[0]["n"] is None:
        raise ValueError("the number of taxa is missing")
    n = head[0]["n"]
    rows = lines.where("row >= 0").withColumn("t", tokens).select(
        F.col("row").cast("int").alias("row"),
        F.array_join(F.filter("t", lambda t: ~t.rlike(number)), " ").alias("label"),
        F.transform(F.filter("t", lambda t: t.rlike(number)), lambda t: t.cast("double")).alias("values"),
    )
    seen = rows.agg(F.count("*").alias("m"), F.countDistinct("label").alias("labels"), F.countDistinct("row").alias("rows"), F.max("row").alias("last"), F.max(F.when(F.col("row") == 0, F.size("values"))).alias("first")).first()
    if (seen["m"], seen["labels"], seen["rows"], seen["last"] if n else -1) != (n, n, n, n - 1):
        raise ValueError(f"{n} distinct labels are needed")
    full, upper = seen["first"] == n, seen["first"] == n - 1 and n > 1
    wanted = F.lit(n) if full else n - 1 - F.col("row") if upper else F.col("row")
    checked = F.when(F.size("values") == wanted, F.col("values")).otherwise(F.raise_error(F.concat(F.lit("a row of another length: "), F.col("label"))))
    cells = rows.select("row", F.posexplode(checked).alias("k", "d")).withColumn("k", F.col("k") + F.col("row") + 1 if upper else F.col("k"))
    if full:
        own = F.when((F.col("row") != F.col("k")) | (F.col("d") == 0), F.col("d")).otherwise(F.raise_error(F.lit("a non-zero distance of a taxon to itself")))
        cells = cells.withColumn("d", own).groupBy(F.least("row", "k").alias("i"), F.greatest("row", "k").alias("j")).agg(F.min("d").alias("d"), F.max("d").alias("e"))
        cells = cells.select("i", "j", F.when(F.col("d") == F.col("e"), F.col("d")).otherwise(F.raise_error(F.lit("two distances of one pair differ"))).alias("d")).where("i < j or d is null")
    else:
        cells = cells.select(F.least("row", "k").alias("i"), F.greatest("row", "k").alias("j"), "d")
    name = lambda c: rows.select(F.col("row").alias(c), F.col("label").alias(f"label_{c}"))
    return cells.join(name("i"), "i").join(name("j"), "j").select("i", "j", "label_i", "label_j", "d")
