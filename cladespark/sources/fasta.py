"""FASTA text: labels and sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, Alphabet
from ..session import ship


def parse(text: str, alphabet: Alphabet = DNA) -> list[tuple[str, str]]:
    """(label, sequence) in order; the label is the first run after '>' with '_' for blanks, the rest of the line a comment. A repeated label replaces its data."""
    allowed, out, label = set(alphabet.values()), {}, None
    for no, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        if line.startswith(">"):
            if len(line) < 2 or line[1].isspace():
                raise ValueError(f"Line {no}: Invalid token")
            if label is not None and not out[label]:
                raise ValueError(f"Line {no}: a label without characters")
            label = line[1:].split(None, 1)[0].replace("_", " ")
            out[label] = ""
        else:
            body = "".join(line.split())
            if label is None or set(body) - allowed:
                raise ValueError(f"Line {no}: Invalid token")
            out[label] += body
    if label is not None and not out[label]:
        raise ValueError("a label without characters")
    return list(out.items())


def scan(texts: DataFrame, alphabet: Alphabet = DNA) -> DataFrame:
    """(dataset, tid, label, seq) of whole texts (dataset, value)."""

    def run(batches):
        for pdf in batches:
            rows = [(f, i, *r) for f, text in zip(pdf["dataset"], pdf["value"], strict=True) for i, r in enumerate(parse(text, alphabet))]
            yield pd.DataFrame(rows, columns=["dataset", "tid", "label", "seq"])

    ship(texts.sparkSession)
    return texts.select("dataset", "value").mapInPandas(run, f"dataset {texts.schema['dataset'].dataType.simpleString()}, tid int, label string, seq string")


def read(spark: SparkSession, path: str, alphabet: Alphabet = DNA) -> DataFrame:
    """(dataset, tid, label, seq) of FASTA files, one task row for each file."""
    return scan(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("dataset"), "value"), alphabet)


def lines(label, seq, width: int = 75):
    """One FASTA record as text: a column of a label and a sequence column."""
    body = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), F.translate(label, " ", "_"), F.lit("\n"), body)
