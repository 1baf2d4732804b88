"""Plain-text reports as tables of numbered lines, from the tables of statistics.

A report is (line, value) with lines numbered from 0 over all; write() keeps that order over
many files. Lines are dealt and numbered by ranges, so a report of many partitions or
topologies is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import ranked


def _fives(text: Column) -> Column:
    """In groups of five, with a blank between them."""
    return F.regexp_replace(text, "(.{5})(?=.)", "$1 ")


def parts(freqs: DataFrame, taxa: DataFrame, total: int) -> DataFrame:
    """The partitions, from the most observed one on: a key of the taxa, a head line, and a line for each of splits.frequencies().

    freqs: split (0/1), nobs, mean, var, mse, nruns; taxa: (place, taxon) in the order of the
    splits' characters; total: the number of trees. Equal counts go by the split, highest first.
    """
    n = taxa.count()
    wide = max(n + (n - 1) // 5, len("Partition"))
    counts = max(len(str(total)), len("#obs"))
    i = F.col("place") - 1
    last = F.rtrim(_lead(F.lit(n - 1)))
    # A taxon's line has a bar for each fifth taxon before it; every fifth taxon starts a new group, after a line of bars.
    own = taxa.select((2 * i + 1).alias("at"), F.concat(_lead(i), "taxon").alias("value"))
    groups = taxa.where((i % 5 == 0) & (i > 0)).select((2 * i).alias("at"), F.rtrim(_lead(i)).alias("value"))
    foot = taxa.limit(1).select(F.explode(F.array(F.struct(F.lit(2 * n).alias("at"), last.alias("value")), F.struct(F.lit(2 * n + 1).alias("at"), F.concat(F.rpad(last, wide, " "), F.lit("  " + "#obs".ljust(counts) + "\tProbability\tMSE\t\tmean(v)\t\tvar(v)\t\t#runs")).alias("value")))).alias("f")).select("f.*")
    head = own.union(groups).union(foot)
    head = ranked(head, [], [F.col("at")], "line").select("line", "value")
    first = n + (n - 1) // 5 + 2
    number = lambda c: F.format_string("%.6f", c)
    row = F.concat(F.rpad(_fives(F.translate("split", "01", ".*")), wide, " "), F.lit("  "), F.lpad(F.col("nobs").cast("string"), counts, " "), F.lit("\t"), number(F.col("nobs") / total), F.lit("\t"), number(F.col("mse")), F.lit("\t"), F.format_string("%.5e", "mean"), F.lit("\t"), F.format_string("%.5e", "var"), F.lit("\t"), F.col("nruns").cast("string"))
    body = ranked(freqs, [], [F.desc("nobs"), F.desc("split")], "line")
    return head.union(body.select((F.col("line") + first).alias("line"), row.alias("value")))


def _lead(i: Column) -> Column:
    """Bars in the columns of the taxa 0, 5, 10, ... before taxon i, in groups of five."""
    bars = F.rpad(F.lit(""), i.cast("int"), F.lit("|    "))
    return F.regexp_replace(bars, "(.{5})", "$1 ")


def topologies(freqs: DataFrame, newicks: DataFrame, mse: DataFrame) -> DataFrame:
    """The topologies, from the likeliest one on: `[nobs p P mse nruns] tree`. freqs: splits.topology_frequencies(); newicks (topology, newick); mse (topology, mse)."""
    rows = freqs.join(newicks, "topology").join(mse, "topology")
    text = F.concat(F.lit("["), F.col("nobs").cast("string"), F.format_string(" %.6f %.6f %.6f ", "p", "cum_p", "mse"), F.col("nruns").cast("string"), F.lit("] "), F.col("newick"))
    head = freqs.sparkSession.createDataFrame([(0, "[[#obs p P MSE #runs] tree]")], "line long, value string")
    return head.union(rows.select((F.col("rank") + 1).alias("line"), text.alias("value")))


def summary(stats: DataFrame, rcov: DataFrame, burnin: int | None, samples: int, first: int, last: int, alpha: float = 0.05, epsilon: float = 0.01) -> DataFrame:
    """The posterior's summary: the range of steps, coverage (parameter, rcov) and statistics of parameters.summaries(). A parameter of several models is listed for each."""
    top = [f"burnin: {'<half>' if burnin is None else burnin}", f"nsamples: {samples}", f"stepFirst: {first}", f"stepLast: {last}", "", "Parameter\tRcov\t\t1.0-alpha\t1.0-alpha-epsilon", "-" * 65]
    middle = ["", f"\t\t\t\t\t\t{(1 - alpha) * 100:.2f}% Cred. Interval", "\t\t\t\t\t\t" + "-" * 31, "Parameter\tMean\t\tVariance\tLower\t\tUpper\t\tMedian", "-" * 94]
    spark = stats.sparkSession
    number = lambda c: F.format_string("%.6f", c)
    covered = F.concat(F.col("parameter"), F.lit("\t\t"), F.when(F.col("rcov").isNotNull(), F.concat(number(F.col("rcov")), F.lit(f"\t{1 - alpha:.6f}\t{1 - alpha - epsilon:.6f}"))).otherwise("N/A"))
    name = F.when(F.col("k") + F.col("model") == 0, F.col("parameter")).otherwise(F.concat(F.col("parameter"), F.lit("["), F.col("model").cast("string"), F.lit(","), F.col("k").cast("string"), F.lit("]")))
    row = F.concat_ws("\t", F.concat(name, F.lit("\t")), *[number(F.col(c)) for c in ("mean", "var", "min_cred", "max_cred", "med")])
    fixed = spark.createDataFrame([(0, i, "", 0, 0, v) for i, v in enumerate(top)] + [(2, i, "", 0, 0, v) for i, v in enumerate(middle)], "block int, at int, parameter string, model int, k int, value string")
    lines = fixed.union(rcov.select(F.lit(1), F.lit(0), "parameter", F.lit(0), F.lit(0), covered)).union(stats.select(F.lit(3), F.lit(0), "parameter", "model", "k", row))
    return ranked(lines, [], [F.col(c) for c in ("block", "at", "parameter", "model", "k")], "line").select("line", "value")


def write(report: DataFrame, path: str) -> None:
    """The report's text in files whose names are in the order of the lines."""
    report.repartitionByRange("line").sortWithinPartitions("line").select("value").write.text(path)
