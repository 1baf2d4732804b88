"""Sampler logs as typed rows, from DataFrames of lines (a column value, as spark.read.text or readStream.text give it).

All functions are plain projections, so they run on batches and on streams alike. Lines of
another form (headers, blank lines, a cut last line) give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import ranked

#: In the place of a run that has no value at a step.
MISSING = "---"
#: In the place of a coverage that isn't known yet.
UNKNOWN = "--------"
#: First lines of the logs.
HEADERS = {
    "t": "[[run step] tree]",
    "p": "run\tstep\tmodel\tweight\trmult\t( rclass )[ R ] wNorm alpha pinvar [ Pi ]",
    "s": "step\t[ lnLs ] Rcov [ swapRates ] { [ propRates ] }",
}


def _numbers(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))


def _classes(text: Column) -> Column:
    """`0 0 1` of `001`, `0,0,1` or `0 0 1`."""
    text = F.trim(text)
    return F.when(text.rlike(r"^\d+$"), F.regexp_replace(text, r"(\d)(?=\d)", "$1 ")).otherwise(F.regexp_replace(text, r"[,\s]+", " "))


def scan_diagnostics(lines: DataFrame) -> DataFrame:
    """(step, lnls, rcov, swaps, accepts) of whole lines `step [ lnLs ] Rcov [ swapRates ] { [ rates ] ... }`.

    lnls and swaps have a place for each run, accepts one such list for each proposal; `---`
    and an unknown coverage are null. Lines that end after the coverage give empty lists.
    """
    form = r"^\s*(\d+)\s+\[([^\]]*)\]\s+(\S+)(?:\s+\[([^\]]*)\])?(?:\s+\{(.*)\})?\s*$"
    part = lambda i: F.regexp_extract("value", form, i)
    each = F.transform(F.regexp_extract_all(part(5), F.lit(r"\[([^\]]*)\]"), 1), _numbers)
    return lines.where(F.col("value").rlike(form)).select(part(1).cast("long").alias("step"), _numbers(part(2)).alias("lnls"), part(3).try_cast("double").alias("rcov"), _numbers(part(4)).alias("swaps"), each.alias("accepts"))


def scan_samples(lines: DataFrame) -> DataFrame:
    """(run, step, x) of lines `step [ lnL of each run ] Rcov ...`; a run whose place has `---` gives no row."""
    form = r"^\s*(\d+)\s+\[([^\]]*)\]"
    rows = lines.where(F.col("value").rlike(form))
    step = F.regexp_extract("value", form, 1).cast("long")
    places = F.filter(F.split(F.trim(F.regexp_extract("value", form, 2)), r"\s+"), lambda x: x != "")
    found = rows.select(step.alias("step"), F.posexplode(places).alias("run", "x")).where(F.col("x") != MISSING)
    return found.select(F.col("run").cast("long").alias("run"), "step", F.col("x").try_cast("double").alias("x"))


def scan_trees(lines: DataFrame) -> DataFrame:
    """(run, step, newick) of lines `[run step] newick`."""
    form = r"^\s*\[\s*(\d+)\s+(\d+)\s*\]\s*(.*;)\s*$"
    part = lambda i: F.regexp_extract("value", form, i)
    return lines.where(F.col("value").rlike(form)).select(part(1).cast("long").alias("run"), part(2).cast("long").alias("step"), part(3).alias("newick"))


def scan_parameters(lines: DataFrame) -> DataFrame:
    """(run, step, model, weight, rmult, rclass, rates, w_norm, alpha, pinvar, freqs) of lines with these in order, lists in brackets.

    Classes may stand without a space (one digit each) or with commas; they come out with spaces.
    """
    form = r"^\s*(\d+)\s+(\d+)\s+(\d+)\s+(\S+)\s+(\S+)\s+\(([^)]*)\)\s*\[([^\]]*)\]\s+(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]*)\]\s*$"
    mark = "\x01"  # between the fields of a line that has been matched once
    fields = F.split(F.regexp_replace(F.translate("value", mark, "?"), form, mark.join(f"${i}" for i in range(1, 12))), mark)
    part = lambda i: F.col("fields")[i - 1]
    number = lambda i: part(i).try_cast("double")
    whole = F.filter(F.array(fields), lambda x: F.size(x) == 11)
    return lines.select(F.explode(whole).alias("fields")).select(
        part(1).cast("long").alias("run"), part(2).cast("long").alias("step"), part(3).cast("int").alias("model"), number(4).alias("weight"), number(5).alias("rmult"), _classes(part(6)).alias("rclass"),
        _numbers(part(7)).alias("rates"), number(8).alias("w_norm"), number(9).alias("alpha"), number(10).alias("pinvar"), _numbers(part(11)).alias("freqs"),
    )


def scan_settings(lines: DataFrame) -> DataFrame:
    """(key, value) of lines `  key: value`."""
    form = r"^\s+([\w.]+):\s*(.*?)\s*$"
    return lines.where(F.col("value").rlike(form)).select(F.regexp_extract("value", form, 1).alias("key"), F.regexp_extract("value", form, 2).alias("value"))


def sample_lines(samples: DataFrame) -> DataFrame:
    """value: a line `step [ x of each run ] --------` for each step of samples (run, step, x); a place for each run from 0 to the last."""
    last = samples.agg(F.max("run").alias("last"))
    by = samples.groupBy("step").agg(F.map_from_entries(F.collect_list(F.struct("run", F.col("x").cast("string").alias("x")))).alias("r")).crossJoin(F.broadcast(last))
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda k: F.coalesce(F.try_element_at("r", k), F.lit(MISSING)))
    return by.select(F.concat(F.col("step").cast("string"), F.lit(" [ "), F.array_join(places, " "), F.lit(" ] --------")).alias("value"))


def _number(x: Column, fmt: str) -> Column:
    return F.when(x.isNull(), MISSING).when(x == float("inf"), "inf").otherwise(F.format_string(fmt, x))


def _bracket(xs: Column, fmt: str) -> Column:
    return F.concat(F.lit("[ "), F.array_join(F.transform(xs, lambda x: _number(x, fmt)), " "), F.lit(" ]"))


def diagnostic_lines(rows: DataFrame) -> DataFrame:
    """(step, value): the line of each row of scan_diagnostics()."""
    rates = F.concat(F.lit("{ "), F.array_join(F.transform("accepts", lambda x: _bracket(x, "%.6f")), " "), F.lit(" }"))
    rcov = F.when(F.col("rcov").isNull(), UNKNOWN).otherwise(F.format_string("%.6f", "rcov"))
    start = F.concat(F.col("step").cast("string"), F.lit("\t"), _bracket(F.col("lnls"), "%.11e"))
    return rows.select("step", F.concat_ws(" ", start, rcov, _bracket(F.col("swaps"), "%.6f"), rates).alias("value"))


def tree_lines(trees: DataFrame) -> DataFrame:
    """(run, step, value): a line `[run step] newick` for each tree."""
    return trees.select("run", "step", F.format_string("[%d %d] %s", "run", "step", "newick").alias("value"))


def parameter_lines(models: DataFrame) -> DataFrame:
    """(run, step, model, value): a line for each model row of scan_parameters(). Weights are written as shares of a sample's models, frequencies as shares of their sum."""
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("run", "step"))  # the models of one sample
    total = F.aggregate("freqs", F.lit(0.0), lambda a, b: a + b)
    classes = F.split("rclass", " ")
    rclass = F.when(F.size(classes) > 10, F.array_join(classes, ",")).otherwise(F.array_join(classes, ""))
    start = F.concat_ws("\t", F.col("run").cast("string"), F.col("step").cast("string"), F.col("model").cast("string"), _number(share, "%.5f"), _number(F.col("rmult"), "%.5f"))
    lists = F.concat(F.lit("( "), rclass, F.lit(" )"), _bracket(F.col("rates"), "%.5e"))
    rest = [_number(F.col("w_norm"), "%.5e"), _number(F.col("alpha"), "%.5e"), _number(F.col("pinvar"), "%.5f"), _bracket(F.transform("freqs", lambda f: f / total), "%.5e")]
    return models.select("run", "step", "model", F.concat(start, F.lit("\t"), F.concat_ws(" ", lists, *rest)).alias("value"))


def setting_lines(settings: DataFrame) -> DataFrame:
    """(key, value) with value the line `  key: value`."""
    return settings.select("key", F.format_string("  %s: %s", "key", "value").alias("value"))


def numbered(lines: DataFrame, order: list[str], kind: str) -> DataFrame:
    """(line, value): a whole log of that kind, its header as line 0 and then the lines in order; ranges of them are sorted apart."""
    head = lines.sparkSession.createDataFrame([(0, HEADERS[kind])], "line long, value string")
    body = ranked(lines, [], [F.col(c) for c in order], "line").select((F.col("line") + 1).alias("line"), "value")
    return head.union(body)
