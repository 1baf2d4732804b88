"""Samples joined with their model and tree rows, and posterior statistics of every parameter.

A sample (run, step, x) has one or more model rows (run, step, model, weight, rmult, rclass,
rates, w_norm, alpha, pinvar, freqs) and a tree (run, step, newick).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import posterior

_MODEL = ("model", "weight", "rmult", "rclass", "rates", "w_norm", "alpha", "pinvar", "freqs")


def joined(samples: DataFrame, models: DataFrame, trees: DataFrame | None = None) -> DataFrame:
    """(run, step, x, models, nmodels, newick): a row for each sample; models by their numbers. A sample without models has an empty list, one without a tree a null."""
    of = models.groupBy("run", "step").agg(F.array_sort(F.collect_list(F.struct(*_MODEL))).alias("models"))
    none = F.array().cast(of.schema["models"].dataType)
    out = samples.select("run", "step", "x").join(of, ["run", "step"], "left").withColumn("models", F.coalesce("models", none))
    out = out.withColumn("nmodels", F.size("models"))
    return out if trees is None else out.join(trees.select("run", "step", "newick"), ["run", "step"], "left")


def rate_classes(rclass: Column) -> Column:
    """The class of each rate of a text such as `0 1 0 0 1 0`."""
    return F.transform(F.split(F.trim(rclass), r"\s+"), lambda c: c.cast("int"))


def _places(name: str, model: Column, values: Column) -> Column:
    return F.transform(values, lambda v, k: F.struct(F.lit(name).alias("parameter"), model.cast("int").alias("model"), k.cast("int").alias("k"), v.cast("double").alias("value")))


def values(rows: DataFrame) -> DataFrame:
    """(parameter, model, k, value) of joined rows: lnl and nmodels of each sample; weight, nclasses, rates, freqs, alpha and pinvar of each of its models, by the model's place.

    A rate is scaled by the sample's norm and the model's multiplier, so that rates compare over samples.
    """
    whole = lambda name, x: _places(name, F.lit(0), F.array(x))
    of = lambda m, at: F.concat(
        _places("weight", at, F.array(m["weight"])),
        _places("nclasses", at, F.array(F.array_max(rate_classes(m["rclass"])) + 1)),
        _places("rate", at, F.transform(m["rates"], lambda r: r * m["w_norm"] * m["rmult"])),
        _places("freq", at, m["freqs"]),
        _places("alpha", at, F.array(m["alpha"])),
        _places("pinvar", at, F.array(m["pinvar"])),
    )
    each = F.concat(whole("lnl", F.col("x")), whole("nmodels", F.col("nmodels")), F.flatten(F.transform("models", of)))
    return rows.select(F.explode(each).alias("v")).select("v.*")


def summaries(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(parameter, model, k, n, min_cred, max_cred, mean, var, med) over all runs' joined rows."""
    return posterior.summary(values(rows), ["parameter", "model", "k"], "value", alpha)


def class_posterior(rows: DataFrame) -> DataFrame:
    """(rclass, nobs, p, nclasses): how often each class text was a sample's first model."""
    first = rows.where("nmodels > 0").select(F.col("models")[0]["rclass"].alias("rclass"))
    total = first.agg(F.count("*").alias("total"))
    out = first.groupBy("rclass").agg(F.count("*").alias("nobs")).crossJoin(F.broadcast(total))
    return out.select("rclass", "nobs", (F.col("nobs") / F.col("total")).alias("p"), (F.array_max(rate_classes(F.col("rclass"))) + 1).alias("nclasses"))
