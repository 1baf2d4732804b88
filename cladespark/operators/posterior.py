"""Statistics of posterior samples (run, step, x): burn-in, credible intervals, coverage, moving averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved
from .ordering import ranked


def burn_in(samples: DataFrame, stride: int = 1, skip: int | None = None) -> DataFrame:
    """Samples from the default first step on: ((last / stride / 2) + 1) * stride, in whole numbers, with the last step over all runs. Or those after the first `skip` samples of each run; none left is an error."""
    last = samples.agg(F.max("step").alias("last"))
    if skip is not None:
        left = samples.where(F.col("step") >= skip * stride)
        if left.isEmpty():
            raise ValueError("the burn-in leaves no samples")
        return left
    first = ((F.floor(F.floor(F.col("last") / stride) / 2)) + 1) * stride
    return samples.crossJoin(F.broadcast(last)).where(F.col("step") >= first).drop("last")


def _ranked(samples: DataFrame, keys: list[str], x: str) -> DataFrame:
    ties = [F.col(c) for c in samples.columns if c not in (*keys, x)]
    return ranked(samples, keys, [F.col(x), *ties], "rank", "size")


#: A value that more samples of a key have goes into the moments by its number, not once for each sample.
REPEATS = 64


def summary(samples: DataFrame, keys: list[str], x: str, alpha: float = 0.05) -> DataFrame:
    """Credible interval and median by ranks, mean and population variance of each key's samples; a null is no sample.

    Equal values of a key are counted before they are sorted, so what is sorted is the distinct values.
    """
    counts = samples.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    some = ranked(counts, keys, [F.col(x)], "_k", value=F.col("_n"), running="_upto")
    some = saved(some.select(*keys, x, "_n", F.col("_upto").cast("long").alias("_upto")), "counts")
    whole = some.groupBy(*keys).agg(F.sum("_n").alias("_size"), (F.sum(F.col(x) * F.col("_n")) / F.sum("_n")).alias("_mean"))
    whole = whole.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)], "_size", "_mean")
    both = F.lit(True)
    for i, c in enumerate(keys):
        both = both & F.col(c).eqNullSafe(F.col(f"_key{i}"))
    each = some.join(whole, both).withColumn("_w", F.explode(F.when(F.col("_n") > REPEATS, F.array("_n")).otherwise(F.array_repeat(F.lit(1).cast("long"), F.col("_n").cast("int")))))
    size, many = F.col("_size"), F.col("_n") > REPEATS
    low = F.floor(size * (alpha / 2))
    at = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col(x)))
    middle = (at(F.floor((size - 1) / 2)) + at(F.floor(size / 2))) / 2
    one, off = F.when(~many, F.col(x)), F.col(x) - F.col("_mean")
    moments = [F.count(one).alias("_c"), F.avg(one).alias("_m"), F.var_pop(one).alias("_v"), F.max("_mean").alias("_all"), F.sum(F.when(many, off * off * F.col("_n"))).alias("_far")]
    out = each.groupBy(*keys).agg(F.max("_size").alias("n"), at(low).alias("min_cred"), at(size - 1 - low).alias("max_cred"), *moments, middle.alias("med"))
    apart = F.col("_m") - F.col("_all")
    var = (F.col("_far") + F.coalesce(F.col("_c") * (F.col("_v") + apart * apart), F.lit(0.0))) / F.col("n")
    return out.select(*keys, "n", "min_cred", "max_cred", F.when(F.col("_far").isNull(), F.col("_m")).otherwise(F.col("_all")).alias("mean"), F.when(F.col("_far").isNull(), F.col("_v")).otherwise(var).alias("var"), "med")


def coverage(samples: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Rcov of a number: the mean share of all runs' samples inside each run's interval, scaled by (1 - alpha) / (1 - tails)."""
    low = F.floor(F.col("size") * (alpha / 2))
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("x")))
    bounds = _ranked(samples, ["run"], "x").groupBy("run").agg(at(low).alias("lo"), at(F.col("size") - 1 - low).alias("hi"), F.max(1 - 2 * low / F.col("size")).alias("held"))
    # One pass over the samples for each few hundred runs: an average for each run's interval.
    shares, runs = [], bounds.orderBy("run").collect()
    for lo in range(0, len(runs), 500):
        part = runs[lo : lo + 500]
        got = samples.agg(*[F.avg(F.col("x").between(r["lo"], r["hi"]).cast("double")).alias(f"c{k}") for k, r in enumerate(part)]).first()
        shares += [got[f"c{k}"] * (1 - alpha) / r["held"] for k, r in enumerate(part)]
    return samples.sparkSession.createDataFrame([(sum(shares) / len(shares) if shares else None,)], "rcov double")


def class_coverage(samples: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Rcov of a class: each run drops its rarest classes up to a tail of alpha (ties at the edge stay), and what is left is covered over all runs."""
    counts = samples.groupBy("run", "cls").agg(F.count("*").alias("n"))
    w = Window.partitionBy("run")
    upto = counts.withColumn("upto", F.sum("n").over(w.orderBy("n").rangeBetween(Window.unboundedPreceding, 0))).withColumn("size", F.sum("n").over(w))
    kept = upto.where(F.col("upto") > F.floor(F.col("size") * alpha)).select(F.col("run").alias("of"), "cls", "n", "size")
    held = kept.groupBy("of").agg((F.sum("n") / F.max("size")).alias("held"))
    total = samples.agg(F.count("*").alias("total"))
    hits = kept.select("of", "cls").join(samples, "cls").groupBy("of").agg(F.count("*").alias("hits"))
    each = hits.join(held, "of").crossJoin(F.broadcast(total)).select((F.col("hits") / F.col("total") * (1 - alpha) / F.col("held")).alias("c"))
    return each.agg(F.avg("c").alias("rcov"))


def moving_average(samples: DataFrame, alpha: float) -> DataFrame:
    """(run, ema): exponential moving average over a run's steps, from 0; the closed form, so nothing is gathered."""
    last = samples.groupBy("run").agg(F.max("step").alias("last"))
    weight = F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("last") - F.col("step"))
    return samples.join(last, "run").groupBy("run").agg(F.sum(weight * F.col("x")).alias("ema"))


def class_summary(samples: DataFrame) -> DataFrame:
    """(cls, nobs, p, mean, var) of the classes of all runs' samples: posterior shares and the moments of x within each."""
    out = samples.groupBy("cls").agg(F.count("*").alias("nobs"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    total = samples.count()
    return out.select("cls", "nobs", (F.col("nobs") / total).alias("p"), "mean", "var")


def acceptance(rows: DataFrame, keys: list[str], accepted: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count_if(accepted).alias("accepts"), F.count_if(~accepted).alias("rejects"), (F.count_if(accepted) / F.count("*")).alias("rate"))


def strided(samples: DataFrame, stride: int) -> DataFrame:
    return samples.where(F.col("step") % stride == 0)


def swap_pairs(samples: DataFrame, stride: int = 1) -> DataFrame:
    """(step, a, b, dx): pairs of runs a < b at each step that stride divides, with the difference of their x."""
    s = samples.where(F.col("step") % stride == 0)
    a, b = s.select("step", F.col("run").alias("a"), F.col("x").alias("xa")), s.select("step", F.col("run").alias("b"), F.col("x").alias("xb"))
    return a.join(b, "step").where("a < b").select("step", "a", "b", (F.col("xa") - F.col("xb")).alias("dx"))


def swap_rates(swaps: DataFrame, stride: int, alpha: float | None = None) -> DataFrame:
    """(run, window, rate) of (run, step, n), n the number of a step's partners in swaps: each swap has two. With alpha (run, ema), their moving average."""
    rates = swaps.groupBy("run", F.floor(F.col("step") / stride).alias("window")).agg((F.sum("n") / (2.0 * stride)).alias("rate"))
    return rates if alpha is None else moving_average(rates.select("run", F.col("window").alias("step"), F.col("rate").alias("x")), alpha)


def step_windows(samples: DataFrame, stride: int) -> DataFrame:
    """(run, window, n, mean) of tumbling windows of so many steps."""
    return samples.groupBy("run", F.floor(F.col("step") / stride).alias("window")).agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
