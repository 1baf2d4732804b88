"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Only DataFrame functions. The text is read once; everything after works on a narrow
table of statistics. Centre and scatter of each (lang, source) group come from sums over
all its rows (partial aggregates, so that a group with a third of all rows is no hot
task). Concentration steps go from three deterministic starts (medians with quartile
scales, all rows, spatial signs about the medians) until no determinant falls any more;
each group keeps the estimate of least determinant. The half-sample's edge comes from a
histogram of log(1 + squared distance): rows of the bin that holds the edge all belong to
the half-sample, so ties never split it and it may be larger by 1/64 of a unit of that scale.

A group's estimate is drawn towards that over all rows with the weight of PRIOR_ROWS rows,
so that nothing switches at some size of group. Null text counts as empty. Null lang or
source is a group of its own. A group without a usable row takes the estimate over all
rows; with no usable row at all nothing is rejected by distance. doc_id may be of any type
and is carried only, so rows that repeat one are judged each. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import sized, stash

SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ("word_length", "symbols", "capitals", "repeats", "marks")
#: Least scatter of each transformed statistic, so that a group where one never varies has no singular matrix.
FLOORS = (0.06, 0.08, 0.08, 0.12, 0.10)
#: Share of a group's rows in the half-sample; C-steps at most, and the fall of a log determinant from which there is another; rows that the estimate over all rows counts for in each group.
SUBSET, STEPS, FALL, PRIOR_ROWS = 0.75, 5, 1e-2, 200.0
#: Median of chi squared with five degrees of freedom, and the squared distance beyond which a text is rejected: its quantile at 1 - 5e-20, as clean texts' statistics have much longer tails than normal ones.
MEDIAN_CHI2, CUTOFF = 4.3515, 100.0
#: Statistics are smoothed by so many words, as a short text's shares are noisy.
PRIOR_WORDS = 20.0
_ALL, _START = "\u0003all", "\u0004"
#: Up to so many groups (about 20 MB) their estimates are broadcast, so that a group with most rows isn't one task; beyond, joined by a shuffle.
BROADCAST_GROUPS = 100_000


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, grp and the base columns and features of every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0002"))
    base = docs.select("doc_id", F.concat_ws("\u0001", name("lang"), name("source")).alias("grp"), text.alias("text"))
    base = base.withColumn("w", F.array_remove(F.split("text", SPACE), "")).withColumn("n", F.size("w"))
    base = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0))
    base = base.withColumn("hashes", F.when(F.col("n") >= 5, F.transform(F.sequence(F.lit(1), F.col("n") - 4), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(-1, 4)]))).otherwise(F.array().cast("array<bigint>")))
    base = base.select(
        "doc_id",
        "grp",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"[A-Z]")).alias("upper"),
        F.regexp_count("text", F.lit(r"[!?.,;:]")).alias("marks"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        "hashes",
        (F.size(F.array_distinct("hashes")) < F.size("hashes")).alias("again"),
    )
    # Only texts with a repeated window go on to the positions of those windows.
    pair = lambda h, i: F.struct(h.alias("h"), i.alias("i"))
    base = base.withColumn("sorted", F.when(F.col("again"), F.sort_array(F.transform("hashes", pair))))
    near = lambda j, step: F.get(F.col("sorted"), j + step)["h"]
    twice = F.filter("sorted", lambda x, j: F.coalesce(near(j, -1) == x["h"], F.lit(False)) | F.coalesce(near(j, 1) == x["h"], F.lit(False)))
    base = base.withColumn("at", F.when(F.col("again"), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    base = base.withColumn("n_repeat_words", F.coalesce(F.when(F.col("again"), covered), F.lit(0)).cast("long"))
    words = F.col("n_words") + PRIOR_WORDS
    share = lambda c, d: F.sqrt(c / d)
    return base.select(
        "doc_id",
        "grp",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.log((F.col("word_chars") + 5 * PRIOR_WORDS) / words).alias("f0"),
        share(F.col("n_symbols"), words).alias("f1"),
        share(F.col("upper"), F.col("word_chars") + 5 * PRIOR_WORDS).alias("f2"),
        share(F.col("n_repeat_words") + F.col("n_dup_lines"), words).alias("f3"),
        share(F.col("marks"), words).alias("f4"),
    )


def _quantile(rows: DataFrame, keys: list[str], value: Column, share: float, bins: float, name: str) -> DataFrame:
    """keys and the upper edge of the bin that holds the given share of a key's values: exact to 1 / bins."""
    counts = rows.groupBy(*keys, F.floor(value * bins).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    return run.where(F.col("upto") >= share * F.col("all")).groupBy(*keys).agg(((F.min("bin") + 1) / bins).alias(name))


def _with_pool(rows: DataFrame) -> DataFrame:
    """Each row once for its group and once for the estimate over all rows, as two rows of partial aggregates need it."""
    return rows.withColumn("grp", F.explode(F.array(F.col("grp"), F.lit(_ALL))))


_MEANS = [f"m{i}" for i in range(len(FEATURES))]
_FACTOR = [f"l{i}{j}" for i in range(len(FEATURES)) for j in range(i + 1)]
_COV = [f"c{i}{j}" for i in range(len(FEATURES)) for j in range(i + 1)]


def _medians(rows: DataFrame) -> DataFrame:
    """Medians, and scales from quartiles as a diagonal factor."""
    p = len(FEATURES)
    long = rows.select("grp", F.posexplode(F.array(*[f"f{i}" for i in range(p)])).alias("k", "x"))
    counts = long.groupBy("grp", "k", F.floor(F.col("x") * 200.0).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("grp", "k")
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    low = lambda share: (F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin"))) + 1) / 200.0
    q = run.groupBy("grp", "k").agg(low(0.25).alias("q0"), low(0.5).alias("q1"), low(0.75).alias("q2"))
    floor = F.get(F.array(*map(F.lit, FLOORS)), F.col("k"))
    q = q.select("grp", "k", "q1", F.greatest((F.col("q2") - F.col("q0")) / 1.349, floor).alias("s"))
    at = lambda c, i: F.max(F.when(F.col("k") == i, F.col(c)))
    mean = [at("q1", i).alias(f"m{i}") for i in range(p)]
    scatter = [(at("s", i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(p) for j in range(i + 1)]
    return q.groupBy("grp").agg(*mean, *scatter)


def _factored(cov: DataFrame, floors: bool) -> DataFrame:
    """cov with the lower Cholesky factor of its columns c; floors: least scatters are added."""
    for i in range(len(FEATURES)):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j and floors else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            cov = cov.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return cov


def _estimate(rows: DataFrame) -> DataFrame:
    """Mean and lower Cholesky factor of the covariance of each group's rows."""
    p = len(FEATURES)
    f = [F.col(f"f{i}") for i in range(p)]
    sums = [F.avg(f[i]).alias(f"m{i}") for i in range(p)] + [F.covar_pop(f[i], f[j]).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    return _factored(rows.groupBy("grp").agg(*sums), True).select("grp", *_MEANS, *_FACTOR)


def _signs(rows: DataFrame, mid: DataFrame) -> DataFrame:
    """Medians with the covariance of the rows' directions from them, in units of the quartile scales."""
    p = len(FEATURES)
    far = _distance(rows, mid)
    one = F.greatest(F.sqrt("d2"), F.lit(1e-9))
    unit = far.select("grp", *[(F.col(f"z{i}") / one * F.sqrt(F.lit(float(p))) * F.col(f"l{i}{i}")).alias(f"f{i}") for i in range(p)])
    return _estimate(unit).drop(*_MEANS).join(mid.select("grp", *_MEANS), "grp").select("grp", *_MEANS, *_FACTOR)


def _distance(rows: DataFrame, est: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance by their group's estimate (forward substitution)."""
    p = len(FEATURES)
    out = rows.join(est, "grp", "left")
    for i in range(p):
        rest = F.col(f"f{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    d2 = F.col("z0") * F.col("z0")
    for i in range(1, p):
        d2 = d2 + F.col(f"z{i}") * F.col(f"z{i}")
    return out.withColumn("d2", d2)


def _starts(rows: DataFrame, small) -> DataFrame:
    """First estimates: of each group one for each start, told apart by the mark after the group's name."""
    mid = stash(_medians(rows), "mcd")
    named = lambda est, k: est.withColumn("grp", F.concat("grp", F.lit(f"{_START}{k}")))
    return stash(named(mid, 0).unionByName(named(_estimate(rows), 1)).unionByName(named(_signs(rows, small(mid)), 2)), "mcd")


def _logdet() -> Column:
    return reduce(lambda a, b: a + b, [F.log(f"l{i}{i}") for i in range(len(FEATURES))]) * 2


def fit(stats: DataFrame) -> DataFrame:
    """One row for each group with usable rows, and one for all rows: mean, Cholesky factor, scale of d2."""
    p = len(FEATURES)
    usable = stats.where(~F.col("base_failed")).select("grp", *[f"f{i}" for i in range(p)])
    rows = stash(_with_pool(usable), "mcd")
    few = rows.select("grp").distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    small = lambda df: F.broadcast(df) if few else df
    est = _starts(rows, small)
    spread = F.log1p("d2")
    each = rows.withColumn("grp", F.explode(F.array(*[F.concat("grp", F.lit(f"{_START}{k}")) for k in range(3)])))
    for step in range(STEPS):
        far = _distance(each, small(est))
        edge = small(stash(_quantile(far, ["grp"], spread, SUBSET, 64.0, "edge"), "mcd"))
        nxt = stash(_estimate(far.join(edge, "grp").where(spread <= F.col("edge")).select("grp", *[f"f{i}" for i in range(p)])), "mcd")
        before = est.select("grp", _logdet().alias("before"))
        fall = nxt.select("grp", _logdet().alias("after")).join(before, "grp").agg(F.max(F.col("before") - F.col("after"))).first()[0]
        est = nxt
        if step and (fall is None or fall < FALL):
            break
    best = est.withColumns({"start": F.expr("right(grp, 1)"), "grp": F.expr("left(grp, length(grp) - 2)")})
    best = best.groupBy("grp").agg(F.min(F.struct(_logdet().alias("logdet"), "start", *_MEANS, *_FACTOR)).alias("x")).select("grp", *[F.col(f"x.{c}").alias(c) for c in (*_MEANS, *_FACTOR)])
    est = stash(best, "mcd")
    mid = _quantile(_distance(rows, small(est)), ["grp"], spread, 0.5, 256.0, "mid")
    sizes = rows.groupBy("grp").agg(F.count("*").alias("rows"))
    est = est.join(mid, "grp").join(sizes, "grp")
    # Covariances of the groups, each drawn towards that of all rows; the difference of the means counts as scatter, too.
    cov = {f"c{i}{j}": reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j + 1)]) for i in range(p) for j in range(i + 1)}
    est = stash(est.withColumns(cov).withColumn("scale", F.greatest(F.expm1("mid") / MEDIAN_CHI2, F.lit(0.25))).select("grp", "rows", "scale", *_MEANS, *_COV), "mcd")
    pool = est.where(F.col("grp") == _ALL).first()  # one row of numbers
    if pool is None:
        return est.select("grp", "scale", *_MEANS, *[F.lit(0.0).alias(c) for c in _FACTOR])
    w = F.when(F.col("grp") == _ALL, F.lit(1.0)).otherwise(F.col("rows") / (F.col("rows") + PRIOR_ROWS))
    mixed = lambda c: w * F.col(c) + (1 - w) * pool[c]
    gap = lambda i: F.col(f"m{i}") - pool[f"m{i}"]
    drawn = est.select("grp", mixed("scale").alias("scale"), *[mixed(c).alias(c) for c in _MEANS], *[(mixed(f"c{i}{j}") + w * (1 - w) * gap(i) * gap(j)).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)])
    return stash(_factored(drawn, False).select("grp", "scale", *_MEANS, *_FACTOR), "mcd")


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance (squared, robust) and kept, for each row of docs.

    kept is false for texts of fewer than ten words or with over a fifth of their words
    in repeated five-word windows, and for texts farther than cutoff from their group.
    """
    stats = stash(statistics(docs), "stats")
    est = sized(fit(stats), BROADCAST_GROUPS)
    known = est.select(F.col("grp").alias("own")).where(F.col("own") != _ALL)
    rows = stats.join(known, F.col("grp") == F.col("own"), "left").withColumn("grp", F.coalesce("own", F.lit(_ALL)))
    out = _distance(rows, est).withColumn("distance", F.col("d2") / F.col("scale"))
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("distance"), kept.alias("kept"))
