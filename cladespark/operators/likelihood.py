"""Log-likelihood of trees under reversible models, by pruning over partitions of site patterns."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, Alphabet
from ..session import ship
from ..sources.newick import parse


def gamma_ratio(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * scale)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def gamma_quantile(p: float, a: float) -> float:
    """x with gamma_ratio(a, x) = p, by bisection in the logarithm."""
    lo, hi = -700.0, 50.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_ratio(a, math.exp(mid)) < p else (lo, mid)
    return math.exp((lo + hi) / 2)


def gamma_categories(alpha: float, k: int, median: bool = False) -> list[float]:
    """Rates of k equally likely categories of a gamma distribution of mean 1."""
    if math.isinf(alpha) or k == 1:
        return [1.0] * k
    if median:
        out = [gamma_quantile((2 * i + 1) / (2 * k), alpha) for i in range(k)]
        return [x * k / sum(out) for x in out]
    edges = [gamma_ratio(alpha + 1, gamma_quantile(i / k, alpha)) if i else 0.0 for i in range(k)] + [1.0]
    return [(b - a) * k for a, b in zip(edges, edges[1:], strict=False)]


def gamma_table(grid: DataFrame) -> DataFrame:
    """(alpha, ncat, median, category, rate) of (alpha, ncat, median): a map over the rows."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(a, int(k), bool(m), i, r) for a, k, m in zip(pdf["alpha"], pdf["ncat"], pdf["median"], strict=True) for i, r in enumerate(gamma_categories(a, int(k), bool(m)))]
            yield pd.DataFrame(rows, columns=["alpha", "ncat", "median", "category", "rate"])

    return grid.mapInPandas(run, "alpha double, ncat int, median boolean, category int, rate double")


@dataclass(frozen=True)
class Model:
    """rates: of the pairs of states in the order (0,1), (0,2), ...; pinvar: share of sites that never change."""

    freqs: tuple[float, ...] = (0.25,) * 4
    rates: tuple[float, ...] = (1.0,) * 6
    weight: float = 1.0
    rmult: float = 1.0
    alpha: float = math.inf
    ncat: int = 1
    median: bool = False
    pinvar: float = 0.0


@dataclass
class _Part:
    weight: float
    speed: float
    pi: np.ndarray
    lam: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def change(self, length: float) -> np.ndarray:
        return np.maximum((self.left * np.exp(self.lam * self.speed * length)) @ self.right, 0)


def components(models: list[Model]) -> list[_Part]:
    """Mixture components with eigen systems; speeds are scaled to one expected change for each unit of length over all."""
    out, total = [], sum(m.weight for m in models)
    mean = 0.0
    for m in models:
        pi = np.array(m.freqs) / sum(m.freqs)
        n = len(pi)
        r = np.zeros((n, n))
        r[np.triu_indices(n, 1)] = m.rates
        q = (r + r.T) * pi
        np.fill_diagonal(q, -q.sum(1))
        norm = -(pi * np.diag(q)).sum()
        root = np.sqrt(pi)
        lam, v = np.linalg.eigh(q * root[:, None] / root[None, :])
        for rate in gamma_categories(m.alpha, m.ncat, m.median):
            w = m.weight / total * (1 - m.pinvar) / m.ncat
            out.append(_Part(w, m.rmult * rate, pi, lam, v / root[:, None], v.T * root))
            mean += w * m.rmult * rate * norm
        if m.pinvar:
            out.append(_Part(m.weight / total * m.pinvar, 0.0, pi, lam, v / root[:, None], v.T * root))
    for c in out:
        c.speed /= mean
    return out


def site_lnl(tree: str, taxa: list[str], patterns: list[str], models: list[Model], alphabet: Alphabet = DNA, parts: list[_Part] | None = None) -> np.ndarray:
    """Log-likelihood of each pattern (a character of the alphabet for each of taxa); parts: the models' components, where they are at hand."""
    rows = parse(tree)
    values, states = alphabet.values(), len(alphabet.states)
    place = {t: i for i, t in enumerate(taxa)}
    masks = np.array([[values[c] or (1 << states) - 1 for c in p] for p in patterns])
    lik = np.zeros(len(patterns))
    parts = components(models) if parts is None else parts
    logs = []
    for c in parts:
        cl: dict[int, np.ndarray] = {}
        scale = np.zeros(len(patterns))
        for r in reversed(rows):
            if r[5]:
                if r[3] not in place:
                    raise ValueError(f"taxon {r[3]!r} isn't in the alignment")
                here = ((masks[:, place[r[3]]][:, None] >> np.arange(states)) & 1).astype(float)
            else:
                here = cl.pop(r[0])
                top = here.max(1)
                here = here / np.where(top > 0, top, 1)[:, None]
                scale += np.log(np.where(top > 0, top, 1))
            if r[1] is None:
                with np.errstate(divide="ignore"):
                    logs.append(np.log(here @ c.pi) + scale + math.log(c.weight))
            else:
                up = here @ c.change(r[4]).T
                cl[r[1]] = cl[r[1]] * up if r[1] in cl else up
    top = np.max(logs, axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        lik = np.where(np.isfinite(top), top + np.log(np.sum(np.exp(np.array(logs) - top), axis=0)), -np.inf)
    return lik


def lnl(patterns: DataFrame, tree: str, taxa: list[str], models: list[Model], alphabet: Alphabet = DNA) -> DataFrame:
    """(pattern, freq, lnl) of (pattern, freq): lnl is the pattern's, times freq. Sum it for the tree's."""
    parts = ship(patterns.sparkSession).sparkContext.broadcast(components(models))

    def run(batches):
        for pdf in batches:
            yield pdf.assign(lnl=site_lnl(tree, taxa, pdf["pattern"].tolist(), models, alphabet, parts.value) * pdf["freq"].to_numpy())

    return patterns.select("pattern", F.col("freq").cast("long").alias("freq")).mapInPandas(run, "pattern string, freq long, lnl double")


#: Columns of a model's row: a named model has one or more (its mixture).
MODEL_ROW = ("freqs", "rates", "rclass", "weight", "rmult", "alpha", "ncat", "median", "pinvar")

#: Fixed names of the rate classes of DNA (pairs AC AG AT CG CT GT), with equal frequencies and with free ones.
CLASS_NAMES = {"0 0 0 0 0 0": ("JC", "F81"), "0 1 0 0 1 0": ("K80", "HKY"), "0 1 0 0 2 0": ("TrNef", "TrN"), "0 1 2 2 1 0": ("K81", "K81uf"), "0 1 2 2 3 0": ("TIMef", "TIM"), "0 1 2 3 1 4": ("TVMef", "TVM"), "0 1 2 3 4 5": ("SYM", "GTR")}


def canonical_classes(rclass: Column) -> Column:
    """A class text such as `2 0 2 2 0 2` with its classes numbered as they appear: `0 1 0 0 1 0`."""
    found = F.split(F.trim(rclass), r"\s+")
    return F.array_join(F.transform(found, lambda c: (F.array_position(F.array_distinct(found), c) - 1).cast("string")), " ")


def model_name(rclass: Column, freqs: Column) -> Column:
    """The name of a class text, in any numbering, by whether its frequencies are equal; null without a name."""
    equal = F.array_max(freqs) - F.array_min(freqs) < 1e-9
    names = F.create_map(*[x for k, (even, free) in CLASS_NAMES.items() for x in (F.lit(k), F.struct(F.lit(even).alias("even"), F.lit(free).alias("free")))])
    found = F.try_element_at(names, canonical_classes(rclass))
    return F.when(equal, found["even"]).otherwise(found["free"])


def model_rows(spark, models: dict[str, list[Model]]) -> DataFrame:
    """Named models as rows (model, part, freqs, rates, rclass, weight, ...)."""
    rows = [(k, i, list(map(float, m.freqs)), list(map(float, m.rates)), " ".join(map(str, range(len(m.rates)))), m.weight, m.rmult, m.alpha, m.ncat, m.median, m.pinvar) for k, v in models.items() for i, m in enumerate(v)]
    return spark.createDataFrame(rows, "model string, part int, freqs array<double>, rates array<double>, rclass string, weight double, rmult double, alpha double, ncat int, median boolean, pinvar double")


def _model(r) -> Model:
    """A model of a row; its rates are those of its classes, in the order of their numbers."""
    classes = [int(c) for c in r["rclass"].split()]
    if any(c > max(classes[:i], default=-1) + 1 for i, c in enumerate(classes)):
        raise ValueError(f"classes are numbered as they appear, not as in {r['rclass']!r}")
    return Model(tuple(r["freqs"]), tuple(r["rates"][c] for c in classes), r["weight"], r["rmult"], r["alpha"], int(r["ncat"]), bool(r["median"]), r["pinvar"])


#: Parts that the patterns of one tree are dealt to.
SHARES = 16


def tree_lnl(patterns: DataFrame, trees: DataFrame, models: DataFrame | dict[str, list[Model]], taxa: list[str], alphabet: Alphabet = DNA) -> DataFrame:
    """(dataset, tree_id, model, lnl): every tree (dataset, tree_id, newick) under every named model, summed over its dataset's patterns (dataset, pattern, freq).

    models: rows (model, part, freqs, rates, rclass, weight, rmult, alpha, ncat, median,
    pinvar), or a dict. With a column model in trees, a tree is only taken under that one.
    A pattern's likelihood is found once for each distinct tree, pattern and model, however
    many datasets share them, and joined back; sums are Spark's. The patterns of one tree
    are SHARES tasks.
    """
    import pandas as pd

    spark = ship(patterns.sparkSession)
    models = model_rows(spark, models) if isinstance(models, dict) else models
    mixed = models.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("part", *MODEL_ROW))).alias("mixture"))
    runs = trees.withColumn("tree", F.md5("newick"))
    runs = runs.join(mixed, "model") if "model" in trees.columns else runs.crossJoin(F.broadcast(mixed))
    runs = runs.select("dataset", "tree_id", "model", "tree", "newick", "mixture")

    def run(batches):
        for pdf in batches:
            done = []
            for (tree, model), part in pdf.groupby(["tree", "model"], sort=False):
                mixture = [_model(r) for r in part["mixture"].iloc[0]]
                done.append(pd.DataFrame({"tree": tree, "model": model, "pattern": part["pattern"], "each": site_lnl(part["newick"].iloc[0], taxa, part["pattern"].tolist(), mixture, alphabet)}))
            yield pd.concat(done) if done else pd.DataFrame({"tree": [], "model": [], "pattern": [], "each": []})

    both = patterns.select("dataset", "pattern", "freq").join(runs.drop("newick", "mixture"), "dataset")
    needed = both.select("tree", "model", "pattern").distinct()
    texts = runs.groupBy("tree", "model").agg(F.first("newick").alias("newick"), F.first("mixture").alias("mixture"))
    dealt = needed.join(texts, ["tree", "model"]).repartition("tree", "model", F.pmod(F.xxhash64("pattern"), F.lit(SHARES)))
    each = dealt.mapInPandas(run, "tree string, model string, pattern string, each double")
    out = both.join(each, ["tree", "model", "pattern"]).groupBy("dataset", "tree_id", "model").agg(F.sum(F.col("freq") * F.col("each")).alias("lnl"))
    return out.select("dataset", "tree_id", "model", "lnl")


def likeliest_length(patterns: DataFrame, newick_of, taxa: list[str], models: list[Model], lo: float, hi: float, steps: int = 12, grid: int = 9) -> float:
    """The length that makes the tree newick_of(length) likeliest: in each step one job tries a grid of lengths, and the next grid lies around the best."""
    spark = patterns.sparkSession
    data = patterns.select(F.lit(0).alias("dataset"), "pattern", "freq")
    for _ in range(steps):
        at = np.linspace(lo, hi, grid)
        trees = spark.createDataFrame([(0, i, newick_of(float(v))) for i, v in enumerate(at)], "dataset int, tree_id int, newick string")
        best = tree_lnl(data, F.broadcast(trees), {"m": models}, taxa).orderBy(F.desc("lnl"), "tree_id").first()["tree_id"]
        lo, hi = float(at[max(best - 1, 0)]), float(at[min(best + 1, grid - 1)])
    return (lo + hi) / 2


def _simulated(tree: str, models: list[Model], n: int, rng: np.random.Generator) -> tuple[list[str], list[str]]:
    rows, parts = parse(tree), components(models)
    of = rng.choice(len(parts), n, p=np.array([c.weight for c in parts]) / sum(c.weight for c in parts))
    states: dict[int, np.ndarray] = {}
    taxa, seqs = [], []
    for r in rows:  # parents come first
        here = np.zeros(n, np.int64)
        for k, c in enumerate(parts):
            at = np.flatnonzero(of == k)
            upto = np.cumsum(c.pi)[None, :] if r[1] is None else np.cumsum(c.change(r[4]), axis=1)[states[r[1]][at]]
            here[at] = np.minimum((rng.random(len(at))[:, None] * upto[:, -1:] >= upto).sum(1), len(c.pi) - 1)
        states[r[0]] = here
        if r[5]:
            taxa.append(r[3])
            seqs.append("".join(np.array(list("ACGT"))[here]))
    return taxa, seqs


def simulate(spark, tree: str, models: list[Model], nchars: int, seed: int, block: int = 10_000) -> DataFrame:
    """(block, taxon, seq): nchars sites drawn along a tree, in blocks that are drawn apart, each from a seed of its own."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for b in pdf["id"].tolist():
                taxa, seqs = _simulated(tree, models, min(block, nchars - b * block), np.random.default_rng([seed, b]))
                yield pd.DataFrame({"block": b, "taxon": taxa, "seq": seqs})

    return spark.range(-(-nchars // block)).mapInPandas(run, "block long, taxon string, seq string")
