"""Reports by their lines, coverage of a stream against that of a batch, model rows and class names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladespark.operators import likelihood, parameters, posterior, reports
from cladespark.sources import logs
from cladespark.streaming import convergence


def lines(report):
    rows = sorted(report.collect())
    assert [r[0] for r in rows] == list(range(len(rows)))
    return [r[1] for r in rows]


def test_partitions(spark):
    """Seven taxa: a second group of five, after a line of bars."""
    taxa = spark.createDataFrame([(k + 1, f"taxon{k}") for k in range(7)], "place int, taxon string")
    freqs = spark.createDataFrame([("0000011", 9, 0.5, 0.25, 0.125, 2), ("0001111", 10, 1.5, 0.0, 0.0, 2), ("0000110", 9, 2.0, 0.0, 0.5, 1)], "split string, nobs long, mean double, var double, mse double, nruns long")
    got = lines(reports.parts(freqs, taxa, 20))
    assert got[:8] == ["taxon0", "|taxon1", "| taxon2", "|  taxon3", "|   taxon4", "|", "|     taxon5", "|     |taxon6"]
    assert got[8] == "|     |" and got[9] == "|     |    #obs\tProbability\tMSE\t\tmean(v)\t\tvar(v)\t\t#runs"
    assert got[10:] == ["...** **     10\t0.500000\t0.000000\t1.50000e+00\t0.00000e+00\t2", "....* *.      9\t0.450000\t0.500000\t2.00000e+00\t0.00000e+00\t1", "..... **      9\t0.450000\t0.125000\t5.00000e-01\t2.50000e-01\t2"]


def test_topologies_and_summary(spark, tmp_path):
    freqs = spark.createDataFrame([("x", 3, 0.75, 0.75, 2, 0), ("y", 1, 0.25, 1.0, 1, 1)], "topology string, nobs long, p double, cum_p double, nruns long, rank long")
    trees = spark.createDataFrame([("x", "(a,b);"), ("y", "(b,a);")], "topology string, newick string")
    mse = spark.createDataFrame([("x", 0.5), ("y", 0.0)], "topology string, mse double")
    out = reports.topologies(freqs, trees, mse)
    assert lines(out) == ["[[#obs p P MSE #runs] tree]", "[3 0.750000 0.750000 0.500000 2] (a,b);", "[1 0.250000 1.000000 0.000000 1] (b,a);"]
    reports.write(out, f"{tmp_path}/t")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/t").withColumn("f", F.input_file_name()).orderBy("f").collect()] == lines(out)
    samples = spark.createDataFrame([(r, k, float(k + r)) for r in range(2) for k in range(10)], "run long, step long, x double")
    models = samples.select("run", "step", F.lit(0).alias("model"), *[F.lit(1.0).alias(c) for c in ("weight", "rmult", "w_norm", "alpha", "pinvar")], F.lit("0 0").alias("rclass"), F.array(F.lit(2.0), F.lit(2.0)).alias("rates"), F.array(F.lit(0.5), F.lit(0.5)).alias("freqs"))
    stats = parameters.summaries(parameters.joined(samples, models))
    rcov = posterior.coverage(samples).select(F.lit("lnl").alias("parameter"), "rcov").union(spark.createDataFrame([("rclass", None)], "parameter string, rcov double"))
    got = lines(reports.summary(stats, rcov, None, 20, 5, 9))
    assert got[:4] == ["burnin: <half>", "nsamples: 20", "stepFirst: 5", "stepLast: 9"] and "rclass\t\tN/A" in got
    assert next(x for x in got if x.startswith("lnl\t\t0")).endswith("\t0.950000\t0.940000")
    assert "lnl\t\t5.000000\t8.500000\t0.000000\t10.000000\t5.000000" in got
    assert any(x.startswith("rate[0,1]\t\t2.000000") for x in got)


def plain_rcov(rows, stride, alpha=0.05):
    runs = {}
    for run, step, x in rows:
        runs.setdefault(run, {})[step] = x
    last = min(max(r) for r in runs.values())
    first = (last // stride // 2 + 1) * stride
    half = {k: [x for s, x in r.items() if first <= s <= last] for k, r in runs.items()}
    every = [x for r in half.values() for x in r]
    if not every:
        return last, 0, 0.0
    out = []
    for own in half.values():
        own = sorted(own)
        low = int(alpha / 2 * len(own))
        lo, hi = own[low], own[len(own) - 1 - low]
        out.append(sum(lo <= x <= hi for x in every) / len(every) * (1 - alpha) / (1 - 2 * low / len(own)))
    return max(s for r in runs.values() for s in r if first <= s <= last), len(every), sum(out) / len(out)


def test_stream_ends_as_the_batch(spark, tmp_path):
    """Files that arrive one after another, a stream that is stopped and started again, and the batch over all of them."""
    rng = np.random.default_rng(5)
    rows = [(r, k * 10, float(rng.normal(r / 4, 1))) for k in range(1, 121) for r in range(3)]
    where = tmp_path / "logs"
    where.mkdir()
    for n in range(3):
        part = spark.createDataFrame([x for x in rows if n * 400 < x[1] <= (n + 1) * 400], "run long, step long, x double")
        (where / f"{n}.s").write_text("\n".join(r["value"] for r in logs.sample_lines(part).collect()) + "\n")
        q = convergence.watch(spark, str(where), f"{tmp_path}/out", f"{tmp_path}/state", stride=10, availableNow=True)
        q.awaitTermination()
        assert q.exception() is None
    got = spark.read.parquet(f"{tmp_path}/out/rcov").orderBy("batch").collect()
    assert len(got) == 3
    for n, r in enumerate(got):
        last, count, rcov = plain_rcov([x for x in rows if x[1] <= (n + 1) * 400], 10)
        assert (r["last"], r["n"]) == (last, count) and abs(r["rcov"] - rcov) < 1e-9
    whole = convergence.sampling_coverage(spark.createDataFrame(rows, "run long, step long, x double"), 10).first()
    assert (whole["last"], whole["n"]) == (got[-1]["last"], got[-1]["n"]) and abs(whole["rcov"] - got[-1]["rcov"]) < 1e-12


def test_models_as_rows(spark):
    pats = spark.createDataFrame([(0, "AAA", 3), (0, "ACA", 1), (1, "ACA", 2)], "dataset int, pattern string, freq long")
    found = spark.createDataFrame([(0, 0, "(A:0.1,B:0.2,C:0.3);", "mix"), (1, 0, "(A:0.1,B:0.2,C:0.3);", "k80")], "dataset int, tree_id int, newick string, model string")
    mix = [likelihood.Model(weight=2.0, rates=(1.0, 3.0, 1.0, 1.0, 3.0, 1.0)), likelihood.Model(alpha=0.5, ncat=4, pinvar=0.1, freqs=(0.1, 0.2, 0.3, 0.4))]
    rows = likelihood.model_rows(spark, {"mix": mix, "k80": mix[:1]})
    rows = rows.withColumn("rates", F.when(F.col("model") == "k80", F.array(F.lit(1.0), F.lit(3.0))).otherwise(F.col("rates"))).withColumn("rclass", F.when(F.col("model") == "k80", "0 1 0 0 1 0").otherwise(F.col("rclass")))
    got = {(r["dataset"], r["model"]): r["lnl"] for r in likelihood.tree_lnl(pats, found, rows, list("ABC")).collect()}
    one = lambda models, p: likelihood.site_lnl("(A:0.1,B:0.2,C:0.3);", list("ABC"), [p], models)[0]
    assert got.keys() == {(0, "mix"), (1, "k80")}
    assert abs(got[0, "mix"] - 3 * one(mix, "AAA") - one(mix, "ACA")) < 1e-9 and abs(got[1, "k80"] - 2 * one(mix[:1], "ACA")) < 1e-9
    with pytest.raises(Exception, match="numbered as they appear"):
        likelihood.tree_lnl(pats, found, rows.withColumn("rclass", F.lit("1 0 1 1 0 1")), list("ABC")).collect()


def test_names_of_classes(spark):
    rows = spark.createDataFrame([("3 1 3 3 1 3", [0.25] * 4), ("0 1 0 0 1 0", [0.1, 0.2, 0.3, 0.4]), ("0 0 0 0 0 1", [0.25] * 4), ("5 4 3 2 1 0", [0.25] * 4)], "rclass string, freqs array<double>")
    got = rows.select(likelihood.canonical_classes(F.col("rclass")), likelihood.model_name(F.col("rclass"), F.col("freqs"))).collect()
    assert [tuple(r) for r in got] == [("0 1 0 0 1 0", "K80"), ("0 1 0 0 1 0", "HKY"), ("0 0 0 0 0 1", None), ("0 1 2 3 4 5", "SYM")]
