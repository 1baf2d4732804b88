"""Sampler logs in batches and streams, and simulation against the model's own likelihood."""

import numpy as np
import pytest

from cladespark.operators import posterior
from cladespark.operators.likelihood import Model, simulate
from cladespark.sources import logs
from cladespark.streaming import live


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_scans(spark):
    s = logs.scan_samples(lines(spark, "step [ lnL ] Rcov", "", "100 [ -1.5 -2e1 ] --------", "200 [ -3 -4 ] 0.9 [ --- ]"))
    assert sorted(map(tuple, s.collect())) == [(0, 100, -1.5), (0, 200, -3.0), (1, 100, -20.0), (1, 200, -4.0)]
    t = logs.scan_trees(lines(spark, "[run step] tree", "[0 100] (A:1e0,B:2);", "[1 100] (A,"))
    assert list(map(tuple, t.collect())) == [(0, 100, "(A:1e0,B:2);")]
    p = logs.scan_parameters(lines(spark, "0 100 1 0.5 1.0 ( 0 0 1 ) [ 1 2.5 ] 0.9 inf 0 [ .1 .9 ]", "run step")).collect()
    assert len(p) == 1 and (p[0]["rclass"], list(p[0]["rates"]), list(p[0]["freqs"]), p[0]["alpha"]) == ("0 0 1", [1.0, 2.5], [0.1, 0.9], float("inf"))
    assert list(map(tuple, logs.scan_settings(lines(spark, "Seed 3", "  nruns: 2", "  a.b:  x y ")).collect())) == [("nruns", "2"), ("a.b", "x y")]


def test_short_runs_and_nulls_keep_their_step(spark):
    rows = [(0, 1, 1.5), (1, 1, None), (2, 1, 3.0), (2, 2, 4.0)]
    s = spark.createDataFrame(rows, "run long, step long, x double")
    got = logs.scan_samples(logs.sample_lines(s)).collect()
    assert sorted(map(tuple, got)) == [r for r in rows if r[2] is not None]


def test_swaps_pair_every_step(spark):
    s = spark.createDataFrame([(r, t, float(r)) for r in range(3) for t in (1, 2, 50)], "run long, step long, x double")
    assert posterior.swap_pairs(s).count() == 9 and posterior.swap_pairs(s, 50).count() == 3


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.s").write_text("100 [ -1 -5 ] -\n200 [ -3 -7 ] -\n")
    q = live.watch(spark, str(folder), "watched", str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
        (folder / "b.s").write_text("300 [ -2 -6 ] -\n")
        q.processAllAvailable()
        got = {r["run"]: (r["n"], r["mean"], r["last"]) for r in spark.table("watched").collect()}
    finally:
        q.stop()
    assert got == {0: (3, -2.0, 300), 1: (3, -6.0, 300)}


def test_simulation(spark):
    model = Model(freqs=(0.4, 0.3, 0.2, 0.1))
    rows = simulate(spark, "(A:0.3,B:0.2,C:0);", [model], 40_000, seed=3, block=15_000).collect()
    seq = {t: "".join(r["seq"] for r in sorted(rows, key=lambda r: r["block"]) if r["taxon"] == t) for t in "ABC"}
    assert {len(s) for s in seq.values()} == {40_000}
    share = np.array([seq["C"].count(c) for c in "ACGT"]) / 40_000
    assert share == pytest.approx(np.array(model.freqs), abs=0.012)
    differ = np.mean([a != c for a, c in zip(seq["A"], seq["C"], strict=True)])
    beta = 1 / (1 - np.dot(model.freqs, model.freqs))
    assert differ == pytest.approx((1 - np.exp(-beta * 0.3)) / beta, abs=0.012)
