"""Steps whose keys, groups or trees hold most of the rows."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladespark.operators import blockjoin, blocks, distance, posterior, splits, trees
from cladespark.plans import inputs
from cladespark.sources import logs, newick


@pytest.fixture
def star(spark):
    rows = [("r", None, 0.0)] + [(f"x{k:02}", "r", float(k)) for k in range(60)]
    return spark.createDataFrame(rows, "node string, parent string, length double")


def shares(df):
    """Rows of the largest task of a result, and all."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n), sum(n)


def test_leaves_of_one_node_meet_in_many_tasks(spark, star, monkeypatch):
    monkeypatch.setattr(trees, "SIDE", 8, raising=False)
    monkeypatch.setattr(trees, "PAIRS", 100, raising=False)
    got = trees.patristic(star)
    most, n = shares(got)
    assert n == 60 * 59 // 2 and most < n / 3
    want = {(f"x{i:02}", f"x{j:02}", float(i + j), 2) for i in range(60) for j in range(i + 1, 60)}
    assert {tuple(r) for r in got.collect()} == want
    few = star.where("node in ('x03', 'x40')").select(F.col("node").alias("leaf"))
    got = trees.patristic(star, of=few)
    most, n = shares(got)
    assert n == 2 * 59 and most < n / 2
    assert {tuple(r) for r in got.collect()} == {(f"x{i:02}", f"x{j:02}", float(i + j), 2) for i in (3, 40) for j in range(60) if i != j}


def test_siblings_of_one_parent_meet_in_many_tasks(spark, star, monkeypatch):
    monkeypatch.setattr(trees, "SIDE", 8)
    monkeypatch.setattr(trees, "PAIRS", 100)
    got = trees.siblings(star.where("parent = 'r'"))
    most, n = shares(got)
    assert n == 60 * 59 // 2 and most < n / 3
    assert {tuple(r) for r in got.collect()} == {(f"x{i:02}", f"x{j:02}", float(i + j)) for i in range(60) for j in range(i + 1, 60)}


def test_many_branches_of_a_node_take_few_rounds(spark, monkeypatch):
    """Sixty leaves below four nodes: two leaves a node in a round would take fourteen rounds."""
    lengths = {f"n{k}": 1.0 + k for k in range(4)}
    far = lambda i: 0.5 + i / 64
    cells = [(i, j, far(i) + far(j) + (0.0 if i % 4 == j % 4 else lengths[f"n{i % 4}"] + lengths[f"n{j % 4}"])) for i in range(60) for j in range(i + 1, 60)]
    rounds = []
    even = blockjoin._even
    monkeypatch.setattr(blockjoin, "_even", lambda *a: rounds.append(1) or even(*a))
    edges = blockjoin.joined_edges(spark.createDataFrame(cells, "i int, j int, d double"), 4)
    found = {(r["split"], round(r["length"], 6)) for r in blockjoin.splits(edges.where("true"), 60).where("length > 1e-6").collect()}
    side = lambda k: "".join("1" if (i % 4 == k) != (k == 0) else "0" for i in range(60))
    assert {s for s, _ in found} == {side(k) for k in range(4)} and len(rounds) <= 8


def test_path_lengths_are_joined_without_a_table_of_cells(spark, monkeypatch):
    """Forty leaves below four nodes: what a round stores is a row or two for each node, and the splits are those of the table of cells."""
    leaves = [(f"x{i:02}", f"n{i % 4}", 0.5 + i / 64) for i in range(40)]
    edges = spark.createDataFrame([("r", None, 0.0), *((f"n{k}", "r", 1.0 + k) for k in range(4)), *leaves], "node string, parent string, length double")
    stored = []
    saved = blockjoin.saved
    monkeypatch.setattr(blockjoin, "saved", lambda df, name: stored.append((name, df.count())) or saved(df, name))
    monkeypatch.setattr(blocks, "BLOCK", 8)
    paths = trees.paths(edges).withColumn("k", F.substring("leaf", 2, 2).cast("long"))
    found = blockjoin.joined_paths(paths, 12)
    got = {(r["split"], round(r["length"], 6)) for r in blockjoin.splits(found, 40).where("length > 1e-6").collect()}
    assert max(n for _, n in stored) <= 80 and "cells" not in {name for name, _ in stored} and found.count() == 2 * 40 - 3
    side = lambda k: "".join("1" if (i % 4 == k) != (k == 0) else "0" for i in range(40))
    assert got == {(side(k), 1.0 + k) for k in range(4)}
    monkeypatch.setattr(blockjoin, "EQUAL", -1.0)  # no pair counts as even: a table of cells goes on
    few = paths.where("k < 16")
    rest = blockjoin.splits(blockjoin.joined_paths(few, 12), 16).where("length > 1e-6").collect()
    assert {r["split"]: round(r["length"], 6) for r in rest} == {"".join("1" if (i % 4 == k) != (k == 0) else "0" for i in range(16)): 1.0 + k for k in range(4)}


def test_rows_sent_to_blocks_grow_as_the_table(spark, monkeypatch):
    """Twice the leaves are sent twice as often in all, not four times."""
    monkeypatch.setattr(trees, "SIDE", 4)
    sent = []
    frame = type(spark.range(1))
    for name in ("repartitionById", "repartition"):
        monkeypatch.setattr(frame, name, lambda df, *a, plain=getattr(frame, name): sent.append(df.count()) or plain(df, *a))
    for n in (200, 400):
        star = spark.createDataFrame([("r", None, 0.0), *((f"x{k:03}", "r", 1.0) for k in range(n))], "node string, parent string, length double")
        assert trees.patristic(star).count() == n * (n - 1) // 2
    half = len(sent) // 2
    assert sent and sum(sent[half:]) <= 2.5 * sum(sent[:half])


def test_distances_by_large_blocks(spark, monkeypatch):
    """Kernels of tiles against the pair functions; a row goes to a group for each large block."""
    rng = random.Random(5)
    rows = [(i, [rng.choice((1, 2, 4, 8, 15, 0)) for _ in range(40)]) for i in range(70)] + [(70, [1] * 40)]
    df = spark.createDataFrame(rows, "tid int, v array<int>")
    monkeypatch.setattr(distance, "BLOCK", 4)
    for gaps in (True, False):
        stats = distance.pairs(df, score_gaps=gaps)
        plain = {"p": distance.p_distance, "jukes_cantor": distance.jukes_cantor}
        for kind, how in plain.items():
            want = {(r["i"], r["j"]): r["d"] for r in how(stats).collect()}
            got = {(r["i"], r["j"]): r["d"] for r in distance.matrix_distance(df, kind, score_gaps=gaps).collect()}
            assert got == pytest.approx(want) and len(got) == 71 * 70 // 2
        codes = {i: np.array(v) if not gaps else np.where(np.array(v) == 0, 15, v) for i, v in rows}
        for kind, one in (("kimura", distance.kimura_dna), ("logdet", distance.log_det)):
            got = {(r["i"], r["j"]): r["d"] for r in distance.matrix_distance(df, kind, score_gaps=gaps).collect()}
            assert got == pytest.approx({(i, j): one(distance.pair_matrix(codes[i], codes[j], 4)) for i, j in got}, nan_ok=True) and len(got) == 71 * 70 // 2
    nan = distance.matrix_distance(df, "logdet")
    want = {(r["i"], r["j"]): r["d"] for r in distance.convert_nan(nan).collect()}
    assert {(r["i"], r["j"]): r["d"] for r in distance.defined_matrix_distance(df, "logdet").collect()} == pytest.approx(want)
    amino = spark.createDataFrame([(i, [1 << rng.randrange(20 if i % 2 else 2) for _ in range(40)]) for i in range(30)], "tid int, v array<int>")
    want = {(r["i"], r["j"]): r["d"] for r in distance.kimura_protein(distance.pairs(amino, 20)).collect()}
    assert {(r["i"], r["j"]): r["d"] for r in distance.matrix_distance(amino, "kimura_protein", 20).collect()} == pytest.approx(want)


def test_sequences_sent_to_blocks_grow_as_the_table(spark, monkeypatch):
    """Twice the sequences are sent twice as often in all, and pairs go out in the order of their taxa."""
    monkeypatch.setattr(distance, "BLOCK", 4)
    monkeypatch.setattr(distance, "TILES", 1, raising=False)
    sent = []
    frame = type(spark.range(1))
    for name in ("repartitionById", "repartition"):
        monkeypatch.setattr(frame, name, lambda df, *a, plain=getattr(frame, name): sent.append(df.count()) or plain(df, *a))
    for n in (160, 320):
        out = distance.matrix_distance(spark.range(n).select(F.col("id").alias("tid"), F.array(F.lit(1), F.pow(F.lit(2), F.col("id") % 4).cast("int")).alias("v")), "p", places=9)
        got = out.agg(F.count("*"), F.count_if(F.expr("i < j")), F.countDistinct("i", "j"), F.sum("d")).first()
        assert got[:3] == (n * (n - 1) // 2,) * 3 and got[3] == 6 * (n // 4) ** 2 / 2
    half = len(sent) // 2
    assert sent and sum(sent[half:]) <= 2.5 * sum(sent[:half])


def test_tiles_stay_small_in_large_blocks(spark):
    """9,000 rows in blocks of about 281, whose tiles are 256 at most."""
    df = spark.range(9000).select(F.col("id").alias("tid"), F.array(F.lit(1), F.lit(2)).alias("v"))
    out = distance.block_pairs(df, lambda x, y: [np.ones((len(x), len(y)))], "n double, most double", whole=lambda v: [np.array([float(len(v[0]))]), np.array([1.0])])
    got = out.agg(F.sum("n"), F.max("n")).first()
    assert got[0] == 9000 * 8999 // 2 and got[1] <= 256 * 256


def test_distinct_values_are_sorted(spark, monkeypatch):
    """100,000 samples of ten values: ten rows a key are ranked, with the statistics of all."""
    sizes = []
    plain = posterior.ranked
    monkeypatch.setattr(posterior, "ranked", lambda df, *a, **k: sizes.append(df.count()) or plain(df, *a, **k))
    df = spark.range(100000).select((F.col("id") % 3).alias("key"), (F.floor(F.sqrt("id")) % 10).cast("double").alias("x")).union(spark.createDataFrame([(None, float(k)) for k in range(7)] + [(1, None)], "key long, x double"))
    got = {r["key"]: r for r in posterior.summary(df, ["key"], "x").collect()}
    assert sum(sizes) <= 37 and set(got) == {0, 1, 2, None}
    rows = df.where("x is not null").toPandas()
    for key, r in got.items():
        x = np.sort(rows.x[rows.key.isna() if key is None else rows.key == key].to_numpy())
        low = int(len(x) * 0.025)
        assert (r["n"], r["min_cred"], r["max_cred"], r["med"]) == (len(x), x[low], x[len(x) - 1 - low], np.median(x))
        assert r["mean"] == pytest.approx(x.mean()) and r["var"] == pytest.approx(x.var())


def test_least_flag_of_a_line(spark, tmp_path):
    """Of rows with one order and line the least flag counts; one that has no classes of its own, or none, has those of the last."""
    flags = [(1, ["R", "A"]), (2, ["N"]), (3, ["B", "R"]), (4, [None, "N"]), (5, [None]), (6, ["Z"]), (7, ["A", "0"])]
    lines = [(1, k, 1, 1, 1.0, 0.0, 0.0, f, 1.0) for k, own in flags for f in own]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["model"]: r["rclass"] for r in inputs.order_models(spark, str(tmp_path)).collect()}
    assert got == {1: "0 0 0 0 0 0", 2: "0 1 0 0 1 0", 3: "0 1 2 3 4 5", 4: "0 1 0 0 1 0", 5: "0 1 2 3 4 5", 6: "0 1 2 3 4 5", 7: "0 1 2 3 4 5"}
    plan = inputs.order_models(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_a_line_is_matched_once(spark):
    line = "1\t2\t0\t0.50000\t1.0\t( 010010 )[ 1.0 2.0 ] 1.0 inf --- [ 0.2 0.8 ]"
    df = spark.createDataFrame([(line,), ("1\t2\t0\t\x01\t1.0\t( 0,1 )[ ] 1.0 1.0 0.0 [ ]",), ("header",), ("",), (None,)], "value string")
    got = logs.scan_parameters(df)
    assert [tuple(r)[:6] for r in got.collect()] == [(1, 2, 0, 0.5, 1.0, "0 1 0 0 1 0"), (1, 2, 0, None, 1.0, "0 1")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 0


def test_distances_of_trees_with_the_same_splits(spark, monkeypatch):
    """3,000 trees of three classes, one without splits: three classes are compared, and many tasks make the result."""
    seen = []
    plain = splits._between_classes
    monkeypatch.setattr(splits, "_between_classes", lambda classes, asked: seen.append(classes.count()) or plain(classes, asked))
    own = {0: ["0011", "0111"], 1: ["0011", "0001"], 2: [None]}
    rows = [(k, s) for k in range(3000) for s in own[k % 3]]
    df = spark.createDataFrame(rows, "tree_id int, split string")
    monkeypatch.setattr(splits, "ROWS", 1000)
    got = splits.robinson_foulds_all(df, spark.createDataFrame([(0,), (1,), (2,)], "a int"))
    most, n = shares(got)
    assert seen == [3] and n == 3 * 2999 and most < n / 4
    want = {(0, 0): 0.0, (0, 1): 0.5, (0, 2): 0.5, (1, 1): 0.0, (1, 2): 0.5, (2, 2): 0.0}
    assert {(r["a"], r["c"], r["rf"]) for r in got.withColumn("c", F.col("b") % 3).select("a", "c", "rf").distinct().collect()} == {(a, c, want[tuple(sorted((a, c)))]) for a in range(3) for c in range(3)}


def test_trees_are_read_node_by_node():
    """A star of 200,000 leaves: reading it holds the open nodes only, writing it less than 150 bytes a node."""
    text = "(" + ",".join(f"t{k}:{k}" for k in range(200000)) + ")r;"
    tracemalloc.start()
    n = sum(1 for _ in newick.walk(text))
    read = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200001 and read < 100000
    cells = {"node": np.arange(n), "parent": np.where(np.arange(n) > 0, 0, -1), "place": np.arange(n) - 1, "length": np.arange(n) - 1.0}
    names = ["r", *(f"t{k}" for k in range(n - 1))]
    tracemalloc.start()
    again = newick.render_columns(taxon=names, lengths=True, fmt="%g", **cells)
    wrote = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert again.count(",") == n - 2 and again.startswith("(t0:0,t1:1,") and again.endswith("t199999:199999)r;") and wrote < 150 * n
