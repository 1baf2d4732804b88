"""Edits and layouts of alignments, taxa by number, whole log lines, rendered text and number columns."""

import math

import pytest
from pyspark.sql import functions as F

from cladespark.functions import numeric
from cladespark.functions.alphabet import DNA
from cladespark.operators import alignment, edits, posterior, taxa
from cladespark.sources import logs, newick

EDIT = "n long, kind string, row long, col long, chars string"


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame([(0, "AAAAA"), (1, "CCCCC"), (2, "GGGGG")], "tid long, seq string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_later_edits_win(spark, seqs):
    e = spark.createDataFrame([(2, "seq", 1, 1, "TTT"), (1, "char", 0, 2, "NNN"), (3, "char", 1, 4, "-A"), (4, "seq", 0, 0, "")], EDIT)
    assert rows(edits.edited(seqs, e)) == [(0, "AANAA"), (1, "CTTT-"), (2, "GGNGA")]
    assert rows(edits.edited(seqs, e.where("n > 9"))) == rows(seqs)


def test_equal_numbers_take_the_greater_character(spark, seqs):
    e = spark.createDataFrame([(1, "seq", 0, 0, "C"), (1, "seq", 0, 0, "T"), (1, "seq", 0, 0, "G")], EDIT)
    assert rows(edits.edited(seqs, e))[0] == (0, "TAAAA")


@pytest.mark.parametrize("edit", [(1, "seq", 0, 3, "AAA"), (1, "seq", 3, 0, "A"), (1, "char", 2, 0, "AA"), (1, "char", 0, -1, "A"), (1, "row", 0, 0, "A"), (1, "seq", 0, 0, "AJ")])
def test_edits_outside_are_errors(spark, seqs, edit):
    with pytest.raises(Exception, match="edit"):
        edits.edited(seqs, spark.createDataFrame([edit], EDIT), DNA).collect()


def test_layouts(spark, seqs):
    cols = edits.columns(seqs)
    assert rows(cols) == [(i, "ACG") for i in range(5)]
    assert rows(edits.rows(cols)) == rows(seqs)
    assert rows(edits.columns(seqs, [1, 3, 9])) == [(1, "ACG"), (3, "ACG")]
    freq = spark.createDataFrame([(1, 0, 5), (2, 0, 3), (1, 2, 7)], "n long, pos int, freq long")
    assert rows(edits.with_freqs(cols.withColumn("freq", F.lit(1)), freq).select("pos", "freq")) == [(0, 3), (1, 1), (2, 7), (3, 1), (4, 1)]


def test_taxa_both_ways(spark):
    labels = spark.createDataFrame([("b", 1), ("a", 2), (None, 0), ("b", 5), ("Z", 3)], "label string, at int")
    assert rows(taxa.dictionary(labels)) == [(0, "Z"), (1, "a"), (2, "b")]
    first = taxa.checked(taxa.dictionary(labels, order="at"))
    assert rows(first) == [(0, "b"), (1, "a"), (2, "Z")]
    assert rows(taxa.index_of(spark.createDataFrame([("a",), ("q",)], "label string"), first)) == [("a", 1), ("q", -1)]
    assert rows(taxa.label_of(spark.createDataFrame([(0,), (2,)], "tid long"), first)) == [(0, "b"), (2, "Z")]
    assert taxa.label_of(spark.createDataFrame([(7,)], "tid long"), first).first()["label"] is None


@pytest.mark.parametrize("bad", [[(0, "a"), (2, "b")], [(1, "a")], [(0, "a"), (0, "b")], [(0, "a"), (1, "a")], [(0, None)]])
def test_taxa_are_checked(spark, bad):
    with pytest.raises(ValueError):
        taxa.checked(spark.createDataFrame(bad, "tid long, label string"))


def test_trees_by_number(spark):
    known = spark.createDataFrame([(0, "it's"), (1, "b c"), (2, "x")], "tid long, label string")
    trees = spark.createDataFrame([("t", "('it''s':1,(b_c:2,x:0.5):3);"), ("u", "x;")], "tree_id string, newick string")
    got = taxa.numbered(trees, known)
    assert rows(got) == [("t", "(0:1,(1:2,2:0.5):3);"), ("u", "2;")]
    assert rows(taxa.named(got, known)) == rows(trees)
    assert rows(taxa.numbered(trees, known, lengths=False))[0] == ("t", "(0,(1,2));")
    with pytest.raises(Exception, match="unknown taxon"):
        taxa.numbered(trees, known.where("tid > 0")).collect()


def test_texts_are_the_inverse_of_nodes(spark):
    trees = spark.createDataFrame([(i, "(" + ",".join(f"a{k}:{k}" for k in range(2 + i)) + ")r;") for i in range(5)], "tree_id int, newick string")
    assert rows(newick.texts(newick.nodes(trees))) == rows(trees)


def test_diagnostic_lines(spark):
    schema = "step long, lnls array<double>, rcov double, swaps array<double>, accepts array<array<double>>"
    want = [(10, [-1.5, None], None, [0.25, 0.5], [[0.125, 1.0], [None, None]]), (20, [-2.0, -3.0], 0.95, [0.0, 0.0], [])]
    lines = logs.diagnostic_lines(spark.createDataFrame(want, schema))
    text = rows(lines)[0][1]
    assert text == "10\t[ -1.50000000000e+00 --- ] -------- [ 0.250000 0.500000 ] { [ 0.125000 1.000000 ] [ --- --- ] }"
    assert sorted(map(tuple, logs.scan_diagnostics(lines).collect()), key=lambda r: r[0]) == want
    short = spark.createDataFrame([("5\t[ -1 ] 0.5",), (logs.HEADERS["s"],), ("",)], "value string")
    assert list(map(tuple, logs.scan_diagnostics(short).collect())) == [(5, [-1.0], 0.5, [], [])]
    assert rows(logs.scan_samples(lines)) == [(0, 10, -1.5), (0, 20, -2.0), (1, 20, -3.0)]


def test_parameter_lines(spark):
    schema = "run long, step long, model int, weight double, rmult double, rclass string, rates array<double>, w_norm double, alpha double, pinvar double, freqs array<double>"
    many = " ".join(map(str, range(12)))
    models = spark.createDataFrame([(0, 5, 0, 1.0, 1.0, "0 1 0 0 1 0", [1.0, 2.5, 1.0, 1.0, 2.5, 1.0], 1.0, float("inf"), 0.0, [1.0, 1.0, 1.0, 1.0]), (0, 5, 1, 3.0, 0.5, many, [1.0], 2.0, 0.5, 0.25, [0.5])], schema)
    lines = logs.parameter_lines(models)
    text = {r["model"]: r["value"] for r in lines.collect()}
    assert text[0].startswith("0\t5\t0\t0.25000\t1.00000\t( 010010 )[ 1.00000e+00 2.50000e+00 ") and text[0].endswith("] 1.00000e+00 inf 0.00000 [ 2.50000e-01 2.50000e-01 2.50000e-01 2.50000e-01 ]")
    back = {r["model"]: r for r in logs.scan_parameters(lines).collect()}
    assert [back[m]["weight"] for m in (0, 1)] == [0.25, 0.75] and back[0]["rclass"] == "0 1 0 0 1 0" and back[1]["rclass"] == many
    assert math.isinf(back[0]["alpha"]) and list(back[1]["freqs"]) == [1.0]
    whole = rows(logs.numbered(lines, ["run", "step", "model"], "p"))
    assert whole == [(0, logs.HEADERS["p"]), (1, text[0]), (2, text[1])]


def test_setting_lines(spark):
    kept = spark.createDataFrame([("nruns", "2"), ("a.b", "x y")], "key string, value string")
    assert rows(logs.scan_settings(logs.setting_lines(kept))) == rows(kept)


def test_rendered_alignment(spark):
    a = spark.createDataFrame([(0, "ab", "ACGTACG"), (1, "c", "TTTTTTT")], "tid long, label string, seq string")
    freqs = spark.createDataFrame([(i, 12 if i == 1 else i) for i in range(7)], "pos long, freq long")
    text = [r["value"] for r in alignment.render_lines(a, freqs, 3).orderBy("line").collect()]
    assert text == ["   0(12)234", "   =====", "ab ACGTA", "c  TTTTT", "   =====", "   0", "", "   56", "   ==", "ab CG", "c  TT", "   ==", "   5"]
    one = [r["value"] for r in alignment.render_lines(a, freqs, 0).orderBy("line").collect()]
    assert one == ["   0(12)234 56", "   ========", "ab ACGTA CG", "c  TTTTT TT", "   ========", "   0     5"]
    assert [r["value"] for r in alignment.render_lines(a.withColumn("seq", F.lit("")), freqs).orderBy("line").collect()] == ["ab", "c"]


def test_dropped_changes(spark):
    a = spark.createDataFrame([(0, "AAAA-"), (1, "ACAC-"), (2, "CCAG-"), (3, "CAAA-")], "tid long, seq string")
    a = alignment.sites(a, DNA)
    assert rows(alignment.dropped_changes(a)) == [(3, 2, 0)]
    b = alignment.sites(spark.createDataFrame([(0, "AA"), (1, "AC"), (2, "AG")], "tid long, seq string").union(spark.createDataFrame([(3, "CA")], "tid long, seq string")), DNA)
    freqs = spark.createDataFrame([(0, 5), (1, 2)], "pos int, freq long")
    assert rows(alignment.dropped_changes(b, freqs)) == [(1, 1, 5)]
    assert {r["pos"] for r in alignment.keep_informative(b).collect()} == {1}


def test_swap_rates(spark):
    s = spark.createDataFrame([(0, 0, 2), (0, 1, 0), (0, 2, 2), (0, 3, 2)], "run long, step long, n int")
    assert rows(posterior.swap_rates(s, 2)) == [(0, 0, 0.5), (0, 1, 1.0)]
    assert rows(posterior.swap_rates(s, 2, alpha=0.5)) == [(0, 0.5 * 0.5 * 0.5 + 0.5)]


def test_number_columns(spark):
    x = spark.createDataFrame([(0,), (1,), (12,), (1 << 40,), (-2,)], "x long")
    assert [r[0] for r in x.select(numeric.first_bit(F.col("x"))).collect()] == [0, 1, 3, 41, 2]
    g = spark.createDataFrame([(5.0,), (0.0,), (None,)], "x double").select(numeric.ln_gamma(F.col("x")).alias("g")).collect()
    assert g[0][0] == pytest.approx(math.log(24)) and g[1][0] is None and g[2][0] is None
    q = spark.createDataFrame([(0.95, 1.0), (0.5, 2.0), (0.95, 30.0), (1.0, 2.0), (None, 2.0), (0.5, 0.0)], "p double, df double")
    got = [r[0] for r in q.select(numeric.chi2_quantile(F.col("p"), F.col("df"))).collect()]
    assert got[:3] == pytest.approx([3.841458820694124, 2 * math.log(2), 43.77297182574219]) and got[3:] == [None] * 3
    back = spark.createDataFrame([(1.5, 2.0), (0.0, 1.0), (2.0, 0.0)], "a double, x double").select(numeric.gamma_ratio(F.col("a"), F.col("x"))).collect()
    assert back[0][0] == pytest.approx(0.738535870050889) and back[1][0] is None and back[2][0] == 0


def test_codes_of_values(spark):
    s = spark.createDataFrame([("ACGTN-RYu?",), ("",)], "seq string")
    assert [r[0] for r in s.select(DNA.decode(DNA.encode(F.col("seq")))).collect()] == ["ACGTN-RYTN", ""]
