"""Files cut into records by byte ranges, and lines written in order."""

import pytest

from cladespark.sources import files


def test_fasta_records_across_splits(spark, tmp_path):
    want = [(f"t {i}", "ACGT-N"[i % 6 :] + "A" * (i * 37 % 500 + 1)) for i in range(400)]
    wrap = lambda s: "\n".join(s[k : k + 60] for k in range(0, len(s), 60))
    (tmp_path / "a.fa").write_text("".join(f">{n.replace(' ', '_')} note > here\n{wrap(s)}\n" for n, s in want))
    (tmp_path / "b.fa").write_text(">x\r\nAC GT\r\n\r\n>y\r\nTT\r\n")
    (tmp_path / "c.fa").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = files.read_fasta(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 5
        assert sorted((r["label"], r["seq"]) for r in got.collect()) == sorted([*want, ("x", "ACGT"), ("y", "TT")])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", [">a\n>b\nAC\n", ">a\nAJ\n", "> a\nAC\n", "AC\n"])
def test_bad_fasta_records(spark, tmp_path, text):
    (tmp_path / "a.fa").write_text(text)
    with pytest.raises(Exception, match="not a FASTA record"):
        files.read_fasta(spark, str(tmp_path)).collect()


def test_newick_files(spark, tmp_path):
    (tmp_path / "a.nwk").write_text("(a,b);\n(c,\n d)r; (e);\n\n")
    assert sorted(r["newick"] for r in files.read_newick(spark, str(tmp_path)).collect()) == ["(a,b);", "(c,\n d)r;", "(e);"]


def test_lines_keep_their_order(spark, tmp_path):
    lines = spark.range(1000).selectExpr("id AS line", "concat('v', id) AS value").repartition(7)
    files.write_lines(lines, str(tmp_path / "out"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    assert len(parts) > 1 and "".join(p.read_text() for p in parts) == "".join(f"v{i}\n" for i in range(1000))
    assert files.read_log(spark, str(tmp_path / "out")).count() == 1000
    with pytest.raises(Exception, match="exists"):
        files.write_lines(lines, str(tmp_path / "out"))
