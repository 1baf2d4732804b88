"""The pipeline's stages, each against brute force over what the stage before kept."""

import brute
import corpus_pipeline

from cladespark.llm.quality import quality_rules
from cladespark.llm.shared import stash

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules(docs).collect()}
    now = {r["doc_id"]: r["text"] for r in docs.collect()}
    schema = docs.schema
    for name, stage in corpus_pipeline.STAGES:
        before = now
        docs = stash(stage(spark, docs, DATA), name)
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in docs.collect()} == before.keys()
            continue
        assert docs.schema.simpleString() == schema.simpleString()
        got = docs.collect()
        now = {r["doc_id"]: r["text"] for r in got}
        assert len(now) == len(got)
        if name == "quality_rules":
            want = {i: t for i, t in before.items() if verdict[i]}
            assert all(not brute.base_statistics(t)[5] for t in now.values())
        elif name == "jaccard_join":
            of = brute.classes(list(before.items()), 5, 80)
            want = {i: t for i, t in before.items() if of[i][1] == i}
        elif name == "substring_dedup":
            left = brute.kept_words(list(before.items()))
            want = {i: (before[i] if n == len(k) else " ".join(k)) for i, (n, k) in left.items() if k or not n}
            assert all(r["n_chars"] == len(r["text"] or "") for r in got)
        else:
            want = {i: t for i, t in before.items() if not brute.decontaminate(t, items)[2]}
        assert now == want, name
        assert now


def test_stages_take_odd_rows_and_empty_tables(spark, docs, nothing):
    """Nulls, empty and long texts, repeated rows, ties, columns with names that operators use inside."""
    odd = docs.union(docs.where("doc_id % 5 = 0")).union(docs.where("doc_id % 11 = 0").selectExpr("null as doc_id", *docs.columns[1:]))
    for table in (odd, nothing):
        now = table.drop("n_chars")
        for name, stage in corpus_pipeline.STAGES:
            out = stash(stage(spark, now, DATA), name)
            if name != "best_fit_packing":
                assert out.columns == now.columns and out.count() <= now.count()
                now = out
            else:
                assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in now.collect()}
