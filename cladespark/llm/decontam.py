"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

Only DataFrame functions. An item's windows of WINDOW words (or the whole item, if it is
shorter) are its shingle sequences; for exact containment one necessary token is enough,
so each window is indexed under its rarest word (rarity counted over all documents, for
the benchmark's words). Document words join that prefix index; the word's place in the
window bounds where the window can start and end, and what passes is compared word for word.

Null text has no words. Rows are told apart by their doc_id with a hash of their text, so
rows that repeat a doc_id, and null ids, are judged each by their own text. Items with the
same id count once. Columns besides doc_id and text, or item_id and text, are ignored, and
kept by without_contaminated().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_IDS, ROW, discard, sized, stash, without_ids

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def tokens(text: str):
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), NOT_WORD), "")


def loose_tokens(text: str):
    """Words under full lower-casing, which Spark does faster: equal words stay equal, so joins on them lose nothing and comparisons with tokens() follow."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), NOT_WORD), "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, win (array of words) and width of each window of each item, distinct."""
    items = benchmark.select("item_id", tokens("text").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win")).distinct().withColumn("width", F.size("win"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.struct("doc_id", F.xxhash64("text")))


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The row key, items (sorted distinct ids as text) and n_hit for each document with an occurring window."""
    docs = _keyed(docs.select("doc_id", "text")).select(F.col(ROW).alias("doc_id"), "text")
    words = docs.select("doc_id", F.posexplode(loose_tokens("text")).alias("at", "word"))
    wins = stash(windows(benchmark, size), "wins")
    vocabulary = stash(wins.select(F.explode("win").alias("word")).select(F.lower("word").alias("word")).distinct(), "wins")
    rarity = words.join(sized(vocabulary), "word").groupBy("word").agg(F.count("*").alias("df"))
    # A window with a word that no document has can't occur. Ties in rarity go to the smaller word, then the earlier place.
    placed = wins.select(F.xxhash64("win").alias("wid"), "win", "width").distinct().select("wid", "win", "width", F.posexplode("win").alias("k", "word")).withColumn("word", F.lower("word"))
    ranked = placed.join(rarity, "word", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "k")).alias("r"), F.first("win").alias("win"), F.first("width").alias("width"))
    index = stash(ranked.where("r.df > 0").select(F.col("r.word").alias("word"), F.col("r.k").alias("k"), "wid", "win", "width"), "wins")
    keys = index.select("word").distinct()
    found = stash(words.join(sized(keys), "word", "left_semi"), "cand")
    small = index.select("word", "k", "wid", "width", "win")
    cand = found.join(sized(small, BROADCAST_IDS // 10), "word").select("doc_id", (F.col("at") - F.col("k")).alias("start"), "wid", "win", "width").where("start >= 0")
    per_doc = cand.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "width", "wid", "win")).alias("cand"))
    per_doc = stash(per_doc, "cand")
    # Only texts with a candidate are compared; their words are at hand again, in place.
    ids = per_doc.select("doc_id")
    texts = docs.join(sized(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", tokens("text").alias("w"))
    true = F.filter("cand", lambda c: (c["start"] + c["width"] <= F.size("w")) & (F.slice("w", c["start"] + 1, c["width"]) == c["win"]))
    hits = texts.join(per_doc, "doc_id").withColumn("hits", F.transform(true, lambda c: F.struct(c["start"].alias("start"), c["width"].alias("width"), c["wid"].alias("wid")))).where(F.size("hits") > 0)
    hits = stash(hits.select("doc_id", "hits"), "cand")
    spans = F.sort_array(F.array_distinct(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), (h["start"] + h["width"]).alias("end")))))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(s["end"], a["to"]).alias("to"))
    n_hit = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda a: a["n"])
    union = hits.groupBy("doc_id").agg(F.max(n_hit).alias("n_hit"))
    owners = wins.select(F.xxhash64("win").alias("wid"), F.col("item_id").cast("string").alias("item")).distinct()
    items = hits.select("doc_id", F.explode(F.array_distinct(F.transform("hits", lambda h: h["wid"]))).alias("wid")).join(sized(owners), "wid")
    items = items.groupBy("doc_id").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = stash(union.join(items, "doc_id").withColumnRenamed("doc_id", ROW), "hits")
    discard(wins, vocabulary, index, found, per_doc, hits)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated for each row of docs."""
    found = sized(matches(docs, benchmark, size), BROADCAST_IDS // 4)
    n_words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    out = _keyed(docs.select("doc_id", "text")).select("doc_id", ROW, n_words.alias("n_words")).join(found, ROW, "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs without the rows that hold a window of an item."""
    return without_ids(_keyed(docs), matches(docs, benchmark, size).select(ROW), ROW).drop(ROW)
