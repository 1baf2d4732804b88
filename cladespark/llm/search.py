"""Ranked lexical search by sort-based accumulation.

Items (queries) and documents are word lists. A first pass over the documents counts, for
each of the items' terms, the documents that hold it, and the number and length of all
documents. In the second pass each task looks up the words of some documents among the
items' terms, concatenates the matched (item, document, impact) arrays, sorts them by a
packed number of item and document with a radix sort of 16-bit digits, and adds up
impacts with reduceat. Of each item it holds the best documents so far in a heap, so a task
hands on no more than k rows of an item. These are range-sorted by (item, score) to give
the ranks, so no item's rows are one task.

Items go to the tasks in blocks of at most about BLOCK (item, term) pairs, dealt by a hash of
item_id; each block is a pass over the documents. One item's distinct terms are one unit.
A long text is read in parts of about a megabyte.

A null text has no term. Rows that repeat an item_id are one item, with all their terms; a
null item_id is one, too. Rows that repeat a doc_id are documents of their own; equal scores
go by doc_id, null last. Items without a match give no rows, as do empty tables. Extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import ranked
from ..session import ship
from .shared import discard, stash
from .words import Slice, parts, signed, slices, words

TOP = 10
#: (item, term) pairs of a block, and impacts that are sorted at a time.
BLOCK, IMPACTS = 1 << 20, 1 << 21


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for whole in slices(batch.column("text")):
            for s, _ in parts(whole, "alnum", True):
                w = words(s, "alnum", True)
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(w.row() + whole.lo)), pa.array(signed(w.code))], names=["item_id", "h"])


def _matches(whole: Slice, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each row, and (row, place in terms, occurrences) of those that are looked for, by row and place."""
    rows = whole.hi - whole.lo
    size, found = np.zeros(rows, np.int64), []
    for s, _ in parts(whole, "alnum", True):
        w = words(s, "alnum", True)
        size += w.counts
        code = signed(w.code)
        at = np.minimum(np.searchsorted(terms, code), max(len(terms) - 1, 0))
        hit = np.flatnonzero(terms[at] == code) if len(terms) else np.zeros(0, np.int64)
        key, n = np.unique(w.row()[hit] * len(terms) + at[hit], return_counts=True)
        found.append((key, n))
    key, n = found[0]
    if len(found) > 1:
        key, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        n = np.bincount(back, np.concatenate([n for _, n in found]), len(key)).astype(np.int64)
    return size, key // max(len(terms), 1), key % max(len(terms), 1), n


def _statistics(terms):
    """One row for each term a task has seen, with its documents; and one of the documents with a term and of all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        df, docs, length = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            for s in slices(batch.column("text")):
                size, _, term, _ = _matches(s, known)
                df += np.bincount(term, minlength=len(known))
                docs += int((size > 0).sum())
                length += int(size.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([None, *known[seen].tolist()], pa.int64()), pa.array([docs, *df[seen].tolist()], pa.int64()), pa.array([length] + [None] * len(seen), pa.int64())], names=["h", "df", "length"])

    return run


def radix_order(key: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers from 0 on, sorted by 16-bit digits from the last one up."""
    order, left, shift = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable"), int(key.max(initial=0)) >> 16, 16
    while left:
        order = order[np.argsort(((key >> shift) & 0xFFFF).astype(np.uint16)[order], kind="stable")]
        left, shift = left >> 16, shift + 16
    return order


class _Worst:
    """Orders heap entries (score, doc_id) so that the one to drop, the lowest score and then the highest id, comes first."""

    __slots__ = ("score", "id")

    def __init__(self, score: int, doc_id):
        self.score, self.id = score, doc_id

    def __lt__(self, other: _Worst) -> bool:
        if self.score != other.score:
            return self.score < other.score
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return self.id > other.id


def _impacts(model: dict, size: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """What each matched term adds to the score, for an item that has it once."""
    n, length = model["docs"], model["length"]
    wide = 75 * int(size.max(initial=0)) * n >= 1 << 63
    m = 25 + (size.astype(object) * (75 * n) // length).astype(np.int64) if wide else 25 + size * (75 * n) // length
    return model["weight"][term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))


def _best(model, k: int, impacts: int):
    """The best documents of each item among a task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        terms, start, item, times = m["terms"], m["start"], m["item"], m["times"]
        heaps: list[list[_Worst]] = [[] for _ in range(len(m["ids"]))]
        floor, kind = np.zeros(len(heaps), np.int64), None
        for batch in batches:
            kind = batch.column("doc_id").type
            for s in slices(batch.column("text")):
                size, row, term, tf = _matches(s, terms)
                if not len(row):
                    continue
                impact, each = _impacts(m, size, row, term, tf), (start[1:] - start[:-1])[term]
                upto = np.cumsum(each)
                lo = 0
                while lo < len(row):  # whole documents, of about so many impacts together
                    hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + impacts, "right"))
                    hi = max(int(np.searchsorted(row, row[min(hi, len(row) - 1)], "left")) if hi < len(row) else hi, int(np.searchsorted(row, row[lo], "right")))
                    many = each[lo:hi]
                    first = np.cumsum(many) - many
                    spot = np.repeat(start[term[lo:hi]] - first, many) + np.arange(int(many.sum()))
                    value = np.repeat(impact[lo:hi], many) * times[spot]
                    base, docs = row[lo], int(row[hi - 1] - row[lo] + 1)
                    key = item[spot] * docs + np.repeat(row[lo:hi] - base, many)
                    order = radix_order(key)
                    key, value = key[order], value[order]
                    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    score, key = np.add.reduceat(value, head), key[head]
                    who, doc = key // docs, key % docs + base
                    hold = np.flatnonzero((score > 0) & (score >= floor[who]))
                    # Of a part's documents only the best k of an item, and those equal to the last of them, can stay.
                    hold = hold[np.lexsort((-score[hold], who[hold]))]
                    w, v = who[hold], score[hold]
                    begin = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.zeros(0, np.int64)
                    count = np.diff(np.append(begin, len(w)))
                    last = np.repeat(v[begin + np.minimum(count, k) - 1], count)
                    hold = hold[v >= last]
                    ids = batch.column("doc_id").take(pa.array(doc[hold] + s.lo)).to_pylist()
                    for i, v, x in zip(who[hold].tolist(), score[hold].tolist(), ids, strict=True):
                        heap = heaps[i]
                        if len(heap) < k:
                            heapq.heappush(heap, _Worst(v, x))
                        else:
                            heapq.heappushpop(heap, _Worst(v, x))
                        if len(heap) == k:
                            floor[i] = heap[0].score
                    lo = hi
        got = [(i, x.id, x.score) for i, heap in enumerate(heaps) for x in heap]
        if got:
            yield pa.RecordBatch.from_arrays([m["ids"].take(pa.array([i for i, _, _ in got])), pa.array([x for _, x, _ in got], kind), pa.array([v for _, _, v in got], pa.int64())], names=["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block: int = BLOCK, impacts: int = IMPACTS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, from rank 1."""
    spark = ship(docs.sparkSession)
    key, doc = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    text, share = docs.select("doc_id", "text"), spark.sparkContext.broadcast
    pairs = stash(items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {key}, h long").groupBy("item_id", "h").agg(F.count("*").alias("times")), "items")
    blocks = max(1, -(-pairs.count() // block))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    seen = None
    for b in range(blocks):
        terms = np.sort(pairs.where(F.col("block") == b).select("h").distinct().toArrow()["h"].to_numpy())
        part = text.mapInArrow(_statistics(share(terms)), "h long, df long, length long").withColumn("block", F.lit(b))
        seen = part if seen is None else seen.union(part)
    stats = stash(seen.groupBy("block", "h").agg(F.sum("df").alias("df"), F.sum("length").alias("length")), "stats")
    whole = stats.where("block = 0 and h is null").first()
    n, length = (whole["df"], whole["length"]) if whole else (0, 0)
    out = None
    for b in range(blocks):
        rows = pairs.join(stats, ["block", "h"]).where(F.col("block") == b).select("item_id", "h", "times", "df").toArrow().sort_by("h")
        of = rows["item_id"].combine_chunks().dictionary_encode("encode")
        terms, start = np.unique(rows["h"].to_numpy(), return_index=True)
        df = rows["df"].to_numpy()[start]
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        model = {"terms": terms, "start": np.append(start, len(rows)).astype(np.int64), "item": of.indices.to_numpy().astype(np.int64), "times": rows["times"].to_numpy(), "ids": of.dictionary, "weight": weight, "docs": n, "length": max(length, 1)}
        part = text.mapInArrow(_best(share(model), k, impacts), f"item_id {key}, doc_id {doc}, score long")
        out = part if out is None else out.union(part)
    best = stash(out, "best")
    discard(pairs, stats)
    out = ranked(best, ["item_id"], [F.desc("score"), F.asc_nulls_last("doc_id")], "rank").where(F.col("rank") < k)
    return out.select("item_id", (F.col("rank") + 1).cast("int").alias("rank"), "doc_id", "score")
