"""Phrase collocations from generalised suffix automata of bounded depth, one for each shard of texts.

A shard is some megabytes of texts of one task. The states of its automaton at depth d are
the distinct phrases of d words of a language, found at their end positions; a state comes
from the state of its first d - 1 words by the transition of its last word, its suffix link
leads to the state of its last d - 1 words, and its endpos count is its number of end
positions. So the states of a level are the distinct pairs (origin, link) of the level
before, and one sort of pairs of numbers builds and counts a level.

Levels are grown one pass over the texts each: a phrase can only be frequent if its first
and its last d - 1 words are, so states are only extended where origin and link are among
the phrases that the level before found often enough in all shards. They are looked up in
a bitmap that grows with their number up to 32 MB; a full bitmap lets more states through
and changes no result. Counts of shards are added up by Spark's grouping on the words'
hashes, so a phrase that is everywhere is one row for each shard, not for each place.

Subsumption follows the automaton's edges on the global counts: each frequent phrase tells
the state it comes from and the one it links to how often it occurs, and these go if that
is often enough. Longer phrases need not be asked, as the ones between count as much.

Words are told apart by 64-bit hashes; counts are 64-bit, products decimals of 38 digits.

A null text has no words; a null lang is `und`. Rows that repeat a doc_id count each.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import ranked
from ..session import ship
from .shared import discard, sized, stash
from .substring import _bitmap as bitmap
from .substring import _has as has
from .words import ENDS, Words, mix, parts, signed, slices, words

LONGEST, LEAST, CUT, TOP = 3, 10, 50, 2000
#: Bytes of a shard: an automaton takes some 30 times as many.
SHARD = 2 << 20
_KEY = np.uint64(0x9E3779B97F4A7C15)


def _state_key(code: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """One hash of a language and the words of each state (states x words)."""
    h = lang.copy()
    for k in range(code.shape[1]):
        h = mix(h * _KEY + code[:, k])
    return h


class Automaton:
    """The levels of a shard's suffix automaton: level[i] is the state whose phrase ends at word i, or -1."""

    def __init__(self, w: Words, lang: np.ndarray, fresh: int = 0):
        """lang: a hash of the language of each row; only end positions from byte fresh on count."""
        self.w, self.depth = w, 1
        ends = np.concatenate(([0], np.cumsum(ENDS[w.data], dtype=np.int32)))[w.starts]
        row = w.row()
        #: Words before each one in its piece.
        same = np.zeros(len(ends), bool)
        same[1:] = (ends[1:] == ends[:-1]) & (row[1:] == row[:-1])
        self.same, self.counted = same, w.starts >= fresh
        self.lang = lang[row]
        key = mix(w.code + self.lang)
        _, self.first, level = np.unique(key, return_index=True, return_inverse=True)
        self.level = level.astype(np.int64)

    def counts(self) -> np.ndarray:
        """Endpos counts of the states of this level."""
        return np.bincount(self.level[self.counted & (self.level >= 0)], minlength=len(self.first))

    def code(self) -> np.ndarray:
        """Hashes of the words of each state."""
        return self.w.code[self.first[:, None] + np.arange(1 - self.depth, 1)]

    def keys(self) -> np.ndarray:
        return _state_key(self.code(), self.lang[self.first])

    def grow(self, live: np.ndarray) -> None:
        """The next level, from those states that are live."""
        ok = np.append(live, False)[self.level]  # level -1: the last, no state
        at = np.flatnonzero(ok[1:] & ok[:-1] & self.same[1:]) + 1
        pair = self.level[at - 1] * len(self.first) + self.level[at]
        _, first, level = np.unique(pair, return_index=True, return_inverse=True)
        self.first, self.depth = at[first], self.depth + 1
        self.level = np.full(len(self.level), -1)
        self.level[at] = level


def _strings(w: Words, at: np.ndarray) -> pa.Array:
    """The words at some places, lower-cased as their hashes are."""
    size = (w.ends - w.starts)[at].astype(np.int64)
    off = np.concatenate(([0], np.cumsum(size)))
    spot = np.repeat(w.starts[at] - off[:-1], size) + np.arange(off[-1])
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(w.data[spot]))


def _names(depth: int) -> list[str]:
    return [f"w{k}" for k in range(depth)]


def _level(depth: int, live: list, shard: int):
    """Rows of the states at a depth: language, hashes of words, endpos count in the shard, and the word itself at depth 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in slices(batch.column("text"), shard):
                langs = batch.column("lang").slice(whole.lo, whole.hi - whole.lo).cast(pa.string()).fill_null("und").dictionary_encode()
                for s, fresh in parts(whole, "phrase", True, shard, depth - 1):
                    w = words(s, "phrase", True)
                    if not len(w.code):
                        continue
                    names = np.array([hash_of(x) for x in langs.dictionary.to_pylist()], np.uint64)
                    a = Automaton(w, names[langs.indices.to_numpy(zero_copy_only=False)], fresh)
                    for bits in live:
                        a.grow(has(bits.value, a.keys()))
                    n = a.counts()
                    keep = np.flatnonzero(n)
                    code, first = signed(np.ascontiguousarray(a.code()[keep])), a.first[keep]
                    cols = [langs.dictionary.take(langs.indices.take(pa.array(w.row()[first]))), *(pa.array(code[:, k]) for k in range(depth)), pa.array(n[keep])]
                    extra = [_strings(w, first)] if depth == 1 else []
                    yield pa.RecordBatch.from_arrays([*cols, *extra], names=["lang", *_names(depth), "n", *["word"][: len(extra)]])

    return run


def hash_of(name: str) -> int:
    raw = np.frombuffer(name.encode(), np.uint8).astype(np.uint64)
    h = np.full(1, len(raw) + 1, np.uint64)
    for x in raw:
        h = mix(h * _KEY + x)
    return int(h[0])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of frequent phrases, as Automaton.keys() makes them."""
    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        names = np.array([hash_of(x) for x in lang.dictionary.to_pylist()], np.uint64)
        cols = [c for c in batch.schema.names if c != "lang"]
        code = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in cols], 1) if len(batch) else np.zeros((0, len(cols)), np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(signed(_state_key(code, names[lang.indices.to_numpy()])) if len(batch) else np.zeros(0, np.int64))], names=["h"])


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shard: int = SHARD) -> tuple[list[DataFrame], DataFrame]:
    """For each length from 1 to longest, (lang, w0.., n) of the phrases found least times or more, with the word itself at length 1; and (lang, n) of all words."""
    spark = ship(docs.sparkSession)
    text, levels, live = docs.select("lang", "text").where("text is not null"), [], []
    for depth in range(1, longest + 1):
        keys = ["lang", *_names(depth)]
        schema = "lang string, " + ", ".join(f"{c} long" for c in _names(depth)) + ", n long" + ", word string" * (depth == 1)
        found = text.mapInArrow(_level(depth, live, shard), schema)
        sums = [F.sum("n").alias("n"), *[F.min("word").alias("word")] * (depth == 1)]
        if depth == 1:
            every = stash(found.groupBy(*keys).agg(*sums), "words")
            total = stash(every.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
            levels.append(stash(every.where(F.col("n") >= least), "level"))
            discard(every)
        else:
            levels.append(stash(found.groupBy(*keys).agg(*sums).where(F.col("n") >= least), "level"))
        if depth < longest:
            hashes = levels[-1].select(*keys).mapInArrow(_keyed, "h long")
            live.append(spark.sparkContext.broadcast(bitmap(hashes, levels[-1].count(), "bits")))
    for bits in live:
        bits.unpersist()
    return levels, total


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)): at most a million, as neither part is rarer than the whole."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (big(a) * big(a)).cast("decimal(32,0)") * F.lit(1000000).cast("decimal(7,0)"), (big(l) * big(r)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, cut: int = CUT, top: int | None = TOP, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of 2 to longest words; all with top None.

    a: occurrences; l, r: those of the two parts at the lowest-scoring cut; n: words of the
    language. Phrases inside a longer one with cut percent of their occurrences are left out.
    """
    levels, total = frequent(docs, longest, least, shard)
    text = levels[0].select("lang", "w0", "word")
    out = None
    for d in range(2, longest + 1):
        own = levels[d - 1].withColumnRenamed("n", "a")
        if d < longest:  # what a longer phrase comes from, and what it links to
            wider = levels[d]
            ends = [F.struct(*[F.col(f"w{k + s}").alias(f"w{k}") for k in range(d)]) for s in (0, 1)]
            inside = wider.select("lang", "n", F.explode(F.array(*ends)).alias("e")).select("lang", "e.*", "n").groupBy("lang", *_names(d)).agg(F.max("n").alias("most"))
            own = own.join(inside, ["lang", *_names(d)], "left").where(F.coalesce(100 * F.col("most") < cut * F.col("a"), F.lit(True))).drop("most")
        cuts = []
        for k in range(1, d):
            own = own.join(levels[k - 1].select("lang", *_names(k), F.col("n").alias(f"l{k}")), ["lang", *_names(k)])
            rest = levels[d - k - 1].select("lang", *[F.col(f"w{i}").alias(f"w{i + k}") for i in range(d - k)], F.col("n").alias(f"r{k}"))
            own = own.join(rest, ["lang", *[f"w{i + k}" for i in range(d - k)]])
            cuts.append(F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        for k in range(d):
            own = own.join(text.select("lang", F.col("w0").alias(f"w{k}"), F.col("word").alias(f"t{k}")), ["lang", f"w{k}"])
        own = own.select("lang", F.concat_ws(" ", *[f"t{k}" for k in range(d)]).alias("phrase"), "a", (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("c"))
        out = own if out is None else out.union(own)
    out = ranked(out.select("lang", "phrase", "a", "c.l", "c.r", "c.score"), ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], "rank")
    out = out.withColumn("rank", F.col("rank") + 1)
    return (out if top is None else out.where(F.col("rank") <= top)).join(sized(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
