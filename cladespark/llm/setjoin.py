"""N-gram Jaccard join with set-relation skipping; connected classes of near copies.

A document's set is its distinct word shingles. Copies of one set are one class from the
start, and stand for their documents from then on. Sets are indexed under the tokens of
their prefix, rarest first by a count sketch over all documents (any total order is exact;
rarity only keeps the lists short).

* Index-level skipping: a list is walked in blocks in order of set size and of the token's
  position; two blocks whose sizes, or whose least positions, can't reach the threshold
  are skipped whole.
* Answer-level skipping: each set is first compared with its lists' first sets, then with
  its neighbours by size. The symmetric difference to such a leader is known from then on,
  and a set's answers follow from its leader's: two sets of one leader whose differences
  to it add up to few enough tokens are linked, and two whose differences are too far apart
  aren't, both without looking at the sets. Sets that these links join share their classes,
  and only pairs of different classes are still generated, so a group of n near copies
  costs about n comparisons, not n squared.

No list is gathered in one task: leaders come from aggregates, neighbours from ranges over
all lists, and what is left of a list is dealt by size class and, where it is long, into
sub-blocks of about BLOCK_ROWS rows. A task compares one sub-block with itself or with one
other, so it holds two of them at most, whatever classes the list is made of; sub-blocks of
the list's largest class don't meet each other.

Pairs are pruned by an exact upper bound from bucketed counts, and then verified on the
whole sets. The result is exact for links between different texts' classes.

Null or empty text: an empty set, linked with nothing, its own class. A doc_id may be of
any type that has an order. Rows that repeat a doc_id are judged by their own texts; a null
doc_id is kept, with a null class. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .shared import ROW, components, discard, row_key, stash, with_ids, without_ids
from .words import mix, signed, slices, words

#: Buckets of the sketch that orders tokens (a fixed 4 MB for each task, 8 MB broadcast), and of a set's signature.
SKETCH, BUCKETS = 1 << 20, 128
_PART = 1 << 12
#: Sketches that are added at a time; rows of a sub-block of a list.
FAN, BLOCK_ROWS = 32, 8192
#: What tells text classes apart.
KEY = ("n", "sid", "sid2")


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; with fewer than k words, the whole sequence is one shingle."""
    for s in slices(column):
        w = words(s, "white", lower=True)
        g, ok = w.grams(k)
        whole = w.sequence()
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            if b - a >= k:
                x = np.sort(g[a : b - k + 1])
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            else:
                x = whole[i : i + 1] if b > a else g[:0]
            yield s.lo + i, x


def overlap_needed(n: int, m, percent: int):
    """Least intersection of sets of n and m for 100 * intersection >= percent * union, in whole numbers."""
    return -(-percent * (n + m) // (100 + percent))


def _digests(x: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    a = np.bitwise_xor.reduce(x * np.uint64(0x9E3779B97F4A7C15)) ^ np.add.reduce(x)
    b = np.add.reduce(mix(x ^ np.uint64(0x5851F42D4C957F2D)))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros(SKETCH, np.int32), None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            n, sid, sid2 = (np.zeros(len(batch), np.int64) for _ in range(3))
            for i, x in shingle_sets(batch.column("text"), k):
                n[i] = len(x)
                if len(x):
                    sid[i], sid2[i] = _digests(x)
                    np.add.at(total, (x >> np.uint64(44)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(sid), pa.array(sid2), pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.binary())], names=["doc_id", "n", "sid", "sid2", "part", "counts"])
        if kind is None:
            return
        rows = [(p, total[p * _PART : (p + 1) * _PART]) for p in range(SKETCH // _PART)]
        rows = [(p, x.tobytes()) for p, x in rows if x.any()]
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), kind), none, none, none, pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["doc_id", "n", "sid", "sid2", "part", "counts"])

    return run


def _add(key, table):
    total = np.zeros(_PART, np.int64)
    for x in table.column("counts"):
        raw = x.as_py()
        total += np.frombuffer(raw, np.int32 if len(raw) == 4 * _PART else np.int64)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "g": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def _sketch(rows: DataFrame) -> np.ndarray:
    """The summed sketch: a tree of sums, so that no group ever holds more than about FAN rows."""
    rows = stash(rows.withColumn("g", F.spark_partition_id().cast("long")), "sketch")
    most = rows.agg(F.max("g")).first()[0] or 0
    cur = rows
    while most:
        most //= FAN
        cur = cur.withColumn("g", F.expr(f"g div {FAN}")).groupBy("part", "g").applyInArrow(_add, "part int, g long, counts binary")
    full = np.zeros(SKETCH, np.int64)
    for r in cur.select("part", "counts").toLocalIterator():
        x = np.frombuffer(r["counts"], np.int32 if len(r["counts"]) == 4 * _PART else np.int64)
        full[r["part"] * _PART : (r["part"] + 1) * _PART] += x
    discard(rows)
    return np.minimum(full, 2**31 - 1).astype(np.int32)


def _prefixes(k: int, percent: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = sketch.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for _, x in shingle_sets(batch.column("text"), k):
                if not len(x):
                    continue
                n, seen = len(x), df[(x >> np.uint64(44)).astype(np.int64)]
                keep = n - int(-(-percent * n // 100)) + 1  # whatever reaches the threshold shares one of these tokens
                order = np.lexsort((x, seen))[:keep]
                out[0].append(n)
                for col, v in zip(out[1:3], _digests(x), strict=True):
                    col.append(v)
                out[3].append(np.bincount((x & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).clip(max=65535).astype(np.uint16).tobytes())
                out[4].append(signed(x[order]))
            lens = np.cumsum([0] + [len(x) for x in out[4]], dtype=np.int32)
            toks = pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate(out[4]) if out[4] else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary()), toks], names=["n", "sid", "sid2", "sig", "tokens"])

    return run


def _bounded(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether signatures allow the needed overlap: the sum of the smaller counts bounds the intersection (a full count bounds nothing)."""
    return (np.minimum(x, y).sum(1, dtype=np.int64) >= overlap_needed(n, m, percent)) | (np.minimum(n, m) > 65535)


def apart(n, m, percent: int):
    """Greatest symmetric difference of linked sets of n and m."""
    return n + m - 2 * overlap_needed(n, m, percent)


def _nearest(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the pairs that are the best of one of their two sets."""
    who, at = np.concatenate((i, j)), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((-score[at], who))
    who, at = who[order], at[order]
    return np.unique(at[np.concatenate(([True], who[1:] != who[:-1]))]) if len(who) else at


def _cross(percent: int, nearest: bool):
    """Pairs (a, b, sure) of different classes in each block of a list; sure ones are linked by their differences to one leader.

    Rows come together by list and block, in order of size and position. A block below zero
    is one sub-block with itself, another one two different sub-blocks. nearest: of each set only the pair with the greatest bound on the overlap, and of each two classes one
    sure pair; otherwise all.
    """

    def pairs(rows: list[np.ndarray]) -> list[np.ndarray]:
        ident, n, pos, comp, home, sub, lead, diff, blk, sig = rows
        sig = np.frombuffer(b"".join(sig.tolist()), np.uint16).reshape(-1, BUCKETS)
        room = n - pos  # tokens from this one on, itself included
        found: list = [[], [], [], []]
        for lo in range(0, len(n), 512):  # a block of probes against the blocks that follow it
            hi = min(lo + 512, len(n))
            last = int(np.searchsorted(n, n[hi - 1] * 100 // percent, "right"))
            for at in range(lo, last, 512):
                to = min(at + 512, last)
                if n[at] * percent > 100 * n[hi - 1]:
                    break
                if min(room[lo:hi].max(), room[at:to].max()) < overlap_needed(int(n[lo]), int(n[at]), percent):
                    continue  # no two positions of these blocks leave enough tokens
                i, j = np.arange(lo, hi)[:, None], np.arange(at, to)[None, :]
                ok = (j > i) & (comp[i] != comp[j]) & (100 * n[i] >= percent * n[j]) & home[j] & ((sub[i] != sub[j]) | (blk[i] < 0))
                ok &= np.minimum(room[i], room[j]) >= overlap_needed(n[i], n[j], percent)
                x, y = np.nonzero(ok)
                for k in range(0, len(x), 1 << 15):
                    i, j = x[k : k + (1 << 15)] + lo, y[k : k + (1 << 15)] + at
                    limit, same = apart(n[i], n[j], percent), (lead[i] == lead[j]) & (lead[i] >= 0)
                    sure = same & (diff[i] + diff[j] <= limit)
                    fits = ~same | (np.abs(diff[i] - diff[j]) <= limit)
                    shared = np.minimum(sig[i], sig[j]).sum(1, dtype=np.int64)
                    fits &= sure | (shared >= overlap_needed(n[i], n[j], percent)) | (np.minimum(n[i], n[j]) > 65535)
                    for col, v in zip(found, (i, j, sure, shared / (n[i] + n[j])), strict=True):
                        col.append(v[fits])
                if nearest and sum(map(len, found[0])) > 1 << 18:
                    found = [[v] for v in best(found, comp)]
        if not found[0]:
            return [ident[:0], ident[:0], np.zeros(0, bool)]
        i, j, sure, _ = best(found, comp) if nearest else [np.concatenate(x) for x in found]
        return [ident[i], ident[j], sure]

    def best(found: list, comp: np.ndarray) -> list[np.ndarray]:
        i, j, sure, score = (np.concatenate(x) for x in found)
        low, high = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
        at = np.flatnonzero(sure)
        one = at[np.unique(np.stack((low[at], high[at])), axis=1, return_index=True)[1]] if len(at) else at
        rest = np.flatnonzero(~sure)
        keep = np.concatenate((one, rest[_nearest(i[rest], j[rest], score[rest])]))
        return [i[keep], j[keep], sure[keep], score[keep]]

    names = ("tok", "size", "id", "n", "pos", "comp", "home", "sub", "lead", "diff", "blk", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        new = lambda c: np.concatenate(([True], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[10][1:] != c[10][:-1])))

        def out(cols):
            found = []
            cuts = np.append(np.flatnonzero(new(cols)), len(cols[0]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo > 1 and (cols[5][lo:hi] != cols[5][lo]).any():
                    found.append(pairs([c[lo:hi] for c in cols[2:]]))
            if found:
                a, b, sure = (np.concatenate([x[i] for x in found]) for i in range(3))
                xy = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), sure.astype(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1]), pa.array(xy[:, 2] == 1)], names=["a", "b", "sure"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            cut = int(np.flatnonzero(new(cols))[-1])
            if cut:
                yield from out([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None and len(held[0]):
            yield from out(held)

    return run


def _neighbours(percent: int):
    """Pairs of sets next to each other in a list, of different classes; rows come in order of list, size and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tok", "id", "n", "comp")]
            if before is not None:
                cols = [np.concatenate((x, y)) for x, y in zip(before, cols, strict=True)]
            before = [c[-1:] for c in cols]
            tok, ident, n, comp = cols
            ok = (tok[1:] == tok[:-1]) & (comp[1:] != comp[:-1]) & (100 * n[:-1] >= percent * n[1:])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ident[:-1], ident[1:])[ok]), pa.array(np.maximum(ident[:-1], ident[1:])[ok])], names=["a", "b"])

    return run


def _fits(percent: int):
    """Pairs whose signatures allow the needed overlap: the sum of the smaller counts bounds the intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array(_bounded(x, y, n, m, percent)))

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [x for _, x in shingle_sets(batch.column("text"), k) if len(x)]
            for lo in range(0, len(got), 500):
                part = got[lo : lo + 500]
                sid = [_digests(x) for x in part]
                yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in part], pa.int64()), pa.array([x for x, _ in sid], pa.int64()), pa.array([x for _, x in sid], pa.int64()), pa.array([x.tobytes() for x in part], pa.binary())], names=["n", "sid", "sid2", "set"])

    return run


def _linked(percent: int):
    """Each pair with its symmetric difference and whether it reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            diff, ok = [], []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                diff.append(len(both) - 2 * same)
                ok.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(diff, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "diff", "ok"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (tok, size, id, comp, home) of lists with several classes, each with its sub-block `sub` and the blocks `cells` in which it meets others.

    A list of BLOCK_ROWS rows is one sub-block. In a longer one the rows of the largest class
    and all others are dealt apart: sub-blocks of the others meet all sub-blocks, those of the
    largest class only the others. Block -1 - p is sub-block p with itself.
    """
    each = rows.groupBy("tok", "size", "comp").agg(F.count("*").alias("m"), F.max("home").alias("home"))
    whole = each.groupBy("tok", "size").agg(F.max(F.struct("m", "comp")).alias("most"), F.sum("m").alias("m"), F.count("*").alias("comps"), F.max("home").alias("home")).where("comps > 1 and home")
    short = F.col("m") <= BLOCK_ROWS
    minors = F.when(short, 1).otherwise(F.ceil((F.col("m") - F.col("most.m")) / BLOCK_ROWS).cast("int"))
    majors = F.when(short, 0).otherwise(F.ceil(F.col("most.m") / BLOCK_ROWS).cast("int"))
    whole = whole.select("tok", "size", F.col("most.comp").alias("most"), minors.alias("minors"), majors.alias("majors"))
    rows = rows.join(whole, ["tok", "size"]).withColumn("minor", (F.col("comp") != F.col("most")) | (F.col("majors") == 0))
    sub = F.when(F.col("minor"), F.pmod(F.hash("id"), "minors")).otherwise(F.col("minors") + F.pmod(F.hash("id"), F.greatest("majors", F.lit(1))))
    every = F.col("minors") + F.col("majors")
    cell = lambda t: F.when(t == F.col("sub"), -1 - t.cast("long")).otherwise(F.least(t, "sub").cast("long") * every + F.greatest(t, "sub"))
    met = F.sequence(F.lit(0), F.when(F.col("minor"), every).otherwise(F.col("minors")) - 1)
    return rows.withColumn("sub", sub).withColumn("cells", F.transform(met, cell)).drop("most", "minors", "majors", "minor")


class _Join:
    """Text classes of docs, (id, rep, n, sid, sid2), and their index."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        ship(docs.sparkSession)
        self.docs, self.k, self.percent = docs.select("doc_id", "text"), k, percent
        kind = docs.schema["doc_id"].dataType.simpleString()
        self.every = stash(self.docs.mapInArrow(_count(k), f"doc_id {kind}, n long, sid long, sid2 long, part int, counts binary"), "sets")
        self.info = self.every.where("part is null").select("doc_id", *KEY)
        sketch = docs.sparkSession.sparkContext.broadcast(_sketch(self.every.where("part is not null").select("part", "counts")))
        full = self.info.where("n > 0 and doc_id is not null")
        self.classes = stash(full.groupBy(*KEY).agg(F.min("doc_id").alias("rep")).withColumn("id", F.monotonically_increasing_id()), "reps")
        copies = full.join(self.classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti").select("doc_id")
        source = without_ids(self.docs.where("doc_id is not null and text is not null"), copies)
        rows = source.mapInArrow(_prefixes(k, percent, sketch), "n long, sid long, sid2 long, sig binary, tokens array<long>").dropDuplicates(list(KEY))
        self.index = stash(rows.join(self.classes, list(KEY)).select("id", "n", "sig", "tokens"), "index")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose signatures fit, each with diff and ok."""
        side = lambda p: self.index.select(F.col("id").alias(p), F.col("n").alias(f"n{p}"), F.col("sig").alias(f"s{p}"))
        close = stash(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_fits(self.percent), "a long, b long"), "pairs")
        ids = close.select(F.col("a").alias("id")).union(close.select(F.col("b").alias("id")))
        wanted = stash(with_ids(self.classes, ids, "id"), "wanted")
        texts = with_ids(self.docs.where("doc_id is not null and text is not null"), wanted.select(F.col("rep").alias("doc_id")))
        sets = texts.mapInArrow(_sets(self.k), "n long, sid long, sid2 long, set binary").dropDuplicates(list(KEY))
        sets = stash(sets.join(wanted, list(KEY)).select("id", "set"), "sets")
        both = close.join(sets.select(F.col("id").alias("a"), F.col("set").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("xb")), "b")
        out = stash(both.mapInArrow(_linked(self.percent), "a long, b long, diff long, ok boolean"), "links")
        discard(close, sets, wanted)
        return out

    def links(self) -> DataFrame:
        """Linked pairs (a, b) of class ids that connect every class's component."""
        percent, index = self.percent, self.index
        rows = index.select("id", "n", F.posexplode("tokens").alias("pos", "tok"))
        heads = rows.groupBy("tok").agg(F.min(F.struct("n", "id")).alias("hub"), F.count("*").alias("many")).where("many > 1").select("tok", "hub")
        lists = stash(rows.join(heads, "tok").select("tok", "id", "n", F.col("pos").cast("long").alias("pos"), F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "lists")
        # Answers of each list's first set first: copies of one text have few such leaders between them.
        star = lists.where((F.col("hub") != F.col("id")) & (100 * F.col("hub_n") >= percent * F.col("n"))).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
        star = self.verify(star)
        leads = stash(star.groupBy(F.col("b").alias("id")).agg(F.min(F.struct("diff", F.col("a").alias("lead"))).alias("x")).select("id", "x.lead", "x.diff"), "leads")

        def classed(links: DataFrame) -> tuple[DataFrame, DataFrame]:
            known = stash(components(links), "comp")
            rows = lists.select("tok", "id", "n", "pos").join(known, "id", "left")
            return rows.select("tok", "id", "n", "pos", F.coalesce("component", "id").alias("comp")), known

        seen = lambda *frames: reduce(DataFrame.union, [x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for x in frames])
        ok = star.where("ok").select("a", "b")
        # Then those of the neighbour by size, where it is of another class: over ranges of all lists together.
        rows, first = classed(ok)
        parts = max(1, int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        near = rows.repartitionByRange(parts, "tok", "n", "id").sortWithinPartitions("tok", "n", "id").mapInArrow(_neighbours(percent), "a long, b long").distinct()
        near = self.verify(near.join(seen(star), ["a", "b"], "left_anti"))
        ok = ok.union(near.where("ok").select("a", "b"))
        # What is left: sets of one size class with each other and with those of the class below. First each set's nearest, which joins
        # most classes that belong together; then all pairs of classes that are still different.
        scratch = [lists, leads, first]
        for nearest in (True, False):
            rows, known = classed(ok)
            pairs, left = self._crossed(rows, leads, nearest)
            rest = stash(pairs.join(seen(star, near), ["a", "b"], "left_anti"), "pairs")
            more = self.verify(rest.where("not sure").select("a", "b"))
            ok = stash(ok.union(rest.where("sure").select("a", "b")).union(more.where("ok").select("a", "b")), "links")
            near = near.select("a", "b").union(more.select("a", "b"))
            scratch += [known, left, rest]
        discard(*scratch)
        return ok

    def _crossed(self, rows: DataFrame, leads: DataFrame, nearest: bool) -> tuple[DataFrame, DataFrame]:
        """(a, b, sure) of sets of different classes in one list, and the table of lists that they come from."""
        percent = self.percent
        size = (F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9) if percent < 100 else F.col("n")).cast("long")
        mixed = rows.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("tok")
        left = stash(rows.join(mixed, "tok"), "left")
        rows = left.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"size": size + F.col("up"), "home": F.col("up") == 0})
        # In the class above a set only meets greater ones, and from its place on it must hold what the least of those needs.
        rows = rows.where(F.col("home") | ((F.col("n") - F.col("pos")) * (100 + percent) >= percent * (2 * F.col("n") + 1)))
        rows = _dealt(rows).select("tok", "size", "id", "n", "pos", "comp", "home", "sub", F.explode("cells").alias("blk"))
        rows = rows.join(self.index.select("id", "sig"), "id").join(leads, "id", "left").withColumns({"lead": F.coalesce("lead", F.lit(-1).cast("long")), "diff": F.coalesce("diff", F.lit(0).cast("long"))})
        rows = rows.repartition("tok", "size", "blk").sortWithinPartitions("tok", "size", "blk", "n", "pos", "id")
        return rows.mapInArrow(_cross(percent, nearest), "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure")), left


def _components(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sid, sid2, n, component, least) of each text class: its component and the smallest doc_id there; and each row's doc_id with its class."""
    join = _Join(docs, k, percent)
    final = components(join.links())
    reps = stash(join.classes.join(final, "id", "left").select(*KEY, "rep", F.coalesce("component", "id").alias("component")), "reps")
    least = reps.groupBy("component").agg(F.min("rep").alias("least"))
    return reps.drop("rep").join(least, "component"), join.info


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id of the class) for each row of docs.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of k-word shingles.
    """
    reps, info = _components(docs, k, percent)
    out = info.join(reps, list(KEY), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each class: that with the smallest doc_id (of rows with equal ids and texts, any one).

    Rows that repeat a doc_id with different texts are judged each. Rows with a null doc_id, or without words, all stay.
    """
    keyed = docs.withColumn(ROW, row_key("text"))
    got = jaccard_classes(keyed.select(F.col(ROW).alias("doc_id"), "text"), k, percent).where("doc_id is not null and n_shingles > 0")
    got = stash(got.select("doc_id", F.expr("doc_id <> component_id").alias("gone")), "gone")
    out = without_ids(keyed, got.where("gone").select(F.col("doc_id").alias(ROW)), ROW)
    again = stash(got.where("not gone").groupBy(F.col("doc_id").alias(ROW)).agg(F.count("*").alias("n")).where("n > 1").select(ROW), "gone")
    if not again.isEmpty():
        out = without_ids(out, again, ROW).unionByName(with_ids(out, again, ROW).dropDuplicates([ROW]))
    return out.drop(ROW)
