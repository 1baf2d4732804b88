"""Substring dedup by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of BLOCK words; a repeated window
of WINDOW >= 2 * BLOCK - 1 words holds a whole block of one of its places. All rolling
windows of BLOCK words probe the block index, and windows around hits are extended to
maximal exact repeats: every window of WINDOW words that holds a live anchor is compared
with its other places, and windows that repeat an earlier place are merged into spans. Only
the first place of each window travels back: a document's windows near live anchors that are
no first places are those that repeat, so neither the windows nor a join with them is stored.

The index is probed through bitmaps that grow with it up to 32 MB; a full bitmap would only
let more probes through, as what decides is the exact grouping after it. Texts that are whole
copies of an earlier one are settled first, so large groups of copies cost nothing more.

Windows, and whole copies, are compared by two independent hashes, 96 and 128 bits together.
A place is one long, the document's number and the window's first word. Whole doc_ids that
repeat nowhere and span less than 2**33 are their own numbers; other ids are sorted and numbered.

Null or empty text: no words. Texts of fewer than WINDOW words keep all. A doc_id may be of
any type that has an order. Rows that repeat a doc_id with another text are documents of
their own, in the order of a hash of their texts; rows equal in both are one document. A
null doc_id keeps all words and takes none from others. Extra columns are kept by
remove_repeats() and ignored by repeats().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .shared import ROW, discard, row_key, sized, stash, with_ids, without_ids
from .words import Words, signed, slices, words

WINDOW, BLOCK = 20, 10
#: Bits of the bitmaps, as a power of two, at most; each key sets two.
BITS = 28
#: Bits of a place that hold the first word; a text of less than 2**31 bytes has no more words. The document's number has the rest.
START = 30
_DOCS = 1 << (63 - START)
#: Windows that are merged to spans at a time.
_STEP = 1 << 20


#: Salt of the second hash.
_SALT = 0x5851F42D4C957F2D


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in slices(batch.column("text")):
            w = words(s)
            ids = batch.column("doc_id").slice(s.lo, s.hi - s.lo)
            yield pa.RecordBatch.from_arrays([ids, pa.array(w.counts), pa.array(signed(w.sequence())), pa.array(signed(w.sequence(_SALT)))], names=["doc_id", "n", "seq", "seq2"])


def _rolling(w: Words, block: int, window: int, on_block: bool) -> np.ndarray:
    """Hashes of the blocks, or of the rolling windows between them, of texts of window words or more."""
    g, ok = w.grams(block)
    ok &= (w.place()[: len(g)] % block == 0) == on_block
    ok &= np.repeat(w.counts >= window, w.counts)[: len(g)]
    return g[ok]


def _blocks(block: int, window: int):
    """Hashes of the reference blocks, one row each with its count in the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                x, n = np.unique(signed(_rolling(words(s), block, window, True)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n)], names=["h", "n"])

    return run


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    low = np.uint64(8 * len(bits) - 1)
    a, b = h & low, (h >> np.uint64(32)) & low
    got = (bits[(a >> np.uint64(3)).astype(np.int64)] >> (a & np.uint64(7)).astype(np.uint8)) & 1
    at = np.flatnonzero(got)
    b = b[at]
    out = np.zeros(len(h), bool)
    out[at] = (bits[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1
    return out


def _probes(block: int, window: int, index):
    """Hashes of rolling windows, other than the blocks themselves, that the index may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                g = _rolling(words(s), block, window, False)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(signed(g[_has(index.value, g)])))], names=["h"])

    return run


def _live(w: Words, block: int, window: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that hold a live anchor: place among the slice's words, row, first word in the row."""
    g, _ = w.grams(block)
    n = max(0, len(w.code) - window + 1)
    hits = np.zeros(len(g) + 1, np.int32)
    np.cumsum(_has(bits, g), out=hits[1:])
    del g
    ok = w.last()[:n] >= np.arange(window, window + n, dtype=np.int32)
    at = np.flatnonzero(ok & (hits[window - block + 1 : window - block + 1 + n] > hits[:n]))
    row = np.searchsorted(w.first, at, "right") - 1
    return at, row, at - w.first[row]


def _around(block: int, window: int, live):
    """Windows that hold a live anchor: two hashes and the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            for s in slices(batch.column("text")):
                w = words(s)
                at, row, start = _live(w, block, window, live.value)
                if not len(at):
                    continue
                place = (doc[row + s.lo] << START) | start
                full = w.grams(window)[0][at]
                more = (w.grams(window, _SALT)[0][at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(signed(full)), pa.array(more), pa.array(place)], names=["h", "h2", "place"])

    return run


def _runs(block: int, window: int, live):
    """The same windows as runs of first words, lo to hi (not included), one row for each document that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                at, row, start = _live(words(s), block, window, live.value)
                if not len(at):
                    continue
                new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])))
                lo, hi = start[new], start[np.concatenate((new[1:], [True]))] + 1
                rows, many = np.unique(row[new], return_counts=True)
                off = pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (lo, hi)]
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(rows + s.lo)), *lists], names=["doc", "lo", "hi"])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and where each row's begin; null: empty."""
    many = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(many)))


def _spans(window: int):
    """Of each document, the words covered by windows of its runs that are no first places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, off = _flat(batch.column("lo"))
            hi, _ = _flat(batch.column("hi"))
            first, own = _flat(batch.column("firsts"))
            upto = np.concatenate(([0], np.cumsum(hi - lo)))
            at, a = upto[off], 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(at, at[a] + _STEP, "right")) - 1)
                i, j = off[a], off[b]
                row = np.repeat(np.arange(a, b), np.diff(off[a : b + 1]))
                again = np.ones(at[b] - at[a], bool)
                # Rows do not mix: a run is found by its row and its first word.
                of = np.repeat(np.arange(a, b), np.diff(own[a : b + 1]))
                x = first[own[a] : own[b]]
                r = np.searchsorted((row << START) | lo[i:j], (of << START) | x, "right") - 1
                again[upto[i:j][r] - at[a] + x - lo[i:j][r]] = False
                start = np.flatnonzero(again)
                r = np.searchsorted(upto[i:j], start + at[a], "right") - 1
                start, row = start + at[a] - upto[i:j][r] + lo[i:j][r], row[r]
                if len(start):
                    new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + window)))
                    end = start[np.concatenate((new[1:], [True]))] + window
                    rows, many = np.unique(row[new], return_counts=True)
                    edges = pa.StructArray.from_arrays([pa.array(start[new].astype(np.int32)), pa.array(end.astype(np.int32))], names=["start", "end"])
                    yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32)), edges)], names=["doc", "spans"])
                a = b

    return run


def _numbered(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (doc, text) and keys (doc_id, doc): doc is the key's number, in the order of the keys, below _DOCS."""
    key = F.col("doc_id.id")
    if keys.schema["doc_id"].dataType["id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        n, ids, lo, hi = keys.agg(F.count("*"), F.count_distinct(key), F.min(key), F.max(key)).first()
        if n and n == ids and hi - lo < _DOCS:
            doc = (key.cast("long") - F.lit(lo).cast("long")).alias("doc")
            return docs.where(key.between(lo, hi)).select(doc, "text"), keys.select("doc_id", doc)
    low = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the row's number in its partition
    ranked = stash(keys.orderBy("doc_id").select("doc_id", F.spark_partition_id().alias("part"), low.alias("at")), "ranked")
    sizes = ranked.groupBy("part").agg(F.count("*").alias("n"))  # one row for each task
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbers = stash(ranked.join(F.broadcast(before), "part").select("doc_id", (F.col("at") + F.col("before")).alias("doc")), "numbers")
    discard(ranked)
    return docs.join(sized(numbers), "doc_id").select("doc", "text"), numbers


def _bitmap(keys: DataFrame, n: int, name: str) -> np.ndarray:
    """A bitmap with two bits for each of about n keys h, put together in parts of 4 KB by Spark's bitmap aggregate: 16 bits a key, up to 2**BITS."""
    size = 1 << min(BITS, max(16, (16 * n).bit_length()))
    spots = keys.select(F.explode(F.array(F.col("h").bitwiseAND(size - 1), F.shiftrightunsigned("h", 32).bitwiseAND(size - 1))).alias("bit"))
    parts = stash(spots.groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("bits")), name)
    out = np.zeros(size // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    discard(parts)
    return out


def repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Whole copies (row_key of texts of window words or more that an earlier document has), and spans (row_key, spans array<struct<start, end>>) of words covered by windows that start earlier; both by row_key("text") in a column ROW."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    spark = ship(docs.sparkSession)
    docs = docs.where("doc_id is not null and text is not null").select(row_key("text").alias("doc_id"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    info = stash(docs.mapInArrow(_digest, f"doc_id {kind}, n long, seq long, seq2 long").where(f"n >= {window}"), "info")
    keys = stash(info.groupBy("seq", "seq2", "n").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "keys")
    copies = stash(info.join(keys, "doc_id", "left_anti").select("doc_id").distinct(), "copies")
    discard(info)
    single, numbers = _numbered(without_ids(docs, copies), keys)
    blocks = stash(single.mapInArrow(_blocks(block, window), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "blocks")
    index = spark.sparkContext.broadcast(_bitmap(blocks, blocks.count(), "bits"))
    probes = single.mapInArrow(_probes(block, window, index), "h long").distinct()
    anchors = stash(blocks.join(probes.withColumn("probed", F.lit(True)), "h", "left").where("n > 1 or probed").select("h"), "anchors")
    live = spark.sparkContext.broadcast(_bitmap(anchors, anchors.count(), "bits"))
    index.unpersist()  # from here on only the written tables are read
    discard(blocks, anchors)
    # A passage that many texts share is one row of each task after the aggregation's first step.
    firsts = single.mapInArrow(_around(block, window, live), "h long, h2 int, place long").groupBy("h", "h2").agg(F.min("place").alias("place"))
    # Bare places are dealt by document: lists of each task would be rows of their own where tasks are many.
    doc, start = F.shiftright("place", START), F.col("place").bitwiseAND((1 << START) - 1).cast("int")
    firsts = firsts.select("place").repartition(doc).groupBy(doc.alias("doc")).agg(F.collect_list(start).alias("firsts"))
    runs = single.mapInArrow(_runs(block, window, live), "doc long, lo array<int>, hi array<int>").dropDuplicates(["doc"])
    spans = runs.join(firsts, "doc", "left").select("doc", "lo", "hi", "firsts").mapInArrow(_spans(window), "doc long, spans array<struct<start: int, end: int>>")
    spans = stash(spans.join(numbers, "doc").select("doc_id", "spans"), "spans")
    live.unpersist()
    discard(keys, numbers)
    return copies.withColumnRenamed("doc_id", ROW), spans.withColumnRenamed("doc_id", ROW)


#: Names that no column of the input is taken to have.
_SPANS, _OUT = "_repeat_spans", ("_repeat_words", "_repeat_removed", "_repeat_kept")
_SCHEMA = f", {_OUT[0]} long, {_OUT[1]} long, {_OUT[2]} string"


def _joined(w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of all rows, joined by one space in each row, and each row's offsets in them."""
    at = np.flatnonzero(keep).astype(np.int32)
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.starts[at]] += 1
    inside[w.ends[at]] -= 1
    mask = np.cumsum(inside, dtype=np.int8)[:-1].view(bool)
    upto = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=upto[1:])
    many = np.diff(upto[w.first])
    out = w.data.copy()
    follows = np.ones(len(at), bool)
    follows[np.cumsum(many)[many > 0] - 1] = False
    spot = w.ends[at[follows]]
    out[spot], mask[spot] = 0x20, True
    np.cumsum(np.where(keep, w.ends - w.starts, 0), out=upto[1:])
    size = np.diff(upto[w.first]) + np.maximum(many - 1, 0)
    return out[mask], np.concatenate(([0], np.cumsum(size)))


def _kept(whole: bool, digest: bool):
    """Words, words removed, and what is kept: its SHA-256, or the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(_SPANS) if _SPANS in batch.schema.names else None
            cols = [c for c in batch.schema.names if c not in (_SPANS, "text")] if not digest else ["doc_id"]
            for s in slices(batch.column("text")):
                w = words(s)
                keep = np.full(len(w.code), not whole)
                if spans is not None:
                    part = spans.slice(s.lo, s.hi - s.lo)
                    row = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy(zero_copy_only=False))
                    edges = part.flatten()
                    gone = np.zeros(len(keep) + 1, np.int32)
                    for name, step in (("start", 1), ("end", -1)):
                        np.add.at(gone, np.minimum(w.first[row] + edges.field(name).to_numpy(zero_copy_only=False), w.first[row + 1]), step)
                    keep = np.cumsum(gone[:-1]) == 0
                raw, off = _joined(w, keep)
                upto = np.concatenate(([0], np.cumsum(keep)))
                left = np.diff(upto[w.first])
                if digest:
                    data = raw.tobytes()
                    kept = pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.string())
                else:
                    kept = pa.StringArray.from_buffers(len(left), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(raw))
                own = [batch.column(c).slice(s.lo, s.hi - s.lo) for c in cols]
                yield pa.RecordBatch.from_arrays([*own, pa.array(w.counts), pa.array(w.counts - left), kept], names=[*cols, *_OUT])

    return run


def _divided(docs: DataFrame, window: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with repeated words and their spans, rows without any, and whole copies."""
    copies, spans = repeats(docs, window, block)
    docs, touched = docs.withColumn(ROW, row_key("text")), spans.select(ROW)
    part = with_ids(docs, touched, ROW).join(spans.withColumnRenamed("spans", _SPANS), ROW)
    return part, without_ids(without_ids(docs, copies, ROW), touched, ROW), with_ids(docs, copies, ROW)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, digest: bool = False) -> DataFrame:
    """Each row of docs with n_words, n_removed and kept: the words left, joined by one space (their SHA-256 with digest, then only doc_id stays of the other columns)."""
    docs = docs.select("doc_id", "text") if digest else docs.drop("n_words", "n_removed", "kept")
    cols = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols) + _SCHEMA
    part, clean, copies = _divided(docs, window, block)
    out = (
        part.select(*cols, "text", _SPANS).mapInArrow(_kept(False, digest), schema)
        .union(clean.select(*cols, "text").mapInArrow(_kept(False, digest), schema))
        .union(copies.select(*cols, "text").mapInArrow(_kept(True, digest), schema))
    )
    return out.withColumnsRenamed(dict(zip(_OUT, ("n_words", "n_removed", "kept"), strict=True)))


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs with repeated words taken out of text; texts without repeats stay as they are, texts with nothing left go."""
    part, clean, _ = _divided(docs, window, block)
    cols = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols) + _SCHEMA
    part = part.select(*cols, "text", _SPANS).mapInArrow(_kept(False, False), schema)
    part = part.where(F.col(_OUT[2]) != "").drop(*_OUT[:2]).withColumnRenamed(_OUT[2], "text")
    return clean.select(*docs.columns).unionByName(part.select(*docs.columns))
