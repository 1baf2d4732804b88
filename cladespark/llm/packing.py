"""Bulk-synchronous best-fit packing of token sequences.

Texts become byte-pair ids plus an end id; a longer one is cut into full pieces, its
first piece taking what is left over. Pieces are range-sorted by length, which gives each
a rank among those of its length without any one task or the driver seeing them all.

Lengths and gaps are whole numbers up to the sequence length, so the sorted lists of
pieces and of gaps are runs: (length, how many) and (gap, which sequences). The sweep
goes over these runs only - at most as many lengths as a sequence has tokens, whatever
the number of documents. In each round all pieces of one length look up their successor
among the gaps (the smallest gap that holds them); conflicts are resolved by rank (the
first so many pieces go to the first so many sequences of the run), the gaps are updated
in bulk, and the rest repeats with the next gap or opens new sequences. The outcome is
that of best-fit decreasing over all pieces. Each piece then finds its sequence by length and rank.

Null text is empty: its one token is the end id. Strings of the file's added tokens, such as its end
mark, become that token, as tokenizers has it. Rows with equal doc_id are packed each.
Empty input gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .shared import discard, stash
from .words import Slice, mix, segments, slices

LENGTH = 2048
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), 0x1C, 0x1D, 0x1E, 0x1F]] = True


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The byte-level BPE of a tokenizers file, as merge ranks: the same ids, several times as fast. And the file's added tokens: whole by themselves wherever a text has them."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, added = file["model"]["vocab"], {t["content"].encode(): t["id"] for t in file["added_tokens"]}
    # The file spells bytes as printable characters: itself where printable, else from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(spelled[c] for c in w): i for w, i in vocab.items() if all(c in spelled for c in w) and w.encode() not in added}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), added


def _units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of units that are encoded alone: before a single space between visible characters, and at each text's start.

    A pre-token never goes over such a place. Spaces next to what may be a space outside
    ASCII don't count, so a unit may be longer than need be, never shorter.
    """
    n = len(data)
    at = np.flatnonzero(data[1:-1] == 0x20) + 1 if n > 2 else np.zeros(0, np.int64)
    nxt, prev = data[at + 1], data[at - 1]
    odd = np.isin(data[np.maximum(at - 2, 0)], (0xC2,)) | np.isin(data[np.maximum(at - 3, 0)], (0xE1, 0xE2, 0xE3))
    ok = ~_SPACE[nxt] & ~_SPACE[prev] & ~np.isin(nxt, (0xC2, 0xE1, 0xE2, 0xE3)) & ~((prev >= 0x80) & odd)
    return np.unique(np.concatenate((at[ok], offsets[:-1][offsets[:-1] < n])))


def _added(s: Slice, raw: bytes, added: dict[bytes, int]) -> np.ndarray:
    """Where added tokens start and end."""
    if not any(t in raw for t in added):
        return np.zeros(0, np.int64)
    form = re.compile(b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)))
    return np.array([s.offsets[i] + x for i in range(s.hi - s.lo) for m in form.finditer(s.text(i)) for x in m.span()], np.int64)


def encode(column: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of each text; each distinct unit of a run of texts is encoded once."""
    enc, added = _encoder(path)
    for s in slices(column, 1 << 20):
        data, raw = s.data, s.data.tobytes()
        start = _units(data, s.offsets)
        cut = _added(s, raw, added)
        start = np.union1d(start, cut[cut < len(data)]) if len(cut) else start
        end = np.concatenate((start[1:], [len(data)])) if len(start) else start
        key = mix(segments(data, start, end) + (end - start).astype(np.uint64))
        _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        ids = [[added[raw[a:b]]] if raw[a:b] in added else enc.encode_ordinary(raw[a:b].decode()) for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.uint32, int(size.sum()))
        first = np.cumsum(size) - size
        many = size[inverse]
        cut = np.searchsorted(start, s.offsets)
        for i in range(s.hi - s.lo):
            a, b = cut[i], cut[i + 1]
            m = many[a:b]
            place = np.repeat(first[inverse[a:b]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            yield s.lo + i, flat[place]


def _pieces(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row, ids in encode(batch.column("text"), path):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                head = len(ids) % length or length
                at = [0, *range(head, len(ids), length)]
                for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
                    for col, v in zip(out, (row, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        col.append(v)
            cols = [batch.column("doc_id").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def sweep(sizes: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over runs: (length, first rank, count, first sequence, offset) for each match of a run of pieces with a run of sequences."""
    gaps: dict[int, list[tuple[int, int, int]]] = {}  # gap: runs of (first sequence, count, tokens in each)
    order: list[int] = []
    placed, opened = [], 0

    def put(gap: int, run: tuple[int, int, int]) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append(run)

    for size in sorted(sizes, reverse=True):
        rank, left = 0, sizes[size]
        while left:
            at = bisect_left(order, size)  # the successor of this length among the gaps
            if at < len(order):
                gap = order[at]
                seq, many, used = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
                n = min(left, many)
                if many > n:
                    put(gap, (seq + n, many - n, used))
            else:
                per = length // size  # as many to a new sequence as best-fit would put there, all in one go
                gap, used = length, 0
                n, seq = -(-left // per), opened
                opened += n
                full, rest = divmod(left, per)
                for k in range(per):
                    here = full + (k < rest)
                    if here:
                        placed.append((size, rank, here, seq, k * size))
                        rank += here
                if full:
                    put(length - per * size, (seq, full, per * size))
                if rest:
                    put(length - rest * size, (seq + full, 1, rest * size))
                left = 0
                continue
            placed.append((size, rank, n, seq, used))
            put(gap - size, (seq, n, used + size))
            rank += n
            left -= n
    return placed


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its task and its place among the task's rows of its length (rows come sorted by length)."""
    task = TaskContext.get().partitionId()
    size, seen = -1, 0
    for batch in batches:
        n = batch.column("length").to_numpy()
        if not len(n):
            continue
        cut = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1])))
        place = np.arange(len(n)) - np.repeat(cut, np.diff(np.concatenate((cut, [len(n)]))))
        if n[0] == size:
            to = cut[1] if len(cut) > 1 else len(n)
            place[:to] += seen
        size, seen = n[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), task, np.int32)), pa.array(place)], names=[*batch.schema.names, "task", "place"])


def _seated(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, seq, at = plan.value
        key = size * (1 << 40) + first
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(key, n * (1 << 40) + rank, "right") - 1
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq[i] + rank - first[i]), pa.array(at[i])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of each row of docs."""
    spark = ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = stash(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, length), schema), "pieces")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The order needs a key for ties too: a length that a third of all pieces have goes to many tasks.
    order = ["length", "doc_id", "piece", "ids_crc32"]
    ranked = pieces.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_ranked, schema + ", task int, place long")
    ranked = stash(ranked, "ranked")
    discard(pieces)
    counts = ranked.groupBy("length", "task").agg(F.count("*").alias("n"))
    before: dict[tuple[int, int], int] = {}
    sizes: dict[int, int] = {}
    for r in counts.orderBy("length", "task").toLocalIterator():  # lengths plus tasks at most: ranges meet at their edges only
        before[r["length"], r["task"]] = sizes.get(r["length"], 0)
        sizes[r["length"]] = sizes.get(r["length"], 0) + r["n"]
    placed = np.array(sorted(sweep(sizes, length)), np.int64).reshape(-1, 5)
    plan = spark.sparkContext.broadcast((placed[:, 0], placed[:, 1], placed[:, 3], placed[:, 4]))
    offs = spark.createDataFrame([(int(a), int(b), int(n)) for (a, b), n in before.items()] or [(0, 0, 0)], "length long, task int, before long")
    rows = ranked.join(F.broadcast(offs), ["length", "task"]).withColumn("rank", F.col("place") + F.col("before"))
    return rows.mapInArrow(_seated(plan), schema + ", sequence_id long, offset long")
