"""Brown class-based bigram model: exchange clustering of words, class transitions and word emissions.

Words and bigrams are counted over all training texts, and every training word gets a
learned class. The bigrams become one table of word lists: each word's neighbours before
and after it with their counts, some thousand words a row; every later step is a map over
that table and a sum over classes.

1. The SEEDS most frequent words are put into CLASSES classes by exchange (each word moves
   to the class that most raises the bigram likelihood, until no word moves or PASSES are over).
2. ROUNDS rounds of exchange over the FREQUENT most frequent words: all move by their own
   lists against the same classes x classes totals; from the second round on every other
   one, and that round is kept only if it raised the likelihood.
3. Every other word moves once, from the class of its shape to its best class.

As neighbours, frequent words count by their classes; while classes are chosen, the others
count by shape (length, last byte). The model's transitions then count every bigram by the
learned classes of both words. A text's probability is the product of P(class | class
before) * P(word | class), with additive smoothing, from an end mark before its first word
to the end mark after its last. Words that training never saw have the classes of their
shapes, whose transitions are those of the training words that occur once.

The frequent words travel with the tasks (a fixed 4 MB, and up to 100 MB of counts in a
task); classes and counts of all others are joined by word over a shuffle. What comes to
the driver is bounded: FREQUENT words, and classes x classes sums.

Null text is an empty text: one end token. Rows with equal doc_id, and null ids, get a row
each, and each its own sums; ids may be of any type. Without training text all counts are
0. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .shared import discard, remainder, stash
from .words import Slice, Words, signed, slices, words

FREQUENT, SEEDS, CLASSES, PASSES, ROUNDS = 1 << 17, 1024, 64, 4, 2
#: Shape classes: by length in bytes up to 15, and whether the last byte is a letter or not.
SHAPES = 32
#: The end mark's key; no word has it.
END = np.int64(-(1 << 63))
#: Added to each class bigram's count.
PSEUDO = 0.5
#: Learned classes, shape classes and the end mark's class.
K = CLASSES + SHAPES + 1
#: In a word's list a neighbour is a frequent word's place or, after those, a shape; BEFORE marks neighbours before the word.
BEFORE, CODES = 1 << 18, 1 << 19
#: Words of a partition when lists are put together, entries of a row of the table, and entries that a task holds before it passes them on.
PART_WORDS, ROW_ENTRIES, HELD = 40_000, 400_000, 1_500_000


def _shape(w: Words) -> np.ndarray:
    last = w.data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    letter = ((last >= 97) & (last <= 122)) | (last >= 128)
    return np.minimum(w.ends - w.starts, 15) * 2 + letter


def _coded(column: pa.Array) -> Iterator[tuple[Slice, Words]]:
    for s in slices(column):
        yield s, words(s, "white", lower=True)


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their sums."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[cut], np.add.reduceat(n[order], cut) if len(cut) else n[:0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word keys with shape and count, summed over a task as far as memory allows; the shape is kept in the low bits of the count."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    texts = room = 0

    def out(x):
        h, n = x
        return _table(h=h, shape=(n & 31).astype(np.int32), n=n >> 5)

    def merged():
        h, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return h[cut], (np.add.reduceat(n >> 5, cut) << 5) | (n[cut] & 31)

    for batch in batches:
        for s, w in _coded(batch.column("text")):
            texts += s.hi - s.lo
            h, at, n = np.unique(signed(w.code), return_index=True, return_counts=True)
            if not len(h):
                continue
            held.append((h, (n << 5) | _shape(w)[at]))
            room += len(h)
            if room > HELD:
                held = [merged()]
                room = len(held[0][0])
                if room > HELD * 2 // 3:
                    yield out(held[0])
                    held, room = [], 0
    if held:
        yield out(merged())
    if texts:
        yield _table(h=np.array([END]), shape=np.zeros(1, np.int32), n=np.array([texts]))


class Lookup:
    """Places of word keys in a sorted array."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is there. Each slice looks its distinct keys up once."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h


def _with_ends(w: Words, unit: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows' units with an end mark before the first row and after each: pairs (before, after) and the row of each pair."""
    n = w.counts
    row = np.repeat(np.arange(len(n)), n + 1)
    seq = np.full(len(unit) + len(n) + 1, end, np.int64)
    seq[np.arange(len(unit)) + w.row() + 1] = unit
    return seq[:-1], seq[1:], row


def _packed(word: np.ndarray, shape: np.ndarray, code: np.ndarray, n: np.ndarray) -> bytes:
    """Entries in order of word and code as compressed bytes; word and shape are those of the entries."""
    new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
    step = np.diff(code, prepend=0)
    step[new] = code[new]
    parts = (np.diff(word[new], prepend=0), shape[new].astype(np.uint8), np.diff(np.append(new, len(word))).astype(np.int32), np.ascontiguousarray(step.astype("<i4").view(np.uint8).reshape(-1, 4).T), n.astype(np.int64))
    raw = np.array([len(new), len(word)]).tobytes() + b"".join(x.tobytes() for x in parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: pa.Buffer) -> tuple[np.ndarray, ...]:
    """Words, shapes, numbers of entries; codes and counts of the entries."""
    size = int.from_bytes(data[:8].to_pybytes(), "little")
    raw = pa.decompress(data.slice(8), size, codec="zstd")
    m, e = np.frombuffer(raw, np.int64, 2).tolist()
    at = 16
    out = []
    for kind, many in ((np.int64, m), (np.uint8, m), (np.int32, m), (np.uint8, 4 * e), (np.int64, e)):
        out.append(np.frombuffer(raw, kind, many, at))
        at += np.dtype(kind).itemsize * many
    step = np.ascontiguousarray(out[3].reshape(4, e).T).view("<i4").ravel().astype(np.int64)
    first = np.cumsum(out[2]) - out[2]
    run = np.cumsum(step)
    run -= np.repeat((run[first] - step[first]) if m else first, out[2])
    return np.cumsum(out[0]), out[1], out[2], run, out[4]


def _dealt(frequent: bool, word: np.ndarray, shape: np.ndarray, code: np.ndarray, n: np.ndarray, parts: int) -> pa.RecordBatch:
    """Entries in order of word and code, packed for each part."""
    part = (word.view(np.uint64) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    own, cut = np.unique(part[order], return_index=True)
    blobs = [_packed(word[x], shape[x], code[x], n[x]) for x in np.split(order, cut[1:])] if len(order) else []
    return _table(part=own, frequent=np.full(len(own), frequent), data=pa.array(blobs, pa.binary()), a=pa.nulls(len(own), pa.int64()), b=pa.nulls(len(own), pa.int64()), n=pa.nulls(len(own), pa.int64()))


def _neighbours(frequent, parts: int):
    """Neighbours of all words, packed by part, and the bigrams (a, b) of two words that are not frequent, each with its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shapes = frequent.value
        freq, size = Lookup(keys), len(keys)
        often: list[tuple] = []
        seldom: list[tuple] = []
        pairs: list[tuple] = []

        def of_frequent(last: bool):
            key, n = _summed(*(np.concatenate([x[i] for x in often]) for i in range(2)))
            often[:] = [] if last or len(key) > HELD * 2 // 3 else [(key, n)]
            if not often:
                word = key // CODES
                yield _dealt(True, word, shapes[word], key % CODES, n, parts)

        def of_rare():
            h, shape, code, n = (np.concatenate([x[i] for x in seldom]) for i in range(4))
            seldom.clear()
            words_, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            key, n = _summed(inverse * CODES + code, n)
            yield _dealt(False, words_[key // CODES], shape[at][key // CODES], key % CODES, n, parts)

        def of_pairs():
            a, b = (np.concatenate([x[i] for x in pairs]) for i in range(2))
            pairs.clear()
            if not len(a):
                return
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            cut = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            none = len(cut)
            yield _table(part=pa.nulls(none, pa.int32()), frequent=pa.nulls(none, pa.bool_()), data=pa.nulls(none, pa.binary()), a=a[cut], b=b[cut], n=np.diff(np.append(cut, len(a))))

        room = lambda held: sum(len(x[0]) for x in held)
        for batch in batches:
            for _, w in _coded(batch.column("text")):
                h, at, inverse = np.unique(signed(w.code), return_index=True, return_inverse=True)
                place, seen = freq.find(h)
                shape = _shape(w)[at]
                unit = np.append(np.where(seen, place, size + shape), 0)  # the end mark's key is the least
                a, b, _ = _with_ends(w, inverse, len(h))
                key = np.concatenate((a * CODES + unit[b], b * CODES + BEFORE + unit[a]))
                key, n = np.unique(key, return_counts=True)
                word, code = key // CODES, key % CODES
                known = unit[word] < size
                often.append((unit[word[known]] * CODES + code[known], n[known]))
                word = word[~known]
                seldom.append((h[word], shape[word], code[~known], n[~known]))
                both = (unit[a] >= size) & (unit[b] >= size)
                pairs.append((h[a[both]], h[b[both]]))
                if room(often) > HELD:
                    yield from of_frequent(False)
                if room(seldom) > HELD // 2:
                    yield from of_rare()
                if room(pairs) > HELD:
                    yield from of_pairs()
        for held, out in ((often, lambda: of_frequent(True)), (seldom, of_rare), (pairs, of_pairs)):
            if held:
                yield from out()

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of a partition's words: entries of equal words and codes summed, so many entries a row."""
    held: dict[bool, list] = {True: [], False: []}

    def merge(kind):
        word, shape, code, n = (np.concatenate([x[i] for x in held[kind]]) for i in range(4))
        own, at, inverse = np.unique(word, return_index=True, return_inverse=True)
        key, n = _summed(inverse * CODES + code, n)
        held[kind] = [(own[key // CODES], shape[at][key // CODES], key % CODES, n)]

    for batch in batches:
        for kind, data in zip(batch.column("frequent").to_pylist(), batch.column("data"), strict=True):
            word, shape, many, code, n = _unpacked(data.as_buffer())
            held[kind].append((np.repeat(word, many), np.repeat(shape, many), code, n))
            if sum(len(x[0]) for x in held[kind]) > 2 * len(held[kind][0][0]) + HELD:
                merge(kind)
    for kind in (True, False):
        if not held[kind]:
            continue
        merge(kind)
        word, shape, code, n = held[kind][0]
        held[kind] = []
        new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        starts = new[np.unique(new // ROW_ENTRIES, return_index=True)[1]]
        for lo, hi in zip(starts, [*starts[1:], len(word)], strict=True):
            yield _table(frequent=[kind], data=pa.array([_packed(word[lo:hi], shape[lo:hi], code[lo:hi], n[lo:hi])], pa.binary()))


def _lists(batches: Iterator[pa.RecordBatch], step: int = 4096) -> Iterator[tuple]:
    """Some words of the table at a time: frequent, words, shapes, word of each entry, its code and count."""
    for batch in batches:
        for kind, data in zip(batch.column("frequent").to_pylist(), batch.column("data"), strict=True):
            word, shape, many, code, n = _unpacked(data.as_buffer())
            upto = np.concatenate(([0], np.cumsum(many)))
            for lo in range(0, len(word), step):
                hi = min(lo + step, len(word))
                e = slice(upto[lo], upto[hi])
                yield kind, word[lo:hi], shape[lo:hi], np.repeat(np.arange(hi - lo), many[lo:hi]), code[e], n[e]


def _cells(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return _table(cell=at, n=total[at].astype(np.int64))


def _unit_pairs(model, size: int):
    """Bigrams of units (a frequent word's or shape's): after a word, as cells of a square table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n_frequent = model.value
        total = np.zeros(size * size)
        for frequent, word, shape, at, code, n in _lists(batches):
            own = of[word] if frequent else of[n_frequent + shape.astype(np.int64)]
            out = code < BEFORE
            total += np.bincount(own[at[out]] * size + of[code[out]], n[out], size * size)
        yield _cells(total)

    return run


def _contexts(word, at, code, n, of, frequent: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: bigrams to and from each class, and with itself."""
    before = code >= BEFORE
    unit = code & (BEFORE - 1)
    cell = at * K + of[unit]
    side = lambda on: np.bincount(cell[on], n[on], len(word) * K).reshape(-1, K)
    own = np.zeros(len(word))
    if frequent:
        self_ = ~before & (unit == word[at])
        own[at[self_]] = n[self_]
    return side(~before), side(before), own


def _moved(model, turn: int):
    """New classes of the frequent words that move in this round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, both = model.value
        gains = Gains(both, CLASSES)
        for frequent, word, _, at, code, n in _lists(batches):
            if not frequent:
                continue
            cls = of[word]
            go = np.flatnonzero((cls != K - 1) & ((cls >= CLASSES) | (word % 2 == turn % 2)))
            out, inn, own = _contexts(word, at, code, n, of, True)
            yield _table(word=word[go], cls=gains.best(out[go], inn[go], own[go], cls[go]))

    return run


#: Cells of the model's sums: class bigrams; bigrams to and from classes of words that occur once, by shape; words by shape; counts by class.
ONCE_OUT, ONCE_IN = K * K, K * K + SHAPES * K
TYPES = ONCE_IN + SHAPES * K
MASS = TYPES + SHAPES
CELLS = MASS + K


def _classed(model):
    """Classes of all words (h, c, cls) with their counts, frequent ones included, and the model's sums but for bigrams of two rare words (cell, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, both, n_frequent, keys = model.value
        gains, total = Gains(both, CLASSES), np.zeros(CELLS)
        for frequent, word, shape, at, code, n in _lists(batches):
            shape = shape.astype(np.int64)
            out, inn, own = _contexts(word, at, code, n, of, frequent)
            cls = of[word] if frequent else gains.best(out, inn, own, CLASSES + shape)
            c = out.sum(1)
            unit, before = code & (BEFORE - 1), code >= BEFORE
            known = unit < n_frequent
            step = np.where(before, of[unit] * K + cls[at], cls[at] * K + of[unit])
            on = known & ~before if frequent else known  # a frequent word's bigrams with rare ones are in the rare ones' lists
            total[: K * K] += np.bincount(step[on], n[on], K * K)
            word_ = cls != K - 1
            once = word_ & (c == 1)
            for side, base in ((known & ~before, ONCE_OUT), (known & before, ONCE_IN)):
                on = side & once[at]
                total[base : base + SHAPES * K] += np.bincount(shape[at[on]] * K + of[unit[on]], n[on], SHAPES * K)
            total[TYPES:MASS] += np.bincount(shape[word_], minlength=SHAPES)
            total[MASS:] += np.bincount(cls[word_], c[word_] + 1, K)
            none = pa.nulls(len(word), pa.int64())
            yield _table(h=keys[word] if frequent else word, c=c.astype(np.int64), cls=cls.astype(np.int32), frequent=np.full(len(word), frequent), cell=none, n=none)
        x = _cells(total)
        none = len(x)
        yield _table(h=pa.nulls(none, pa.int64()), c=pa.nulls(none, pa.int64()), cls=pa.nulls(none, pa.int32()), frequent=pa.nulls(none, pa.bool_()), cell=x.column("cell"), n=x.column("n"))

    return run


class Gains:
    """Rise of the likelihood by moving words alone between classes; both: bigrams of classes with the words in their old ones."""

    SMALL = 33

    def __init__(self, both: np.ndarray, classes: int):
        self.both, self.classes = both, classes
        self.sides = [np.ascontiguousarray(both[:classes].T), np.ascontiguousarray(both[:, :classes])]
        self.small = [np.stack([_xlogx(t + m) - _xlogx(t) for m in range(self.SMALL)]) for t in self.sides]

    def best(self, out: np.ndarray, inn: np.ndarray, own: np.ndarray, old: np.ndarray) -> np.ndarray:
        """The class that most raises the likelihood for each word."""
        f, n, classes, both = _xlogx, np.arange(len(old)), self.classes, self.both
        out, inn, placed = out.copy(), inn.copy(), old < classes
        out[n, old] -= own
        inn[n, old] -= own
        gain = np.zeros((len(old), classes))
        for mine, other, table, small in ((out, inn, self.sides[0], self.small[0]), (inn, out, self.sides[1], self.small[1])):
            rows, cols = np.nonzero(mine)
            for lo in range(0, len(rows), 1 << 16):
                w, s = rows[lo : lo + (1 << 16)], cols[lo : lo + (1 << 16)]
                m, mover = mine[w, s], placed[w]
                tiny = (m < self.SMALL) & (m == np.floor(m))
                add = small[np.where(tiny, m, 0).astype(np.int64), s]
                direct = np.flatnonzero(~tiny | (s == old[w]))
                x = table[s[direct]]
                same = s[direct] == old[w[direct]]
                x[same] -= other[w[direct[same]], :classes]
                add[direct] = f(x + m[direct, None]) - f(x)
                at = np.flatnonzero(mover)  # the word's own class without the word
                o = old[w[at]]
                x = table[s[at], o] - m[at] - np.where(s[at] == o, other[w[at], o] + own[w[at]], 0.0)
                add[at, o] = f(x + m[at]) - f(x)
                cut = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                gain[w[cut]] += np.add.reduceat(add, cut, axis=0)
        o, i, d = out[:, :classes], inn[:, :classes], np.tile(np.diag(both)[:classes], (len(old), 1))
        d[n[placed], old[placed]] -= o[n[placed], old[placed]] + i[n[placed], old[placed]] + own[placed]
        gain += f(d + o + i + own[:, None]) - f(d + o) - f(d + i) + f(d)
        for mine, total in ((out, both.sum(1)), (inn, both.sum(0))):
            size = mine.sum(1) + own
            t = np.tile(total[:classes], (len(old), 1))
            t[n[placed], old[placed]] -= size[placed]
            gain -= f(t + size[:, None]) - f(t)
        return gain.argmax(1)


def best_classes(out: np.ndarray, inn: np.ndarray, own: np.ndarray, old: np.ndarray, both: np.ndarray, classes: int) -> np.ndarray:
    return Gains(both, classes).best(out, inn, own, old)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, movable: int, classes: int, passes: int) -> np.ndarray:
    """Class of each unit: exchange clustering of the first `movable` units over a unit bigram matrix; the others keep classes of their own."""
    n = len(pairs)
    k = classes + n - movable
    cls = np.concatenate((np.arange(movable) % classes, classes + np.arange(n - movable)))
    one = np.zeros((n, k))
    one[np.arange(n), cls] = 1
    out, inn = pairs @ one, pairs.T @ one  # of each unit: bigrams to and from each class
    both = one.T @ out
    f = _xlogx
    for _ in range(passes):
        moved = 0
        for w in range(movable):
            if not (out[w].any() or inn[w].any()):
                continue
            old, own = cls[w], pairs[w, w]
            o, i = out[w].copy(), inn[w].copy()
            o[old] -= own
            i[old] -= own
            both[old] -= o
            both[:, old] -= i
            both[old, old] -= own
            row, col = both.sum(1), both.sum(0)
            c = np.arange(classes)
            gain = (f(both[:classes] + o) - f(both[:classes])).sum(1) + (f(both[:, :classes].T + i) - f(both[:, :classes].T)).sum(1)
            diag = both[c, c]
            gain += f(diag + o[c] + i[c] + own) - f(diag + o[c]) - f(diag + i[c]) + f(diag)
            gain -= f(row[:classes] + o.sum() + own) - f(row[:classes]) + f(col[:classes] + i.sum() + own) - f(col[:classes])
            new = int(gain.argmax())
            both[new] += o
            both[:, new] += i
            both[new, new] += own
            if new != old:
                moved += 1
                cls[w] = new
                out[:, old] -= pairs[:, w]
                out[:, new] += pairs[:, w]
                inn[:, old] -= pairs[w]
                inn[:, new] += pairs[w]
        if not moved:
            break
    return cls


def _score(model):
    """Sums of each text over what is frequent; for its other words their numbers and neighbours, and its bigrams of two of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        freq, size = Lookup(m["keys"]), len(m["keys"])
        for batch in batches:
            for s, w in _coded(batch.column("text")):
                rows = s.hi - s.lo
                h, at, inverse = np.unique(signed(w.code), return_index=True, return_inverse=True)
                place, seen = freq.find(h)
                shape = np.append(_shape(w)[at], 0)
                row = w.row()
                of = lambda x: np.where(seen, x[place], 0.0)[inverse]
                known = np.append(seen, True)
                cls = np.append(m["cls"][place], K - 1)
                a, b, pair_row = _with_ends(w, inverse, len(h))
                whole = known[a] & known[b]
                score = np.bincount(row, of(m["emit"]), rows) + np.bincount(pair_row, np.where(whole, m["steps"][cls[a], cls[b]], 0.0), rows)
                # A rare word's entries in its text: its number (code 0) and its neighbours of known class (1 + class, K more for those before it).
                out, inn, here = ~known[a] & known[b], ~known[b] & known[a], ~seen[inverse]
                who = np.concatenate((a[out], b[inn], inverse[here]))
                what = np.concatenate((1 + cls[b[out]], 1 + K + cls[a[inn]], np.zeros(int(here.sum()), np.int64)))
                where = np.concatenate((pair_row[out], pair_row[inn], row[here]))
                base = np.int64(len(h) + 1)
                key, n = np.unique((where * base + who) * 256 + what, return_counts=True)
                owner = key >> 8
                new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
                owner, each = owner[new], np.diff(np.append(new, len(key))).astype(np.int32)
                flat = np.zeros((len(key), 5), np.uint8)
                flat[:, 0] = key & 255
                flat[:, 1:] = n.astype("<u4").view(np.uint8).reshape(-1, 4)
                lists = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer((np.concatenate(([0], np.cumsum(each))) * 5).astype(np.int32)), pa.py_buffer(flat)])
                cut = np.searchsorted(owner, np.arange(rows + 1) * base).astype(np.int32)
                part = lambda x, cut: pa.ListArray.from_arrays(pa.array(cut), x if isinstance(x, pa.Array) else pa.array(x))
                word = owner % base
                both = ~known[a] & ~known[b]
                pair, n2 = np.unique((pair_row[both] * base + a[both]) * base + b[both], return_counts=True)
                pair = (pair // base // base, pair // base % base, pair % base)
                cut2 = np.searchsorted(pair[0], np.arange(rows + 1)).astype(np.int32)
                yield _table(
                    doc_id=batch.column("doc_id").slice(s.lo, rows), n_tokens=w.counts + 1, n_known=np.bincount(row, seen[inverse], rows).astype(np.int64), base=np.bincount(row, of(m["base"]), rows).astype(float), score=score.astype(float),
                    h=part(h[word], cut), shape=part(shape[word].astype(np.int32), cut), data=part(lists, cut),
                    a=part(h[pair[1]], cut2), b=part(h[pair[2]], cut2), sa=part(shape[pair[1]].astype(np.int32), cut2), sb=part(shape[pair[2]].astype(np.int32), cut2), n=part(n2.astype(np.int64), cut2),
                )

    return run


def _rest(model):
    """Sums of texts over their rare words, by the counts and classes that were joined (none: never seen in training)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            if not len(batch):
                continue
            data = batch.column("data")
            off = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
            flat = np.frombuffer(data.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(-1, 5)
            at = np.repeat(np.arange(len(batch)), np.diff(off) // 5)
            what, n = flat[:, 0].astype(np.int64), np.ascontiguousarray(flat[:, 1:]).view("<u4").ravel().astype(np.float64)
            c = batch.column("c").fill_null(0).to_numpy(zero_copy_only=False)
            cls = np.where(c > 0, batch.column("cls").fill_null(0).to_numpy(zero_copy_only=False), CLASSES + batch.column("shape").to_numpy(zero_copy_only=False))[at]
            own, out, inn = what == 0, (what > 0) & (what <= K), what > K
            log = np.log10(c + 1.0)
            value = np.zeros(len(what))
            value[own] = (log[at] - m["norm"][cls])[own]
            value[out] = m["steps"][cls[out], what[out] - 1]
            value[inn] = m["steps"][what[inn] - 1 - K, cls[inn]]
            rid, where = np.unique(batch.column("rid").to_numpy(), return_inverse=True)
            sums = lambda x: np.bincount(where[at], x, len(rid)).astype(float)
            yield _table(rid=rid, tk=sums(np.where(own & (c[at] > 0), n, 0)).astype(np.int64), tb=sums(np.where(own, n * (log[at] - m["below"]), 0.0)), ts=sums(n * value))

    return run


def _rest_pairs(model):
    """Sums of texts over their bigrams of two rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = model.value["steps"]
        for batch in batches:
            if not len(batch):
                continue
            col = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            rid, where = np.unique(col("rid"), return_inverse=True)
            none = np.zeros(len(rid))
            yield _table(rid=rid, tk=none.astype(np.int64), tb=none, ts=np.bincount(where, col("n") * steps[col("ca"), col("cb")], len(rid)).astype(float))

    return run


def _fit(both: np.ndarray) -> float:
    return float(_xlogx(both).sum() - _xlogx(both.sum(0)).sum() - _xlogx(both.sum(1)).sum())


def _sums(cells: DataFrame, size: int) -> np.ndarray:
    got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return out


def _frequent(vocab: DataFrame):
    """The end mark and the most frequent words, FREQUENT at most, in order of their keys: those with more than a count that a histogram of the counts gives."""
    high = F.floor(F.log2("c") * 256) + 4096
    counts = vocab.where(F.col("h") != int(END)).groupBy(F.when(F.col("c") < 1024, F.col("c")).otherwise(high).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("c"))
    least, room = 1 << 62, FREQUENT
    for r in sorted(counts.collect(), key=lambda r: -r["bin"]):  # some thousand bins
        if r["n"] > room:
            break
        least, room = r["c"], room - r["n"]
    return vocab.where((F.col("h") == int(END)) | (F.col("c") >= least)).toPandas().sort_values("h", ignore_index=True)


def _learned(text: DataFrame, vocab: DataFrame, tops, n_words: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(h, c, cls, frequent) of all words, the classes of the frequent ones and the model's sums by cell."""
    sc = text.sparkSession.sparkContext
    keys, shape = tops.h.to_numpy(np.int64), tops["shape"].to_numpy(np.int64)
    if not len(keys) or keys[0] != END:  # no training text
        keys, shape = np.concatenate(([END], keys)), np.concatenate(([0], shape))
    size = len(keys)
    parts = max(8, -(-n_words // PART_WORDS))
    found = stash(text.mapInArrow(_neighbours(sc.broadcast((keys, shape)), parts), "part int, frequent boolean, data binary, a long, b long, n long"), "bigrams")
    lists = stash(found.where("part is not null").select("part", "frequent", "data").repartition(parts, "part").select("frequent", "data").mapInArrow(_gathered, "frequent boolean, data binary"), "lists")
    cells = "cell long, n long"
    # Exchange of the seeds; all other words are units by shape, the end mark one of its own.
    units = SEEDS + SHAPES + 1
    unit = np.concatenate((SEEDS + shape, SEEDS + np.arange(SHAPES)))
    unit[0] = units - 1
    first = tops[tops.h != END].sort_values(["c", "h"], ascending=[False, True]).head(SEEDS)
    seeds = np.searchsorted(keys, np.sort(first.h.to_numpy(np.int64)))
    unit[seeds] = np.arange(len(seeds))
    pairs = _sums(lists.mapInArrow(_unit_pairs(sc.broadcast((unit, size)), units), cells), units * units).reshape(units, units)
    of = np.concatenate((CLASSES + shape, CLASSES + np.arange(SHAPES)))
    of[0] = K - 1
    of[seeds] = exchange(pairs, SEEDS, CLASSES, PASSES)[: len(seeds)]
    totals = lambda of: _sums(lists.mapInArrow(_unit_pairs(sc.broadcast((of, size)), K), cells), K * K).reshape(K, K)
    both = totals(of)
    for turn in range(ROUNDS):
        got = lists.where("frequent").mapInArrow(_moved(sc.broadcast((of, both)), turn), "word long, cls long").toPandas()
        new = of.copy()
        new[got["word"].to_numpy(np.int64)] = got["cls"].to_numpy(np.int64)
        after = totals(new)
        if turn and _fit(after) <= _fit(both):
            break
        of, both = new, after
    model = sc.broadcast((of, both, size, keys))
    every = stash(lists.mapInArrow(_classed(model), "h long, c long, cls int, frequent boolean, cell long, n long"), "classes")
    classes = every.where("h is not null").select("h", "c", "cls", "frequent")
    total = _sums(every.where("h is null"), CELLS)
    side = lambda k: classes.where("not frequent").select(F.col("h").alias(k), F.col("cls").alias(f"c{k}"))
    rare = found.where("part is null").groupBy("a", "b").agg(F.sum("n").alias("n")).join(side("a"), "a").join(side("b"), "b")
    total[: K * K] += _sums(rare.select((F.col("ca") * K + F.col("cb")).cast("long").alias("cell"), "n"), K * K)
    discard(found, lists)
    return classes, of[:size], total


def score_texts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (the class model), in log10, of each row of docs."""
    ship(docs.sparkSession)
    text = train.select("text")
    vocab = stash(text.mapInArrow(_count, "h long, shape int, n long").groupBy("h").agg(F.sum("n").alias("c"), F.first("shape").alias("shape")), "vocab")
    whole = vocab.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("h") == int(END), F.col("c"))).alias("ends")).first()
    total, distinct, end_count = whole["n"] or 0, whole["v"], whole["ends"] or 0
    tops = _frequent(vocab)
    classes, of, totals = _learned(text, vocab, tops, distinct)
    discard(vocab)
    sums = totals[: K * K].reshape(K, K).copy()
    sums[CLASSES : K - 1] += totals[ONCE_OUT:ONCE_IN].reshape(SHAPES, K)
    sums[:, CLASSES : K - 1] += totals[ONCE_IN:TYPES].reshape(SHAPES, K).T
    steps = sums + PSEUDO
    steps = np.log10(steps / steps.sum(1, keepdims=True))
    # Words in classes: a learned class has its training words; a shape class as many unseen words as training words have that shape, and one more.
    norm = np.zeros(K)
    norm[:CLASSES] = np.log10(np.maximum(totals[MASS : MASS + CLASSES], 1))
    norm[CLASSES : K - 1] = np.log10(totals[TYPES:MASS] + 1)
    below = float(np.log10(total + distinct + 1.0))
    keys, counts = tops.h.to_numpy(np.int64), tops.c.to_numpy(np.float64)
    if not len(keys):
        keys, counts = np.array([END]), np.zeros(1)
    logs = np.log10(counts + 1.0)
    model = docs.sparkSession.sparkContext.broadcast({"keys": keys, "base": logs - below, "emit": logs - norm[of], "cls": of, "steps": steps, "norm": norm, "below": below})
    kind = docs.schema["doc_id"].dataType.simpleString()
    form = f"doc_id {kind}, n_tokens long, n_known long, base double, score double, h array<long>, shape array<int>, data array<binary>, a array<long>, b array<long>, sa array<int>, sb array<int>, n array<long>"
    rows = stash(docs.select("doc_id", "text").mapInArrow(_score(model), form).withColumn("rid", F.monotonically_increasing_id()), "scored")
    rare = classes.where("not frequent").drop("frequent")
    part = "rid long, tk long, tb double, ts double"
    words_ = rows.select("rid", F.explode(F.arrays_zip("h", "shape", "data")).alias("t")).select("rid", "t.*").join(rare, "h", "left")
    pairs = rows.select("rid", F.explode(F.arrays_zip("a", "b", "sa", "sb", "n")).alias("t")).select("rid", "t.*")
    for k in ("a", "b"):
        pairs = pairs.join(rare.select(F.col("h").alias(k), F.col("cls").alias(f"c{k}")), k, "left").withColumn(f"c{k}", F.coalesce(f"c{k}", F.col(f"s{k}") + CLASSES))
    tail = words_.select("rid", "shape", "data", "c", "cls").mapInArrow(_rest(model), part).union(pairs.select("rid", "ca", "cb", "n").mapInArrow(_rest_pairs(model), part))
    tail = tail.groupBy("rid").agg(*[F.sum(c).alias(c) for c in ("tk", "tb", "ts")])
    end_base = float(np.log10(end_count + 1.0)) - below
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    out = rows.select("rid", "doc_id", "n_tokens", "n_known", "base", "score").join(tail, "rid", "left")
    return out.select("doc_id", "n_tokens", (F.col("n_known") + zero("tk") + int(end_count > 0)).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + zero("tb") + end_base).alias("base_score"), (F.col("score") + zero("ts")).alias("score"))


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Scores of all of docs by a model of those outside the held-out fold."""
    held = remainder("doc_id", 7, 2)
    return score_texts(docs, docs.where(~held)).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
