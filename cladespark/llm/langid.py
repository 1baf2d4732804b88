"""Language ID by hierarchical discrimination: language family first, then the language within it.

Features are hashed byte trigrams of the whole text (lower-cased ASCII, digits dropped
as features of no language). A one-versus-one linear support vector machine decides
between families, and in each family one-versus-one machines separate its languages.
The machines are fitted on a bounded sample: PER_LANG texts of each language, those with
the smallest hashes of their ids.

Null text, or one without a letter (Unicode categories L), is `und` with score 0. Rows with null lang teach
nothing. Without any labelled text every prediction is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .shared import remainder
from .words import _LOWER, slices

#: Texts of each language that the machines are fitted on, at most; size of the feature vector.
PER_LANG, FEATURES = 400, 4096
#: Families by ISO 639-1 code; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "uralic": ("et", "fi", "hu"),
}
_FAMILY = {lang: f for f, langs in FAMILIES.items() for lang in langs}


def family(lang: str) -> str:
    return _FAMILY.get(lang, f"other:{lang}")


def _codes(raw: np.ndarray) -> np.ndarray:
    """A feature for each three bytes in a row, A-Z lower-cased."""
    d = _LOWER[raw].astype(np.uint32)
    return ((d[:-2] * 2654435 + d[1:-1] * 40503 + d[2:]) * np.uint32(2654435761)) >> np.uint32(20) if len(d) > 2 else np.zeros(0, np.uint32)


def _lettered(raw: np.ndarray) -> bool:
    low = _LOWER[raw]
    return bool(((low >= 97) & (low <= 122)).any()) or bool((low >= 128).any() and any(map(str.isalpha, set(raw.tobytes().decode()))))


def _long(data: np.ndarray, limit: int) -> tuple[np.ndarray, bool]:
    """Counts of features and whether there is a letter, of one text in parts of about limit bytes, cut between characters."""
    n, lo, counts, letter = len(data), 0, np.zeros(FEATURES, np.int64), False
    while lo < n:
        hi = min(lo + limit, n)
        while hi < n and data[hi] & 0xC0 == 0x80:
            hi -= 1
        counts += np.bincount(_codes(data[lo : hi + 2]), minlength=FEATURES)
        letter = letter or _lettered(data[lo:hi])
        lo = hi
    return counts, letter


def _vectors(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, unit feature vectors, has a letter) of runs of texts."""
    for s in slices(column, limit):
        x = np.zeros((s.hi - s.lo, FEATURES), np.float32)
        letter = np.zeros(s.hi - s.lo, bool)
        if len(s.data) > limit:
            counts, letter[0] = _long(s.data, limit)
            x[0] = np.sqrt(counts)
            x[0] /= max(1e-9, np.linalg.norm(x[0]))
            yield s.lo, x, letter
            continue
        code = _codes(s.data)
        for i in range(s.hi - s.lo):
            a, b = int(s.offsets[i]), int(s.offsets[i + 1])
            letter[i] = _lettered(s.data[a:b])
            if b - a > 2:
                x[i] = np.sqrt(np.bincount(code[a : b - 2], minlength=FEATURES))
                x[i] /= np.linalg.norm(x[i])
        yield s.lo, x, letter


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, x, ok in _vectors(batch.column("text")):
            part = batch.slice(lo, len(x))
            rows = pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), rows], names=["lang", "h", "x"]).filter(pa.array(ok))


def _machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 200) -> np.ndarray:
    """Linear machine with squared hinge loss by accelerated gradient descent; the last weight is the bias. y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = 1.0 / (1.0 / c + 2 * 2.0)
    for t in range(steps):
        gap = np.maximum(0, 1 - y * (x @ v))
        grad = v / c / 10 - 2 * x.T @ (share * y * gap)
        nxt = v - rate * grad
        v = nxt + t / (t + 3) * (nxt - w)
        w = nxt
    return w.astype(np.float32)


def _one_versus_one(x: np.ndarray, names: np.ndarray) -> list[tuple[str, str, np.ndarray]]:
    kinds = sorted(set(names.tolist()))
    out = []
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            at = (names == a) | (names == b)
            out.append((a, b, _machine(x[at], np.where(names[at] == a, 1.0, -1.0).astype(np.float32))))
    return out


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> dict:
    """The machines, from rows of docs with text and lang."""
    ship(docs.sparkSession)
    rows = docs.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("doc_id").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {"families": [], "langs": {}, "only": []}
    # A hash threshold for each language lets through a little over per_lang of its rows.
    edge = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, float(min(1.0, (1.5 * per_lang + 20) / n)) * 2**64 - 2**63)])
    some = rows.where(F.col("h").cast("double") <= edge[F.col("lang")])
    got = some.mapInArrow(_features, "lang string, h long, x binary").collect()
    got.sort(key=lambda r: (r["lang"], r["h"]))
    taken: dict[str, int] = {}
    keep = []
    for r in got:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_lang:
            keep.append(r)
    if not keep:
        return {"families": [], "langs": {}, "only": []}
    x = np.frombuffer(b"".join(r["x"] for r in keep), np.float16).reshape(len(keep), FEATURES).astype(np.float32)
    lang = np.array([r["lang"] for r in keep], object)
    fam = np.array([family(v) for v in lang], object)
    within = {f: _one_versus_one(x[fam == f], lang[fam == f]) for f in sorted(set(fam))}
    alone = {f: sorted(set(lang[fam == f])) for f in within}
    return {"families": _one_versus_one(x, fam), "langs": within, "only": alone}


def _vote(x: np.ndarray, machines: list, kinds: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Winner of each row among kinds, by votes and then by margins, and the probability-like share of its weakest duel."""
    if len(kinds) == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    votes = np.zeros((len(x), len(kinds)))
    least = np.full((len(x), len(kinds)), 1.0)
    for a, b, w in machines:
        m = 1 / (1 + np.exp(-3.0 * (x @ w[:-1] + w[-1]).astype(np.float64)))
        i, j = kinds.index(a), kinds.index(b)
        votes[:, i] += (m >= 0.5) + m / 1000
        votes[:, j] += (m < 0.5) + (1 - m) / 1000
        least[:, i] = np.minimum(least[:, i], m)
        least[:, j] = np.minimum(least[:, j], 1 - m)
    best = votes.argmax(1)
    return best, least[np.arange(len(x)), best]


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        kinds = sorted(m["langs"])
        for batch in batches:
            lang, score = np.full(len(batch), "und", object), np.zeros(len(batch))
            for lo, x, ok in _vectors(batch.column("text")):
                if not kinds:
                    continue
                fam, p = _vote(x, m["families"], kinds)
                for i, f in enumerate(kinds):
                    at = np.flatnonzero((fam == i) & ok)
                    if len(at):
                        names = m["only"][f]
                        best, q = _vote(x[at], m["langs"][f], names)
                        lang[lo + at] = np.array(names, object)[best]
                        score[lo + at] = p[at] * q
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, train: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of each row of docs, by machines fitted on train."""
    model = docs.sparkSession.sparkContext.broadcast(fit(train, per_lang))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_predict(model), f"doc_id {kind}, lang_pred string, score double")


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """Predictions for all of docs, learned from those outside the held-out fold."""
    held = remainder("doc_id", 4, 2)
    out = identify(docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
