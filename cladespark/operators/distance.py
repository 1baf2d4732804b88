"""All-pairs distances between aligned sequences of bit masks.

Taxa are dealt to ranges of about BLOCK, or more if there are many (see blocks.meet); all
pairs of two of them are products of matrices (taxa x sites x states), a tile of BLOCK taxa
of each side at a time. A row is sent once for each other block, as bytes. Distances are
found beside the products, so that a pair leaves its task as its result only, in the order
of its taxa.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .ordering import ranked

EPSILON = 1.1920928955078125e-07
#: Taxa of a block or tile, about; pairs of a task.
BLOCK, PAIRS = 256, 1 << 24


def _spread(x: np.ndarray, states: int, score_gaps: bool) -> np.ndarray:
    """(taxa, sites, states): each code spread evenly over its states; gaps are zeros, or all states if they score."""
    x = np.where(x == 0, (1 << states) - 1, x) if score_gaps else x
    bits = ((x[..., None] >> np.arange(states)) & 1).astype(float)
    return bits / np.maximum(bits.sum(-1, keepdims=True), 1)


class Tile:
    """Spread codes of some taxa. In single precision if their products and sums are exact in it: each code allows one, two or four states, and there are few sites. whole: no site of the block is a gap that doesn't score. parts: so many parts of one an identity can be, if it is known."""

    def __init__(self, codes: np.ndarray, spread: np.ndarray, whole: bool, parts: int | None):
        self.x, self.whole, self.parts = spread[codes], whole, parts

    def __len__(self) -> int:
        return len(self.x)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.x.shape

    def flat(self) -> np.ndarray:
        return self.x.reshape(len(self.x), -1)

    def there(self) -> np.ndarray:
        return (self.x.sum(2) > 0).astype(self.x.dtype)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return self.x.astype(dtype or float)


#: Sites whose sums of sixteenths are exact in single precision, even times their number.
FEW = 1000


def _tiles(codes: np.ndarray, states: int, score_gaps: bool) -> Callable[[slice], Tile]:
    """Tiles of a block's codes: each code that occurs is spread once."""
    own, at = np.unique(codes, return_inverse=True)
    at, spread = at.reshape(codes.shape).astype(np.int32), _spread(own.astype(np.int64), states, score_gaps)
    n = (spread > 0).sum(-1)
    parts = None if codes.shape[1] > FEW or not np.isin(n, (0, 1, 2, 4)).all() else 1 if (n < 2).all() else 16
    spread = spread if parts is None else spread.astype(np.float32)
    return lambda rows: Tile(at[rows], spread, bool((n > 0).all()), parts)


def _packed(states: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """tid and the codes v as bytes of the least width that holds them."""
    kind = np.uint8 if states <= 8 else np.int32

    def run(batches):
        for batch in batches:
            v = batch.column("v").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array([np.array(x, np.int64).astype(kind).tobytes() for x in v], pa.binary())], names=["tid", "v"])

    return run


def block_pairs(rows: DataFrame, how: Callable[[Tile, Tile], list[np.ndarray]], columns: str, states: int = 4, score_gaps: bool = True, whole: Callable[[list[np.ndarray]], list[np.ndarray]] | None = None, nulls: bool = False) -> DataFrame:
    """(i, j, columns) for i < j of rows (tid, v array<int>); how gets two tiles of spread codes and returns a taxa x taxa matrix for each column. With nulls, NaN goes out as null.

    With whole, one row (columns) for each tile instead: whole gets the columns' values of the tile's pairs.
    """
    size, code = BLOCK, np.uint8 if states <= 8 else np.int32
    kind = rows.schema["tid"].dataType.simpleString()
    arrow = {"double": pa.float64(), "bigint": pa.int64(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [(c.split()[0], arrow[c.split()[1]]) for c in columns.split(", ")]

    def tile(a, b, x, y, same):
        """The pairs of two tiles; of one and the same table, and of equal taxa, those of a lesser and a greater one."""
        values = [np.ascontiguousarray(m).ravel() for m in how(x, y)]
        at, to = np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x))
        if same or a[-1].as_py() == b[0].as_py():
            less = pa.compute.less(a.take(pa.array(at)), b.take(pa.array(to))).to_numpy(zero_copy_only=False)
            values, at, to = [m[less] for m in values], at[less], to[less]
        if whole:
            return pa.RecordBatch.from_arrays([pa.array(m, t) for m, (_, t) in zip(whole(values), fields, strict=True)], names=[n for n, _ in fields])
        low, high = (pa.array(t.to_numpy()[k]) if pa.types.is_integer(t.type) else t.take(pa.array(k)) for t, k in ((a, at), (b, to)))
        return pa.RecordBatch.from_arrays([low, high, *(pa.array(m, from_pandas=nulls) for m in values)], names=["i", "j", *(n for n, _ in fields)])

    def run(left: pa.Table, right: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        sides = []
        for t in (left, right):
            v = t.column("v").to_pylist()
            sides.append((t.column("tid").combine_chunks(), _tiles(np.frombuffer(b"".join(v), code).reshape(len(v), -1), states, score_gaps)))
        (a, x), (b, y) = sides
        for j in range(0, len(b), size):
            other = y(slice(j, j + size))
            for i in range(0, j + 1 if same else len(a), size):
                yield tile(a.slice(i, size), b.slice(j, size), x(slice(i, i + size)), other, same and i == j)

    keyed = rows.select("tid", "v").mapInArrow(_packed(states), f"tid {kind}, v binary")
    return blocks.meet(keyed, "tid", run, columns if whole else f"i {kind}, j {kind}, {columns}", None, BLOCK, PAIRS, rows.select("tid"))


def _same(x: Tile, y: Tile) -> tuple[np.ndarray, np.ndarray | int]:
    """Expected identities and comparable sites of a tile's pairs; the sites are one number if no site is missing."""
    return x.flat() @ y.flat().T, x.shape[1] if x.whole and y.whole else x.there() @ y.there().T


def _identities(x: Tile, y: Tile) -> list[np.ndarray]:
    same, n = _same(x, y)
    return [same.astype(float), np.broadcast_to(np.rint(n), same.shape).astype(np.int64)]


#: Cells of a table of results, at most.
CELLS = 1 << 20


@lru_cache(8)
def _results(of: Callable, states: int, sites: int, parts: int, missing: bool) -> np.ndarray:
    """of() for each number of comparable sites (only the whole, if none is missing) and of parts of identities."""
    n = np.arange(sites + 1)[:, None] if missing else np.array([[sites]])
    with np.errstate(divide="ignore", invalid="ignore"):
        return of(np.minimum(np.arange(sites * parts + 1) / parts, n), np.broadcast_to(n, (len(n), sites * parts + 1)), states)


def _looked_up(of: Callable) -> Callable[[Tile, Tile], list[np.ndarray]]:
    """of(identities, sites, states) of a tile: from a table of all results, if it is small."""

    def how(x: Tile, y: Tile) -> list[np.ndarray]:
        (same, n), (_, sites, states), parts = _same(x, y), x.shape, max(x.parts or 0, y.parts or 0)
        one = isinstance(n, int)
        if not (x.parts and y.parts) or (sites * parts + 1) * (1 if one else sites + 1) > CELLS:
            same, n = same.astype(float), np.broadcast_to(np.rint(n), same.shape).astype(np.int64)
            return [of(same, n, states)]
        at = np.rint(same * parts).astype(np.int32)
        if not one:
            at += np.rint(n).astype(np.int32) * (sites * parts + 1)
        return [_results(of, states, sites, parts, not one).ravel().take(at)]

    return how


def _matrices(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(taxa, taxa, states, states): each comparable site of a pair spread evenly over the states that both codes allow."""
    states = x.shape[2]
    there = lambda v: (v.sum(2) > 0).astype(float)[:, :, None]
    x, y = x * there(x), y * there(y)
    out = np.zeros((len(x), len(y), states, states))
    for s in range(states):
        for t in range(states):
            out[:, :, s, t] = x[:, :, s] @ y[:, :, t].T
    return out


def pairs(rows: DataFrame, states: int = 4, score_gaps: bool = True) -> DataFrame:
    """(i, j, fident, n) for i < j of rows (tid, v array<int>): expected identities and comparable sites."""
    return block_pairs(rows, _identities, "fident double, n long", states, score_gaps)


def _p(same: np.ndarray, n: np.ndarray, states: int) -> np.ndarray:
    """p_distance() of arrays."""
    return np.where(n > 0, 1 - same / np.maximum(n, 1), 1.0)


def p_distance(stats: DataFrame) -> DataFrame:
    """1 - identity; 1 where nothing compares."""
    return stats.select("i", "j", F.when(F.col("n") > 0, 1 - F.col("fident") / F.col("n")).otherwise(1.0).alias("d"))


#: Terms of the Jukes-Cantor series, at most: each falls below EPSILON by then for two states or more.
TERMS = 16


def jukes_cantor(stats: DataFrame, states: int = 4) -> DataFrame:
    """Series-corrected distance; null where nothing compares."""
    b = (states - 1) / states
    k, n = F.col("n") - F.col("fident"), F.col("n")
    out = stats.withColumns({"_k": k, "_last": F.floor(k + 1e-9), "_t": F.lit(b), "_d": F.lit(0.0)})
    for x in range(1, TERMS + 1):
        more = (F.col("_t") >= EPSILON) & (F.col("_last") >= x)
        out = out.withColumn("_t", F.when(more, F.col("_t") * (F.col("_k") / (x * n)) / b).otherwise(0.0)).withColumn("_d", F.col("_d") + F.col("_t"))
    return out.select("i", "j", F.when(n > 0, F.col("_d")).alias("d"))


def _jukes_cantor(same: np.ndarray, n: np.ndarray, states: int) -> np.ndarray:
    """jukes_cantor() of arrays; NaN where nothing compares."""
    b = (states - 1) / states
    k, sites = n - same, np.maximum(n, 1)
    last, t, d = np.floor(k + 1e-9), np.full(k.shape, b), np.zeros(k.shape)
    for step in range(1, TERMS + 1):
        t = np.where((t >= EPSILON) & (last >= step), t * (k / (step * sites)) / b, 0.0)
        if not t.any():
            break
        d += t
    return np.where(n > 0, d, np.nan)


# PAM distances by tenths of a percent of difference, from 75 % to 93 %, as published with the Dayhoff matrices' use in multiple alignment.
DAYHOFF_PAMS = (
    195, 196, 197, 198, 199, 200, 200, 201, 202, 203, 204, 205, 206, 207, 208, 209, 209, 210, 211, 212,
    213, 214, 215, 216, 217, 218, 219, 220, 221, 222, 223, 224, 226, 227, 228, 229, 230, 231, 232, 233,
    234, 236, 237, 238, 239, 240, 241, 243, 244, 245, 246, 248, 249, 250, 252, 253, 254, 255, 257, 258,
    260, 261, 262, 264, 265, 267, 268, 270, 271, 273, 274, 276, 277, 279, 281, 282, 284, 285, 287, 289,
    291, 292, 294, 296, 298, 299, 301, 303, 305, 307, 309, 311, 313, 315, 317, 319, 321, 323, 325, 328,
    330, 332, 335, 337, 339, 342, 344, 347, 349, 352, 354, 357, 360, 362, 365, 368, 371, 374, 377, 380,
    383, 386, 389, 393, 396, 399, 403, 407, 410, 414, 418, 422, 426, 430, 434, 438, 442, 447, 451, 456,
    461, 466, 471, 476, 482, 487, 493, 498, 504, 511, 517, 524, 531, 538, 545, 553, 560, 569, 577, 586,
    595, 605, 615, 626, 637, 649, 661, 675, 688, 703, 719, 736, 754, 775, 796, 819, 845, 874, 907, 945,
    988,
)


def kimura_protein(stats: DataFrame) -> DataFrame:
    """Kimura's distance of proteins from the share of differences; by the table between 75 % and 93 %, 10 beyond, NaN where nothing compares."""
    u = 1 - F.col("fident") / F.col("n")
    q = F.rint(1000 * u).cast("int")
    pam = F.element_at(F.array(*[F.lit(x / 100) for x in DAYHOFF_PAMS]), F.greatest(F.lit(1), F.least(F.lit(181), q - 749)))
    d = F.when(F.col("n") == 0, F.lit(float("nan"))).when(q == 0, 0.0).when(q < 750, -F.log(1 - u - u * u / 5)).when(q <= 930, pam).otherwise(10.0)
    return stats.select("i", "j", d.alias("d"))


def _kimura_protein(same: np.ndarray, n: np.ndarray, states: int) -> np.ndarray:
    """kimura_protein() of arrays."""
    u = 1 - same / np.maximum(n, 1)
    q = np.rint(1000 * u).astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(q == 0, 0.0, -np.log(1 - u - u * u / 5))
    d = np.where(q >= 750, np.array(DAYHOFF_PAMS)[np.clip(q - 750, 0, 180)] / 100, d)
    return np.where(n > 0, np.where(q > 930, 10.0, d), np.nan)


def pair_matrix(a: np.ndarray, b: np.ndarray, states: int) -> np.ndarray:
    """Each comparable site spread evenly over the states that both codes allow."""
    bits = np.arange(states)
    x, y = ((v[:, None] >> bits) & 1 for v in (a, b))
    ok = (a > 0) & (b > 0)
    x, y = x[ok] / x[ok].sum(1, keepdims=True), y[ok] / y[ok].sum(1, keepdims=True)
    return x.T @ y


def kimura_dna(f: np.ndarray) -> float:
    """Two-parameter distance by Tajima's series, over rounded counts (states in the order A, C, G, T)."""
    return tajima(*_changes(f[None])[0].tolist())


def _changes(f: np.ndarray) -> np.ndarray:
    """(pairs, 3): comparable sites, transitions and transversions of pair matrices, rounded."""
    total = f.sum((1, 2))
    ks = f[:, 0, 2] + f[:, 2, 0] + f[:, 1, 3] + f[:, 3, 1]
    kv = total - np.trace(f, axis1=1, axis2=2) - ks
    return np.rint(np.stack((total, ks, kv), 1)).astype(np.int64)


def tajima(n: int, ks: int, kv: int) -> float:
    """Tajima's series for n sites with ks transitions and kv transversions; NaN without sites."""
    if n == 0:
        return math.nan
    first = 0.0
    for i in range(1, ks + kv + 1):
        low = max(0, i - kv)
        ln = math.lgamma(i + 1) - i * math.log(n) - math.log(2 * i) - math.lgamma(i - low + 1) - math.lgamma(low + 1)
        t = math.exp(ln + ((i - low) * math.log(kv) if i > low else 0.0) + (low * math.log(2 * ks) if low else 0.0))
        first += t
        # The published results divide by the falling index here, too.
        for j in range(low + 1, min(i, ks) + 1):
            t *= 2 * ks / kv / j / max(i - j, 1) if kv else 0.0
            first += t
    second = 0.5 * kv / n + sum(0.5 * (kv / n) * (2 * kv / n) ** (i - 1) / i for i in range(2, kv))
    return first + second


#: A determinant below this share of the root of the margins' product is taken for rounding of a singular matrix.
SINGULAR = 1e-9


def log_det(f: np.ndarray) -> float:
    """Paralinear distance of a pair matrix; NaN where it isn't defined."""
    total, rows, cols = f.sum(), f.sum(1), f.sum(0)
    if total == 0 or (rows == 0).any() or (cols == 0).any():
        return math.nan
    sign, ln = np.linalg.slogdet(f)
    share = ln - 0.5 * (np.log(rows).sum() + np.log(cols).sum())
    return -share / len(f) + 0.0 if sign > 0 and share > math.log(SINGULAR) else math.nan


#: The series of a triple of counts, kept by a Python worker from tile to tile.
_series = lru_cache(1 << 18)(tajima)


def _kimura_block(x: Tile, y: Tile, places: int | None = None) -> list[np.ndarray]:
    """kimura_dna() of a tile: the series once for each distinct triple of counts. A transition is an identity with the states A and G, C and T changed for each other."""
    same, n = _same(x, y)
    ts = x.flat() @ y.x[:, :, [2, 3, 0, 1]].reshape(len(y), -1).T
    tv = n - same - ts
    if x.parts and y.parts:  # exact
        ks, kv = np.rint(ts).astype(np.int32), np.rint(tv).astype(np.int32)
    else:
        ks, kv = (np.rint(np.round(v, 9)).astype(np.int64) for v in (ts, tv))
    base = x.shape[1] + 1
    at = ks * base + kv
    if isinstance(n, int) and base * base <= CELLS:
        known = _known(n, places)
        need = np.flatnonzero(np.bincount(at.ravel(), minlength=base * base))
        need = need[np.isnan(known[need])]
        known[need] = _round(np.array([tajima(n, k // base, k % base) for k in need.tolist()], float), places)
        return [known.take(at)]
    at = at + np.rint(n).astype(np.int64) * (base * base)
    own, at = np.unique(at.ravel(), return_inverse=True)
    d = [_series(k // base // base, k // base % base, k % base) for k in own.tolist()]
    return [_round(np.array(d), places)[at.ravel()].reshape(same.shape)]


@lru_cache(8)
def _known(n: int, places: int | None) -> np.ndarray:
    """The series by transitions and transversions of n sites, NaN as long as it was not needed."""
    return np.full((n + 1) ** 2, np.nan)


def _det4(f: list[list[np.ndarray]]) -> np.ndarray:
    """Determinants of 4 x 4 matrices whose cells are arrays, by minors of two rows."""
    two = lambda a, b, i, j: f[a][i] * f[b][j] - f[a][j] * f[b][i]
    ways = [(0, 1, 2, 3, 1), (0, 2, 1, 3, -1), (0, 3, 1, 2, 1), (1, 2, 0, 3, 1), (1, 3, 0, 2, -1), (2, 3, 0, 1, 1)]
    return sum(sign * two(0, 1, i, j) * two(2, 3, k, m) for i, j, k, m, sign in ways)


def _shares(x: Tile, y: Tile) -> np.ndarray:
    """Determinants of a tile's pair matrices against the roots of their margins' products, for four states and no missing site: the margins are each taxon's own, and what is left of the determinant beside them is one of 3 x 3 cells. 0 where a margin is."""
    sites = x.shape[1]
    own, other = (v.x.sum(1, dtype=float) for v in (x, y))
    a = (x.x[:, :, :3] * np.float32(sites) if x.x.dtype == np.float32 else x.x[:, :, :3] * sites) - own[:, None, :3].astype(x.x.dtype)
    cells = np.ascontiguousarray(a.transpose(2, 0, 1)).reshape(-1, sites) @ np.ascontiguousarray(y.x[:, :, :3].transpose(2, 0, 1)).reshape(-1, sites).T
    m, k = len(x), len(y)
    f = [[cells[s * m : (s + 1) * m, t * k : (t + 1) * k].astype(float) for t in range(3)] for s in range(3)]
    det = f[0][0] * (f[1][1] * f[2][2] - f[1][2] * f[2][1])
    det -= f[0][1] * (f[1][0] * f[2][2] - f[1][2] * f[2][0])
    det += f[0][2] * (f[1][0] * f[2][1] - f[1][1] * f[2][0])
    with np.errstate(divide="ignore"):
        scale = [np.where((v > 0).all(1), 1 / (sites * np.sqrt(v).prod(1)), 0.0) for v in (own, other)]
    det *= scale[0][:, None]
    det *= scale[1]
    return det


def _log_det_block(x: Tile, y: Tile) -> list[np.ndarray]:
    """log_det() of a tile."""
    states = x.shape[2]
    if states == 4 and x.whole and y.whole:
        share = _shares(x, y)
        ok = share > SINGULAR
        d = np.log(share, where=ok, out=share)
        d /= -4
        d += 0.0
        d[~ok] = np.nan
        return [d]
    x, y = np.asarray(x), np.asarray(y)
    if states != 4:
        f = _matrices(x, y)
        sign, ln = np.linalg.slogdet(f)
        rows, cols = (f.sum(k) for k in (3, 2))
        with np.errstate(divide="ignore", invalid="ignore"):
            share = ln - 0.5 * (np.log(rows).sum(2) + np.log(cols).sum(2))
        ok = (rows > 0).all(2) & (cols > 0).all(2) & (sign > 0)
    else:
        there = lambda v: (v.sum(2) > 0).astype(float)[:, :, None]
        x, y = x * there(x), y * there(y)
        a, b = ([np.ascontiguousarray(v[:, :, s]) for s in range(4)] for v in (x, y))
        f = [[a[s] @ b[t].T for t in range(4)] for s in range(4)]
        margins = [sum(f[s]) for s in range(4)] + [sum(f[s][t] for s in range(4)) for t in range(4)]
        det, scale = _det4(f), math.prod(np.sqrt(m) for m in margins)
        ok = (scale > 0) & (det > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.log(det / scale)
    return [np.where(ok & (share > math.log(SINGULAR)), -share / states + 0.0, np.nan)]


def _least_share(x: Tile, y: Tile) -> list[np.ndarray]:
    """What falls as log_det() of a tile rises, without its logarithms; NaN where that isn't defined."""
    if x.shape[2] == 4 and x.whole and y.whole:
        share = _shares(x, y)
        return [np.where(share > SINGULAR, share, np.nan)]
    return [np.exp(-x.shape[2] * v) for v in _log_det_block(x, y)]


#: Functions of identities and sites, and kernels of tiles.
_VALUES = {"p": _p, "jukes_cantor": _jukes_cantor, "kimura_protein": _kimura_protein}
_BLOCKS = {"kimura": _kimura_block, "logdet": _log_det_block}


def _round(v: np.ndarray, places: int | None) -> np.ndarray:
    """v with halves rounded up at a place, or as it is."""
    return v if places is None else np.floor(v * 10.0**places + 0.5) / 10.0**places


def _kernel(kind: str, places: int | None) -> Callable[[Tile, Tile], list[np.ndarray]]:
    """The distances of a kind, rounded; those that have few values are rounded once for each."""
    if kind in _VALUES:
        of = _VALUES[kind]
        return _looked_up(lambda same, n, states: _round(of(same, n, states), places))
    if kind == "kimura":
        return partial(_kimura_block, places=places)
    return lambda x, y: [_round(v, places) for v in _BLOCKS[kind](x, y)]


def matrix_distance(rows: DataFrame, kind: str, states: int = 4, score_gaps: bool = True, places: int | None = None) -> DataFrame:
    """(i, j, d) with d by p_distance, jukes_cantor, kimura_protein, kimura_dna or log_det, rounded to places if they are given; NaN (jukes_cantor: null) where it isn't defined."""
    return block_pairs(rows, _kernel(kind, places), "d double", states, score_gaps, nulls=kind == "jukes_cantor")


def defined_matrix_distance(rows: DataFrame, kind: str, states: int = 4, score_gaps: bool = True, places: int | None = None) -> DataFrame:
    """matrix_distance() with convert_nan(): the largest distance is found first, from one number for each tile."""
    how = _kernel(kind, None)
    if kind == "logdet":
        least = block_pairs(rows, _least_share, "least double", states, score_gaps, whole=lambda v: [np.array([np.nanmin(v[0], initial=np.inf)])]).agg(F.min("least")).first()[0]
        most = max(0.0, -math.log(least) / states) if least and math.isfinite(least) else 0.0
    else:
        most = block_pairs(rows, how, "most double", states, score_gaps, whole=lambda v: [np.array([np.nanmax(v[0], initial=0.0)])]).agg(F.max("most")).first()[0] or 0.0
    filled = lambda x, y: [np.where(np.isnan(v), 2 * most, v) for v in how(x, y)]
    return block_pairs(rows, lambda x, y: [_round(v, places) for v in filled(x, y)], "d double", states, score_gaps)


def require_defined(dists: DataFrame) -> DataFrame:
    """dists, failing when a NaN is read."""
    text = F.concat(F.lit("no distance between "), F.col("i").cast("string"), F.lit(" and "), F.col("j").cast("string"))
    return dists.withColumn("d", F.when(F.isnan("d"), F.raise_error(text).cast("double")).otherwise(F.col("d")))


def convert_nan(dists: DataFrame) -> DataFrame:
    """NaN becomes twice the largest distance that could be computed."""
    most = dists.where(~F.isnan("d")).agg((2 * F.coalesce(F.max("d"), F.lit(0.0))).alias("most"))
    return dists.crossJoin(F.broadcast(most)).select("i", "j", F.when(F.isnan("d"), F.col("most")).otherwise(F.col("d")).alias("d"))


def symmetric(dists: DataFrame) -> DataFrame:
    return dists.select("i", "j", "d").union(dists.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def row_sums(dists: DataFrame) -> DataFrame:
    return symmetric(dists).groupBy("i").agg(F.sum("d").alias("r"))


def q_matrix(dists: DataFrame) -> DataFrame:
    """(i, j, q) of the first neighbor-joining step: d - (r_i + r_j) / (n - 2)."""
    r = row_sums(dists)
    n = r.agg(F.count("*").alias("n"))
    out = dists.join(r.withColumnRenamed("r", "ri"), "i").join(r.select(F.col("i").alias("j"), F.col("r").alias("rj")), "j").crossJoin(F.broadcast(n))
    return out.select("i", "j", (F.col("d") - (F.col("ri") + F.col("rj")) / (F.col("n") - 2)).alias("q"))


def render_lower(dists: DataFrame, fmt: str = "%.6f") -> DataFrame:
    """(i, line): each row of the lower triangle as text."""
    low = dists.select(F.col("j").alias("i"), F.col("i").alias("c"), "d")
    cells = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "d"))), lambda x: F.format_string(fmt, x["d"])), " ")
    return low.groupBy("i").agg(cells("d").alias("line"))


def render_upper(dists: DataFrame, fmt: str = "%.6f") -> DataFrame:
    """(i, line): each row of the upper triangle as text."""
    return render_lower(dists.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"), fmt)


def render_full(dists: DataFrame, fmt: str = "%.6f") -> DataFrame:
    """(i, line): each row of the whole matrix as text, with zeros on its diagonal."""
    turned = dists.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")
    ids = dists.select(F.explode(F.array("i", "j")).alias("i")).distinct()
    return render_lower(dists.select("i", "j", "d").union(turned).union(ids.select("i", F.col("i").alias("j"), F.lit(0.0))), fmt)


def _drawn(dists: DataFrame, seed: int) -> DataFrame:
    """(id, draw): each taxon with a hash that orders the taxa at random."""
    ids = dists.select(F.explode(F.array("i", "j")).alias("id")).distinct()
    return ids.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))))


def sample_taxa(dists: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """The distances among k taxa, drawn by the hash of seed and taxon."""
    if k < 2:
        raise ValueError("a sample has two taxa at least")
    ids = _drawn(dists, seed).orderBy("draw").limit(k)
    side = lambda c: ids.select(F.col("id").alias(c))
    return dists.join(side("i"), "i", "left_semi").join(side("j"), "j", "left_semi").select(dists.columns)


def shuffle_taxa(dists: DataFrame, seed: int = 0) -> DataFrame:
    """(i, j, d) with the taxa's numbers dealt anew."""
    drawn = _drawn(dists, seed)
    to = ranked(drawn, [], [F.col("draw"), F.col("id")], "k").select("id", "k").join(ranked(drawn.select(F.col("id").alias("to")), [], [F.col("to")], "k"), "k")
    both = dists.join(to.select(F.col("id").alias("i"), F.col("to").alias("a")), "i").join(to.select(F.col("id").alias("j"), F.col("to").alias("b")), "j")
    return both.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "d")


def render_phylip(dists: DataFrame, labels: DataFrame, layout: str = "lower", fmt: str = "%.7e") -> DataFrame:
    """(row, line) of a PHYLIP text: row -1 holds the number of taxa, then a line for each taxon of labels (i, label) in order of i."""
    cells = {"lower": render_lower, "upper": render_upper, "full": render_full}[layout](dists, fmt)
    rows = ranked(labels.select("i", "label"), [], [F.col("i")], "row").join(cells, "i", "left")
    line = F.rtrim(F.concat(F.rpad(F.col("label"), F.greatest(F.length("label"), F.lit(10)), F.lit(" ")), F.lit(" "), F.coalesce("line", F.lit(""))))
    return rows.select("row", line.alias("line")).union(labels.agg(F.lit(-1).cast("long"), F.count("*").cast("string")))
