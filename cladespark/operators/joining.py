"""Neighbor joining, full and relaxed: one grouped task for each (dataset, replicate) matrix."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship
from ..sources.newick import label

#: Two float32 distances within so many units in the last place are equal.
ULPS = 127


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = (np.asarray(v, np.float32).view(np.int32).astype(np.int64) for v in (a, b))
    x, y = (np.where(v < 0, -(v & 0x7FFFFFFF), v) for v in (x, y))
    return np.abs(x - y) <= ULPS


class _Matrix:
    """A shrinking distance matrix: a new node takes slot x, the first row moves into slot y, and the first slot goes. Row sums are kept up to date."""

    def __init__(self, d: np.ndarray, labels: list[str]):
        self.all = d.astype(np.float32)
        self.sums = self.all.sum(1)
        self.labels = list(labels)
        self.base = 0

    @property
    def d(self) -> np.ndarray:
        return self.all[self.base :, self.base :]

    @property
    def names(self) -> list[str]:
        return self.labels[self.base :]

    def __len__(self) -> int:
        return len(self.all) - self.base

    def share(self) -> np.ndarray:
        return self.sums[self.base :] / np.float32(max(len(self) - 2, 1))

    def q(self) -> np.ndarray:
        r = self.share()
        out = r[:, None] + r[None, :]
        np.subtract(self.d, out, out=out)
        np.fill_diagonal(out, np.inf)
        return out

    def row(self, x: int) -> np.ndarray:
        """q of one row."""
        r = self.share()
        out = self.d[x] - (r[x] + r)
        out[x] = np.inf
        return out

    def lengths(self, x: int, y: int) -> tuple[float, float]:
        r = self.share()
        a = (self.d[x, y] + r[x] - r[y]) / np.float32(2)
        return a, self.d[x, y] - a

    def join(self, x: int, y: int) -> None:
        a, b = self.lengths(x, y)
        d, names, r = self.d, self.labels, self.sums[self.base :]
        new = ((d[x] - a) + (d[y] - b)) / np.float32(2)
        new[[x, y]] = 0
        r += new - d[x] - d[y]
        r[x] = new.sum()
        names[self.base + x] = f"({names[self.base + x]}:{a:.6g},{names[self.base + y]}:{b:.6g})"
        d[x], d[:, x] = new, new
        d[y], d[:, y] = d[0], d[:, 0]
        d[y, y] = 0
        r[y], names[self.base + y] = r[0], names[self.base]
        self.base += 1

    def close(self) -> str:
        if len(self) == 1:
            return f"{self.names[0]};"
        a, b = self.names
        d = self.d[0, 1]
        return f"({a}:{d:.6g},{b[1:-1]});" if b.startswith("(") else f"({b}:{d:.6g},{a[1:-1]});" if a.startswith("(") else f"({a}:{d:.6g},{b}:0);"


def neighbor_joining(d: np.ndarray, labels: list[str], rng: np.random.Generator | None = None) -> str:
    """Newick text; ties go to the first pair in row order, or to a uniform one with rng."""
    m = _Matrix(d, [label(x) for x in labels])
    while len(m) > 2:
        q = m.q()
        x, y = divmod(int(q.argmin()), len(q))  # q is symmetric: its first least cell lies above the diagonal
        if rng is not None:
            least = float(q[x, y])
            i, j = np.nonzero(q <= least + abs(least) * 4e-5 + 1e-37)  # all that may be equal, and few more
            i, j = i[i < j], j[i < j]
            equal = np.flatnonzero(_same(q[i, j], q[x, y]))
            k = int(rng.choice(equal))
            x, y = int(i[k]), int(j[k])
        m.join(*((y, x) if x == 0 else (x, y)))  # the first row is about to move: the new node goes to the other slot
    return m.close()


def relaxed_joining(d: np.ndarray, labels: list[str], rng: np.random.Generator | None = None, additive: bool = True) -> str:
    return relaxed(d, labels, rng, additive)[0]


def relaxed(d: np.ndarray, labels: list[str], rng: np.random.Generator | None = None, additive: bool = True) -> tuple[str, bool]:
    """Newick text, and whether the matrix passed for additive to the end.

    Joins any pair that is closest for both of its members, instead of the closest of all,
    and goes on from the row of the join: a row costs its length, not the whole matrix.
    While the matrix is taken to be additive, a pair must also keep its distances to
    another node consistent; the first pass without a join ends that.
    """
    m = _Matrix(d, [label(x) for x in labels])

    def closest(x: int) -> int | None:
        row = m.row(x)
        y = int(row.argmin())
        least = m.row(y).min()
        if not (row[y] <= least or _same(row[y], least)):
            return None
        if additive:
            z = next(k for k in range(len(m)) if k not in (x, y))
            a, b = m.lengths(x, y)
            new = ((m.d[x, z] - a) + (m.d[y, z] - b)) / np.float32(2)
            if not _same(new + a, m.d[x, z]):
                return None
        return y

    while len(m) > 2:
        joined, x, order = False, 0, None if rng is None else list(rng.permutation(len(m)))
        while len(m) > 2 and (x < len(m) if order is None else order):
            at = x if order is None else int(order.pop())
            y = closest(at)
            if y is None:
                x += 1
                continue
            joined = True
            m.join(*((y, at) if at == 0 else (at, y)))
            if order is None:
                x = max(x - 1, 0)  # the first slot went: the same row, or the one before it
            else:
                order = [k - 1 for k in order if k not in (0, at, y)]  # slots that moved wait for the next pass
        if not joined:
            additive = False
    return m.close(), additive


def trees(dists: DataFrame, kind: str = "nj", keys: tuple[str, ...] = ("dataset", "replicate"), seed: int | None = None) -> DataFrame:
    """(keys, newick, and for relaxed joining additive) of distances (keys, i, j, d with i < j): every matrix is a group of its own, so replicates run over the cluster.

    A group is one whole matrix: for 10,000 taxa 400 MB, and as much again while a join looks at all pairs. blockjoin has a form for larger ones.
    """
    ship(dists.sparkSession)
    how = {"nj": neighbor_joining, "rnj": relaxed}[kind]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate((pdf["i"], pdf["j"])))
        d = np.zeros((len(ids), len(ids)), np.float32)
        a, b = np.searchsorted(ids, pdf["i"]), np.searchsorted(ids, pdf["j"])
        d[a, b] = d[b, a] = pdf["d"]
        rng = None if seed is None else np.random.default_rng([seed, *[zlib.crc32(str(k).encode()) for k in key]])
        got = how(d, [str(x) for x in ids], rng)
        return pd.DataFrame([[*key, *([got] if kind == "nj" else got)]], columns=[*keys, *out])

    out = ["newick"] if kind == "nj" else ["newick", "additive"]
    schema = ", ".join(f"{k} {dists.schema[k].dataType.simpleString()}" for k in keys) + ", newick string" + (", additive boolean" if kind == "rnj" else "")
    return dists.groupBy(*keys).applyInPandas(run, schema)
