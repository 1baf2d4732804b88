"""Newick text to node rows and back."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

_TOKEN = re.compile(r"\s+|[(),;:]|'(?:[^']|'')*'|[^\s()\[\]':;,]+")
_LENGTH = re.compile(r"[-+]?\d+(\.\d+)?([eE][-+]?\d+)?")
#: Rows of a batch of nodes.
CHUNK = 1 << 14
NODES = "node_id int, parent_id int, ord int, taxon string, length double, is_leaf boolean"


def _tokens(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        if text[at] == "[":
            depth, start = 0, at
            while at < len(text):
                depth += {"[": 1, "]": -1}.get(text[at], 0)
                at += 1
                if not depth:
                    break
            if depth:
                raise ValueError(f"a comment from {start} on isn't closed")
            continue
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at]!r} at {at}")
        if not m[0].isspace():
            yield m[0]
        at = m.end()


def walk(text: str) -> Iterator[tuple[int, int | None, int, str | None, float, bool]]:
    """The rows of parse(), each when its node ends, so that only the open nodes are held: a child comes before its parent, the root last."""
    toks = _tokens(text)
    t, before, made = next(toks, None), None, 1
    here: list = [0, None, 0, None, 0.0, True]
    stack: list[list] = []
    if t == ";":
        if next(toks, None) is not None:
            raise ValueError("unbalanced or trailing text")
        return
    while True:
        if t == "(":
            if here[3] is not None or not here[5] or before == ")":
                raise ValueError("unexpected '('")
            here[5] = False
            stack.append(here)
            here = [made, here[0], 0, None, 0.0, True]
            made += 1
        elif t in (",", ")"):
            if not stack:
                raise ValueError(f"unexpected {t!r}")
            yield tuple(here)
            if t == ",":
                here = [made, stack[-1][0], here[2] + 1, None, 0.0, True]
                made += 1
            else:
                here = stack.pop()
        elif t == ":":
            t = next(toks, None)
            if t is None or not _LENGTH.fullmatch(t):
                raise ValueError("a length is expected after ':'")
            here[4] = float(t)
        elif t == ";":
            if stack or next(toks, None) is not None:
                raise ValueError("unbalanced or trailing text")
            yield tuple(here)
            return
        elif t is None:
            raise ValueError("';' is missing")
        elif here[3] is not None:
            raise ValueError(f"unexpected label {t!r}")
        else:
            here[3] = t[1:-1].replace("''", "'") if t.startswith("'") else t.replace("_", " ")
        before, t = t, next(toks, None)


def parse(text: str) -> list[tuple[int, int | None, int, str | None, float, bool]]:
    """Rows (node, parent, place among siblings, taxon, length, is a leaf), the root first. A missing length is 0."""
    return sorted(walk(text))


def label(name: str | None) -> str:
    if name is None:
        return ""
    return "'" + name.replace("'", "''") + "'" if re.search(r"[_()\[\]':;,]", name) else name.replace(" ", "_")


def render(rows, lengths: bool = False, fmt: str = "%.7e") -> str:
    """Newick text of node rows."""
    rows = list(rows)
    column = lambda k, kind, none: np.fromiter((none if r[k] is None else r[k] for r in rows), kind, len(rows))
    return render_columns(column(0, np.int64, 0), column(1, np.int64, -1), column(2, np.int64, 0), [r[3] for r in rows], column(4, float, 0.0), lengths, fmt)


def render_columns(node: np.ndarray, parent: np.ndarray, place: np.ndarray, taxon, length: np.ndarray, lengths: bool = False, fmt: str = "%.7e") -> str:
    """Newick text of columns of nodes; the root's parent is -1. Beside them it holds whole numbers and the text. taxon may be any sequence, such as an Arrow array's values one at a time."""
    n = len(node)
    if not n:
        return ";"
    by = np.argsort(node, kind="stable")
    up = np.where(parent < 0, -1, by[np.minimum(np.searchsorted(node, parent, sorter=by), n - 1)])
    kids = np.lexsort((place, up))  # nodes by parent and place; roots first
    first = np.searchsorted(up[kids], np.arange(n), "left")
    last = np.searchsorted(up[kids], np.arange(n), "right")
    after = np.full(n, -1)  # the next sibling
    same = up[kids[1:]] == up[kids[:-1]]
    after[kids[:-1][same]] = kids[1:][same]
    out = io.StringIO()
    root = at = int(kids[0])
    while True:
        while first[at] < last[at]:
            out.write("(")
            at = int(kids[first[at]])
        while True:
            if first[at] < last[at]:
                out.write(")")
            out.write(label(taxon[at]))
            if lengths and up[at] >= 0:
                out.write(":" + fmt % length[at])
            if at == root:
                out.write(";")
                return out.getvalue()
            if after[at] >= 0:
                out.write(",")
                at = int(after[at])
                break
            at = int(up[at])


def nodes(trees: DataFrame) -> DataFrame:
    """(tree_id, node columns) of (tree_id, newick)."""

    kind = trees.schema["tree_id"].dataType.simpleString()
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_()]
    names = [c.split()[0] for c in NODES.split(", ")]

    def run(batches):
        for batch in batches:
            for t, text in zip(batch.column("tree_id"), batch.column("newick"), strict=True):
                rows = walk(text.as_py())
                while part := list(islice(rows, CHUNK)):
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(part), t.type), *map(pa.array, zip(*part, strict=True), types)], names=["tree_id", *names])

    ship(trees.sparkSession)
    return trees.select("tree_id", "newick").mapInArrow(run, f"tree_id {kind}, {NODES}")


def splits(trees: DataFrame) -> DataFrame:
    """(tree_id, split, length) of each inner edge of (tree_id, newick): taxa in alphabetical order, the first taxon's side 0."""

    def run(batches):
        for pdf in batches:
            out = []
            for t, text in zip(pdf["tree_id"], pdf["newick"], strict=True):
                rows = parse(text)
                taxa = {x: i for i, x in enumerate(sorted(r[3] for r in rows if r[5] and r[3] is not None))}
                below = {r[0]: {taxa[r[3]]} if r[5] and r[3] is not None else set() for r in rows}
                for r in reversed(rows):
                    if r[1] is not None:
                        below[r[1]] |= below[r[0]]
                found: dict = {}
                for r in rows:
                    side = below[r[0]]
                    if 0 in side:
                        side = set(range(len(taxa))) - side
                    if r[1] is not None and 1 < len(side) < len(taxa) - 1:
                        s = "".join("1" if i in side else "0" for i in range(len(taxa)))
                        found[s] = found.get(s, 0.0) + r[4]  # both edges at a root of two are one
                out += [(t, s, v) for s, v in found.items()]
            yield pd.DataFrame(out, columns=["tree_id", "split", "length"])

    ship(trees.sparkSession)
    return trees.select("tree_id", "newick").mapInPandas(run, f"tree_id {trees.schema['tree_id'].dataType.simpleString()}, split string, length double")


def rewrite(trees: DataFrame, how, lengths: bool = True, fmt: str = "%g") -> DataFrame:
    """(tree_id, newick) with each tree's node rows passed through how; a map, as a tree is one row."""

    def run(batches):
        for batch in batches:
            for t, text in zip(batch.column("tree_id"), batch.column("newick"), strict=True):
                new = render(how(parse(text.as_py())), lengths, fmt)
                yield pa.RecordBatch.from_arrays([pa.array([t.as_py()], t.type), pa.array([new], pa.string())], names=["tree_id", "newick"])

    ship(trees.sparkSession)
    return trees.select("tree_id", "newick").mapInArrow(run, f"tree_id {trees.schema['tree_id'].dataType.simpleString()}, newick string")


def texts(rows: DataFrame, lengths: bool = True, fmt: str = "%g") -> DataFrame:
    """(tree_id, newick) of node rows (tree_id, node_id, parent_id, ord, taxon, length): the inverse of nodes(). A text is one row, so a tree's nodes are gathered once."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                own = batch.column("rows").slice(k, 1).flatten()
                cell = lambda c, none: own.field(names.index(c)).fill_null(none).to_numpy(zero_copy_only=False)
                new = render_columns(cell("node_id", 0), cell("parent_id", -1), cell("ord", 0), _Values(own.field(names.index("taxon"))), cell("length", 0.0), lengths, fmt)
                yield pa.RecordBatch.from_arrays([batch.column("tree_id").slice(k, 1), pa.array([new], pa.string())], names=["tree_id", "newick"])

    names = ["node_id", "parent_id", "ord", "taxon", "length"]
    ship(rows.sparkSession)
    whole = rows.groupBy("tree_id").agg(F.collect_list(F.struct(*names)).alias("rows"))
    return whole.mapInArrow(run, f"tree_id {rows.schema['tree_id'].dataType.simpleString()}, newick string")


class _Values:
    """An Arrow array read one value at a time."""

    def __init__(self, column: pa.Array):
        self.column = column

    def __getitem__(self, k: int):
        return self.column[k].as_py()
