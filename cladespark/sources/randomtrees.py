"""Random trees, by attaching one taxon after another to an edge drawn uniformly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .newick import render


def draw(taxa: list[str], rng: np.random.Generator, rooted: bool = False) -> str:
    """Newick text of one tree; its root has two branches if rooted, else three."""
    first = 2 if rooted else 3
    rows = [[0, None, 0, None, 0.0, not taxa], *([k + 1, 0, k, t, 0.0, True] for k, t in enumerate(taxa[:first]))]
    for t in taxa[first:]:
        # a rooted tree's root has an edge of its own above it, an unrooted one's has none
        at = int(rng.integers(0 if rooted else 1, len(rows)))
        below, n = rows[at], len(rows)
        mid = [n, below[1], below[2], None, 0.0, False]
        below[1], below[2] = n, 0
        rows += [mid, [n + 1, n, 1, t, 0.0, True]]
    return render([tuple(r) for r in rows] if taxa else [])


def random_trees(spark: SparkSession, count: int, taxa: list[str], seed: int, rooted: bool = False) -> DataFrame:
    """(tree_id, newick) of count trees, each drawn from its own seed, so that a repeated task gives the same trees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"tree_id": pdf["id"], "newick": [draw(taxa, np.random.default_rng([seed, k]), rooted) for k in pdf["id"]]})

    return spark.range(count).mapInPandas(run, "tree_id long, newick string")
