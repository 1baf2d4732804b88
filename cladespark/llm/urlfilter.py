"""URL filter by a cascade of Bloom filters over the corpus's complete key universe.

Level 0 holds the listed keys. Level 1 holds the keys of the universe that level 0 takes
for listed though they aren't; level 2 the listed keys that level 1 takes for false, and
so on until a level has no false positive. For any key of the universe the first level
that misses it tells exactly whether it is listed, without a join.

Keys are dealt to shards by hash, so that each shard's cascade is built by one small task,
however many keys there are; the shards travel to the tasks in groups of at most
GROUP_BYTES, each group in a step of its own over the rows.

Listed keys come as a table. Keys go into filters by 64-bit hashes with a salt for each
level; the few keys of a hash that another key has too are told apart by their text, and
after LEVELS filters what is still open is listed by its hashes, so building always ends.

Keys are hosts with all their parent domains. Null url, or one without `://`: empty host
and path, and never listed. Repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .shared import stash

#: Fixed rules: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: A host is listed if one of its labels is one of these.
LISTED_LABELS = ("ads-track", "ads", "adserver", "tracker", "doubleclick", "malware", "phishing")
SHARD_KEYS, GROUP_BYTES, BITS_PER_KEY = 1 << 18, 64 << 20, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def domains(host: Column) -> Column:
    """A host and its parent domains."""
    parts = F.split(host, r"\.")
    return F.when(F.length(host) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))


#: Levels of Bloom filters after which what is still open is listed by its hashes.
LEVELS = 48


def _places(h: np.ndarray, level: int, bits: int) -> list[np.ndarray]:
    """Three places of each key in a filter of so many bits, other ones at each level."""
    x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    y = (x * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    return [((x + np.uint64(i) * y) >> np.uint64(7)) % np.uint64(bits) for i in range(3)]


def _in(h: np.ndarray, level: int, table: np.ndarray) -> np.ndarray:
    """Whether a level holds keys: by its bits, or exactly where it is the list after the last filter."""
    if level >= LEVELS:
        return np.isin(h, table.view(np.uint64))
    ok = np.ones(len(h), bool)
    for p in _places(h, level, len(table) * 8):
        ok &= (table[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


def cascade(listed: np.ndarray, others: np.ndarray) -> list[np.ndarray]:
    """Levels of bit tables over key hashes, which no listed and other key share; the last has no false positive."""
    levels: list[np.ndarray] = []
    inside, outside = listed, others
    while len(inside):
        if len(levels) == LEVELS:
            levels.append(np.sort(inside).view(np.uint8))
            break
        table = np.zeros(max(1, -(-len(inside) * BITS_PER_KEY // 8)), np.uint8)
        for p in _places(inside, len(levels), len(table) * 8):
            np.bitwise_or.at(table, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        levels.append(table)
        inside, outside = outside[_in(outside, len(levels) - 1, table)], inside
    return levels


def member(h: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Whether keys of the universe are listed: the parity of the first level that misses them."""
    out, open_ = np.zeros(len(h), bool), np.arange(len(h))
    for k, table in enumerate(levels):
        hit = _in(h[open_], k, table)
        out[open_[~hit]] = k % 2 == 1
        open_ = open_[hit]
    out[open_] = len(levels) % 2 == 1
    return out


def _build(pdf):
    h, listed = pdf["h"].to_numpy(np.int64).view(np.uint64), pdf["listed"].to_numpy(bool)
    levels = cascade(h[listed], h[~listed])
    return pd.DataFrame({"shard": int(pdf["shard"].iloc[0]), "level": range(len(levels)), "bits": [x.tobytes() for x in levels]})


def build_cascade(universe: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Levels (shard, level, bits, shards), and the keys (key, h, listed) whose hashes are no key's alone, from the universe's and the listed keys, each one column key."""
    keys = universe.where("key is not null").select("key").distinct()
    keys = keys.join(listed.select("key").distinct().withColumn("listed", F.lit(True)), "key", "left")
    known = stash(keys.select("key", F.xxhash64("key").alias("h"), F.coalesce("listed", F.lit(False)).alias("listed")), "keys")
    shared = known.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    clashes = stash(known.join(shared, "h").select("key", "h", "listed"), "keys")
    shards = max(1, -(-known.count() // SHARD_KEYS))
    rows = known.join(F.broadcast(clashes.select("h").distinct()), "h", "left_anti").withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    out = rows.select("h", "listed", "shard").groupBy("shard").applyInPandas(_build, "shard int, level int, bits binary")
    return stash(out.withColumn("shards", F.lit(shards)), "cascade"), clashes


def _member(group, shards: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = group.value
        for batch in batches:
            lists = batch.column("keys_h")
            off = lists.offsets.to_numpy()
            h = lists.values.to_numpy(zero_copy_only=False)
            hit = np.zeros(len(h), bool)
            shard = h % shards
            for s in np.unique(shard).tolist():
                if s in tables:
                    at = shard == s
                    hit[at] = member(h[at].view(np.uint64), tables[s])
            found = np.concatenate(([0], np.cumsum(hit)))
            got = (found[off[1:]] > found[off[:-1]]) | batch.column(column).to_numpy(zero_copy_only=False)
            cols = [pa.array(got) if n == column else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return run


def with_membership(rows: DataFrame, levels: DataFrame, clashes: DataFrame, keys: Column, column: str = "listed") -> DataFrame:
    """rows with a boolean: one of their keys is listed. Every key must be of the universe."""
    sc = rows.sparkSession.sparkContext
    sizes = levels.groupBy("shard").agg(F.sum(F.length("bits")).alias("n"), F.max("shards").alias("shards")).orderBy("shard").collect()
    groups, room = [[]], 0
    for r in sizes:  # a few numbers for each 2**18 keys
        if room + r["n"] > GROUP_BYTES and groups[-1]:
            groups.append([])
            room = 0
        groups[-1].append(r["shard"])
        room += r["n"]
    # Keys that share a 64-bit hash are few (some thousands among 10**12 keys) and told apart by their text.
    odd = clashes.collect()
    here, plain = F.lit(False), lambda k: F.lit(True)
    if odd:
        here = F.arrays_overlap(keys, F.array(*[F.lit(r["key"]) for r in odd if r["listed"]]).cast("array<string>"))
        plain = lambda k: ~k.isin([r["key"] for r in odd])
    out = rows.withColumn("keys_h", F.transform(F.filter(keys, plain), lambda k: F.xxhash64(k))).withColumn(column, here)
    shards = sizes[0]["shards"] if sizes else 1
    for g in groups if sizes else []:
        tables: dict[int, list] = {}
        for r in levels.where(F.col("shard").between(g[0], g[-1])).orderBy("shard", "level").toLocalIterator():
            tables.setdefault(r["shard"], []).append(np.frombuffer(r["bits"], np.uint8))
        out = out.mapInArrow(_member(sc.broadcast(tables), shards, column), out.schema)
    return out.drop("keys_h")


def universe_of(pages: DataFrame) -> DataFrame:
    """key: every host of pages and its parent domains."""
    host, _ = host_and_path("url")
    return pages.select(host.alias("host")).distinct().select(F.explode(domains(F.col("host"))).alias("key")).distinct()


def labelled(universe: DataFrame, labels=LISTED_LABELS) -> DataFrame:
    """A list of keys for the cascade: those of the universe that have one of these labels."""
    return universe.where(F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, labels))))


def filter_urls(pages: DataFrame, listed: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages; listed: the table of listed keys, hosts or domains, in a column key (none: those of LISTED_LABELS)."""
    ship(pages.sparkSession)
    universe = stash(universe_of(pages), "keys")
    levels, clashes = build_cascade(universe, labelled(universe) if listed is None else listed)
    host, path = host_and_path("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = with_membership(rows, levels, clashes, domains(F.col("host")))
    fits = lambda h, p: ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = lambda what: reduce(lambda out, r: out.when(fits(r[1], r[2]), what(r)), ordered, F.when(F.lit(False), F.lit(None).cast("string")))
    out = rows.withColumn("rule", pick(lambda r: F.lit(r[1] + r[2]))).withColumn("by_rule", pick(lambda r: F.lit(r[0])))
    verdict = F.coalesce("by_rule", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
