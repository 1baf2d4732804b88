"""Each operator against its brute-force version, over odd rows and clashing columns; empty tables; repeated rows and null ids."""

import math
import random
import re
import tracemalloc
from collections import defaultdict
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cladespark.llm import bytecnn, classlm, collocations, langid, licenses, mixing, packing, quality, search, setjoin, substring, urlfilter
from cladespark.llm.decontam import decontaminate, without_contaminated
from cladespark.llm.queries import tokenizer_path
from cladespark.llm.shared import components
from cladespark.llm.words import code_of

ITEMS = [(1, "one two"), (2, ""), (3, None), (11, "the very first line of an item that has more than ten words in it")]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_rules(docs, rows):
    got = by_id(quality.quality_rules(docs))
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        r = got[doc_id]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["n_words"], r["base_failed"]) == brute.base_statistics(text), text
        assert not (r["kept"] and r["base_failed"])


def test_quality_rules_reject_outliers_and_keep_clean(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["moon", "river", "stone", "walks", "under", "lamp"]) + str(rng.randrange(90)) for _ in range(n)) + "."
    rows = [(i, say(rng.randrange(40, 90)), "en", "a") for i in range(600)]
    rows += [(1000 + i, " ".join(f"$%&{rng.randrange(9999)}<|>##**" for _ in range(60)), "en", "a") for i in range(5)]
    got = by_id(quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert all(got[i]["kept"] for i in range(600))
    assert not any(got[i]["kept"] for i in range(1000, 1005))


def test_distances_of_quality_by_brute_force(spark):
    """The whole estimate in numpy, from the same statistics."""
    stats = quality.statistics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = stats.collect()
    want = brute.mahalanobis([(r["doc_id"], r["grp"], [r[f"f{i}"] for i in range(5)], r["base_failed"]) for r in rows], quality)
    got = by_id(quality.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    assert {i: r["distance"] for i, r in got.items()} == pytest.approx(want, rel=1e-6)
    assert all(r["kept"] == (not r["base_failed"] and r["distance"] <= quality.CUTOFF) for r in got.values())


def test_licenses(docs, rows):
    got = by_id(licenses.scan_licenses(docs))
    for doc_id, text, *_ in rows:
        r = got[doc_id]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.phrase_places(text, licenses.PHRASES)


def test_license_templates(spark):
    texts = ["Released under the MIT license. And the GNU General Public License, mit LICENSE", "Licensed under the Apache License, Version 2.0", "licensed under the GNU general public license version 3 or later", "licensed beneath the apache license 2.0", "permission is hereby denied", "an mit-license; mit  license"]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], got[i]["base_labels"]) == brute.phrase_places(t, licenses.PHRASES)
    assert [got[i]["labels"] for i in range(6)] == ["gpl,mit,mit-notice", "apache,apache-2.0", "gpl,gpl-3.0", "apache", "", "mit"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    with pytest.raises(ValueError):
        licenses.compile_template("x", "a [[ b")


def test_license_notices_and_versions(spark):
    plain = lambda label: re.sub(r"\{\{\d+\}\}", "The Authors", re.sub(r"\[\[.*?\]\]", "", licenses.TEMPLATES[label][0]))
    texts = [plain(x) for x in ("mit-text", "isc", "bsd-2-clause", "bsd-3-clause")] + ["Licensed under the GNU General Public License, version 2.1 of it", "Licensed under the Apache License, Version 2.0.\n7 files"]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [[x for x in got[i] if x in ("mit-text", "isc", "bsd-2-clause", "bsd-3-clause", "gpl-2.0")] for i in range(5)] == [["mit-text"], ["isc"], ["bsd-2-clause"], ["bsd-3-clause"], []]


def _peak(f) -> int:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_long_texts_by_parts():
    rng = np.random.default_rng(3)
    p = {"E": rng.normal(0, 1, (257, bytecnn.DEPTH)), "W": rng.normal(0, 1, (8 * bytecnn.DEPTH, bytecnn.FILTERS)), "b": rng.normal(0, 1, bytecnn.FILTERS)}
    for n in (0, 1, 8, 511, 512, 513, 1015, 1016, 1017, 1520, 1521, 9000):
        data = rng.integers(1, 255, n).astype(np.uint8)
        whole = bytecnn.features(*bytecnn.chunked(data, np.array([0, n])), 1, p)
        for limit in (1, 504, 1100, 5000):
            assert np.allclose(bytecnn.long_features(data, p, limit), whole, rtol=1e-5, atol=1e-5), (n, limit)
    for text in ("été дом 北京 Straße " * 40, "12 34 " * 60, "1 2 3 é", "1 2 3 4 5 6 7 北", "ab"):
        ((_, whole, ok),) = langid._vectors(pa.array([text]))
        for limit in (4, 5, 6, 7, 50):
            ((_, got, ok2),) = langid._vectors(pa.array([text]), limit)
            assert np.allclose(got, whole, atol=1e-6) and ok.tolist() == ok2.tolist(), (text, limit)


def test_memory_of_long_texts():
    text = np.frombuffer(b"some words of a long text, one after another. " * 90_000, np.uint8)
    small = {k: v.astype(np.float32) for k, v in {"E": np.ones((257, bytecnn.DEPTH)), "W": np.ones((8 * bytecnn.DEPTH, bytecnn.FILTERS)), "b": np.zeros(bytecnn.FILTERS)}.items()}
    assert _peak(lambda: bytecnn.long_features(text, small, bytecnn._RUN)) < 30e6
    assert _peak(lambda: langid._long(text, 1 << 20)) < 30e6


def test_license_headers_and_identifiers(spark):
    header = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; {} (at your option) any later version."
    want = {
        header.format("General Public License", "either version 3 of the License, or"): "gpl,gpl-3.0",
        header.format("General Public License", "either version 2 of the License, or"): "gpl,gpl-2.0",
        header.format("Lesser General Public License", "either version 2.1 of the License, or"): "gpl,lgpl,lgpl-2.1",
        header.format("Affero General Public License", "either version 3 of the License, or"): "agpl-3.0,gpl",
        "modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "gpl,gpl-2.0",
        header.format("General Public License", "either version 2.1 of the License, or"): "gpl",
        "// SPDX-License-Identifier: Apache-2.0": "apache-2.0",
        "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0",
        "SPDX-License-Identifier: MIT OR Apache-2.0\n": "apache-2.0,mit-spdx",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause-spdx",
        "This is free and unencumbered software released into the public domain.": "public-domain,unlicense",
        "The public domain is large; software placed in the domain": "",
    }
    texts = list(want)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {t: got[i]["labels"] for i, t in enumerate(texts)} == want
    for i, t in enumerate(texts):
        assert (got[i]["labels"], round(got[i]["score"], 9)) == brute.license_labels(t, licenses.PHRASES, licenses.TEMPLATES), t


def test_labels_and_scores_of_licenses_by_brute_force(docs, spark):
    """Templates as backtracking searches over word lists."""
    rng = random.Random(12)
    words = "licensed released under the terms of mit apache gnu general public license version 2 3 0 cc by sa 4 bsd style international open source".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += [f"so {rng.choice(words)} licensed under the {x} and more" for x in ("mit license", "terms of the mit open source license", "apache license 2 0", "gnu general public license version 3", "cc by sa 4 0 international license", "cc by 4 0")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["labels"], round(got[i]["score"], 9)) == brute.license_labels(t, licenses.PHRASES, licenses.TEMPLATES), t


def test_language_needs_a_letter(spark):
    texts = [" ".join(f"{a}{b}" for a in x for b in y) for x, y in (("abc", "defg"), ("uvw", "xyz"))] * 4
    rows = [(i, t, ("en", "tr")[i % 2]) for i, t in enumerate(texts)] + [(50, "\u00b2\u00bd \u00bc 12", "en"), (51, "\u65e5", None), (52, None, "en"), (53, "", "tr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, docs.where("doc_id < 50")).collect()}
    assert all(got[i] == ("und", 0.0) for i in (50, 52, 53)) and got[51][0] in ("en", "tr")
    assert [got[i][0] for i in range(8)] == ["en", "tr"] * 4


def test_predictions_by_brute_force(spark):
    """Features, duels and votes one by one, from the fitted machines."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, docs).collect()}
    assert got == {r["doc_id"]: (p, pytest.approx(v, abs=1e-3)) for r in docs.collect() for p, v in [brute.language(r["text"], model, langid.FEATURES)]}


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.held_out_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 .. 9"), (4, "the")], "doc_id long, text string")
    out = by_id(langid.identify(odd, docs))
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[4]["lang_pred"] != "und"


def test_class_lm(docs, rows):
    held = {r[0] for r in rows if brute.remainder(r[0], 7) == 2}
    want = brute.base_scores([r[:2] for r in rows], [r[1] for r in rows if r[0] not in held])
    got = by_id(classlm.held_out_scores(docs))
    for doc_id, *_ in rows:
        r = got[doc_id]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[doc_id][:3] and r["held_out"] == (doc_id in held)
        assert r["base_score"] == pytest.approx(want[doc_id][3], rel=1e-9) and r["score"] < 0


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(2)
    kind = np.arange(24) % 3
    pairs = rng.poisson(np.where((kind[:, None] + 1) % 3 == kind[None, :], 40, 1)).astype(float)
    cls = classlm.exchange(pairs, 24, 3, 6)

    def fit(c):
        one = np.eye(3)[c]
        both = one.T @ pairs @ one
        return classlm._xlogx(both).sum() - classlm._xlogx(both.sum(0)).sum() - classlm._xlogx(both.sum(1)).sum()

    shuffled = rng.permutation(kind)
    again = classlm.exchange(pairs[np.ix_(np.argsort(shuffled), np.argsort(shuffled))], 24, 3, 6)
    assert fit(cls) >= fit(shuffled) - 1e-6 and len(set(again)) == 3


@pytest.mark.parametrize("frequent", [40, 1 << 17])
def test_class_scores(spark, docs, rows, monkeypatch, frequent):
    """Every training word has a learned class, and scores are those of the plain model over these classes."""
    monkeypatch.setattr(classlm, "FREQUENT", frequent)
    monkeypatch.setattr(classlm, "SEEDS", 20)
    learned, seen = classlm._learned, []
    monkeypatch.setattr(classlm, "_learned", lambda *a: seen.append(learned(*a)) or seen[-1])
    train = docs.where("doc_id % 3 <> 0")
    got = {r["doc_id"]: r["score"] for r in classlm.score_texts(docs, train).collect()}
    texts = [r[1] for r in rows if r[0] % 3]
    word = {int(np.uint64(code_of(w)).astype(np.int64)): w for t in texts for w in brute.white(t, True)}
    word[int(classlm.END)] = None
    found = {word[r["h"]]: r for r in seen[0][0].collect()}
    assert len(found) == len(word) and all(r["cls"] < classlm.CLASSES for w, r in found.items() if w is not None)
    often = {w for w, r in found.items() if r["frequent"]}
    assert (len(often) < len(found)) == (frequent == 40)
    want = brute.class_scores([r[:2] for r in rows], texts, {w: r["cls"] for w, r in found.items()}, often, classlm.CLASSES, classlm.PSEUDO)
    assert got == pytest.approx(want, rel=1e-9)


def test_best_class_is_the_likeliest():
    rng = np.random.default_rng(4)
    pairs = rng.poisson(2, (12, 12)).astype(float)
    cls = np.arange(12) % 4
    fit = lambda c: classlm._fit(np.eye(4)[c].T @ pairs @ np.eye(4)[c])
    one = np.eye(4)[cls]
    got = classlm.best_classes(pairs @ one, pairs.T @ one, np.diag(pairs).copy(), cls, one.T @ pairs @ one, 3)
    for w in range(12):
        moved = [fit(np.where(np.arange(12) == w, c, cls)) for c in range(3)]
        assert moved[got[w]] >= max(moved) - 1e-9


def test_class_lm_beats_add_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = classlm.held_out_scores(docs).where("held_out").agg(F.sum("score").alias("a"), F.sum("base_score").alias("b")).first()
    assert got["a"] > got["b"]


def test_byte_cnn(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = bytecnn.held_out_quality(docs, labels)
    p = got.join(labels, "doc_id").where("held_out").toPandas()
    good, bad = p.score[p.quality == 1].to_numpy(), p.score[p.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.8
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_forward_pass_by_brute_force():
    rng = np.random.default_rng(3)
    p = {"E": rng.normal(0, 1, (257, bytecnn.DEPTH)), "W": rng.normal(0, 1, (8 * bytecnn.DEPTH, bytecnn.FILTERS)), "b": rng.normal(0, 1, bytecnn.FILTERS)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["E"][0] = 0
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 3, 511, 1300)]
    x, doc = bytecnn.chunked(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    got = bytecnn.features(x, doc, len(texts), p)
    for t, mine in zip(texts, got, strict=True):
        peaks = []
        for at in range(0, max(len(t) - (bytecnn.CHUNK - bytecnn.STEP), 1), bytecnn.STEP) if t else ():
            codes = [c + 1 for c in t[at : at + bytecnn.CHUNK]]
            codes += [0] * (bytecnn.CHUNK - len(codes))
            peaks.append(np.max([[max(0.0, float(np.concatenate([p["E"][c] for c in codes[i : i + 8]]) @ p["W"][:, f] + p["b"][f])) for f in range(bytecnn.FILTERS)] for i in range(0, bytecnn.CHUNK - 7, 4)], axis=0))
        want = np.concatenate((np.mean(peaks, 0), np.max(peaks, 0))) if peaks else np.zeros(2 * bytecnn.FILTERS)
        assert mine == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_chunks_cover_whole_texts():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 8, 511, 512, 513, 5000]
    data = rng.integers(0, 256, sum(sizes), dtype=np.uint8)
    off = np.concatenate(([0], np.cumsum(sizes)))
    x, doc = bytecnn.chunked(data, off)
    for i, n in enumerate(sizes):
        mine = x[doc == i]
        assert len(mine) == (0 if n == 0 else max(1, -(-(n - 8) // 504)))
        flat = [v for k, c in enumerate(mine) for v in (c[: bytecnn.STEP] if k < len(mine) - 1 else c)]
        assert [int(v) - 1 for v in flat if v] == data[off[i] : off[i + 1]].tolist()


def test_packing(docs, rows):
    import zlib

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    out = packing.pack(docs, tokenizer_path()).collect()
    pieces, seqs = {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == {r[0] for r in rows}
    for doc_id, text, *_ in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(pieces[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        at = 0
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()), text
            assert r["length"] == packing.LENGTH or r["piece"] == 0
            at += r["length"]
        assert at == len(ids)
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.LENGTH
    assert len(seqs) <= brute.best_fit([r["length"] for r in out], packing.LENGTH)


def test_ids_of_odd_texts():
    """Added tokens in a text, next to blanks and to each other, cut in two by the end of a text."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, mark * 2, f"x  {mark}  y", f"{mark}tail", "<|endof", "text|> no mark", f"é{mark}\n{mark} z ", "", f" {mark}", "< |endoftext|>", f"\u00a0 {mark} \u2003q"]
    got = dict(packing.encode(pa.array(texts), tokenizer_path()))
    assert [got[i].tolist() for i in range(len(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_sweep_is_best_fit():
    rng = random.Random(4)
    for _ in range(40):
        sizes = [rng.randrange(1, 65) for _ in range(rng.randrange(1, 80))]
        counts = {n: sizes.count(n) for n in sizes}
        room, total = {}, 0
        for size, _, n, seq, at in packing.sweep(counts, 64):
            for k in range(n):
                assert room.get(seq + k, 0) == at
                room[seq + k] = at + size
                total += 1
        assert total == len(sizes) and max(room.values()) <= 64 and len(room) <= brute.best_fit(sizes, 64)


def test_cascade_is_exact():
    keys = np.unique(np.random.default_rng(8).integers(0, 2**63, 30_000, dtype=np.int64)).view(np.uint64)
    for share in (0, 1, 3000, len(keys)):
        levels = urlfilter.cascade(keys[:share], keys[share:])
        assert (urlfilter.member(keys, levels) == (np.arange(len(keys)) < share)).all()


def test_cascade_ends_and_clashing_keys_are_told_apart(spark, monkeypatch):
    same = np.array([5], np.uint64)
    assert len(urlfilter.cascade(same, np.array([5, 6], np.uint64))) == urlfilter.LEVELS + 1
    monkeypatch.setattr(urlfilter.F, "xxhash64", lambda c: F.length(c).cast("long"))
    pages = spark.createDataFrame([(1, "http://ab.c/"), (2, "http://cd.c/"), (3, "http://abcdefg.c/")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.filter_urls(pages, spark.createDataFrame([("ab.c",), ("elsewhere.org",)], "key string")).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_url_filter_of_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?q", "http://example.net/de/8", "http://x.net/de/8#f", "http://ads.q.com/en", "http://q.com?/en/", "http://b.org/es/://c", "http://a\nb.org/es/\n", "http://notexample.com/en/7"]
    got = {r["page_id"]: r for r in urlfilter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(12)] == [None, None, None, None, "example.com/en/7", "example.net/de/8", "net/de/", None, None, "org/es/", "org/es/", "com/en/"]
    assert [got[i]["verdict"] for i in range(12)] == ["allow", "allow", "allow", "allow", "allow", "block", "allow", "block", "allow", "block", "block", "block"]
    assert (got[0]["host"], got[2]["path"], got[8]["path"], got[9]["path"]) == ("", "", "", "/es/://c")


def test_decontamination(spark, docs, rows):
    rng = random.Random(6)
    long = [r[1] for r in rows if len((r[1] or "").split()) > 50]
    items = ITEMS + [(20 + i, " ".join(rng.choice(long).upper().split()[5 : 5 + rng.choice((4, 10, 25))])) for i in range(8)]
    got = by_id(decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")))
    for doc_id, text, *_ in rows:
        r = got[doc_id]
        assert (r["n_words"], r["n_hit"], list(r["items"])) == brute.decontaminate(text, items)
        assert r["n_items"] == len(r["items"]) and r["contaminated"] == (r["n_hit"] > 0)


def test_decontamination_of_rows_that_repeat_an_id(spark):
    leak = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, leak + " and more", "en"), (1, "nothing to see", "en"), (None, leak, "x"), (None, None, "x")], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(7, leak)], "item_id long, text string")
    got = sorted((r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate(docs, items).collect())
    assert got == [(0, 0, False), (3, 0, False), (12, 12, True), (14, 12, True)]
    assert sorted(r["text"] or "" for r in without_contaminated(docs, items).collect()) == ["", "nothing to see"]


@pytest.mark.parametrize("name", ["jaccard", "substrings", "classlm", "decontam"])
def test_ids_of_text(name, docs, rows):
    """The same results by ids of another type with the same order."""
    text = docs.withColumn("doc_id", F.format_string("d%06d", "doc_id"))
    norm = lambda r: tuple(sorted((k, f"d{v:06d}" if k in ("doc_id", "component_id") and isinstance(v, int) else round(v, 6) if isinstance(v, float) else v) for k, v in r.asDict().items() if k != "held_out"))
    run = (lambda d: classlm.score_texts(d, d)) if name == "classlm" else OPERATORS[name][0]
    assert sorted(map(norm, run(text).collect()), key=str) == sorted(map(norm, run(docs).collect()), key=str)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard(docs, rows, k, percent):
    got = by_id(setjoin.jaccard_classes(docs, k, percent))
    want = brute.classes([r[:2] for r in rows], k, percent)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_keep_one(docs, rows):
    want = brute.classes([r[:2] for r in rows], 5, 80)
    got = setjoin.keep_one(docs)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_blocks_of_long_lists(docs, rows, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK_ROWS", 3)
    want = brute.classes([r[:2] for r in rows], 3, 70)
    assert {r["doc_id"]: r["component_id"] for r in setjoin.jaccard_classes(docs, 3, 70).collect()} == {i: c for i, (_, c) in want.items()}


@pytest.mark.parametrize("largest", [0, 1, 700, 2999])
def test_blocks_of_a_hot_list(spark, monkeypatch, largest):
    """One list of 3,000 sets, `largest` of one class and the others each of its own: no block is long, and each two sets of different classes meet once."""
    monkeypatch.setattr(setjoin, "BLOCK_ROWS", 256)
    comp = [0 if i < largest else i for i in range(3000)]
    rows = spark.createDataFrame([(1, 5, i, c, True) for i, c in enumerate(comp)], "tok long, size long, id long, comp long, home boolean")
    got = setjoin._dealt(rows).select("id", "sub", F.explode("cells").alias("blk")).collect()
    blocks, subs = defaultdict(list), {}
    for r in got:
        blocks[r["blk"]].append(r["id"])
        assert subs.setdefault(r["id"], r["sub"]) == r["sub"]
    assert max(map(len, blocks.values())) <= 2.6 * 256
    assert len(got) <= 3000 * (3000 / 256 + 2)
    met = np.zeros((3000, 3000), np.int8)
    for blk, ids in blocks.items():
        i, j = np.array(ids)[:, None], np.array(ids)[None, :]
        sub = np.array([subs[x] for x in ids])
        met[i, j] += (sub[:, None] != sub[None, :]) | (blk < 0)
    differ = np.array(comp)[:, None] != np.array(comp)[None, :]
    assert (met[differ] == 1).all()


def test_keep_one_of_rows_that_repeat_an_id(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(40)) for p in "ab")
    rows = [(5, a), (5, b), (5, a), (2, b + " x"), (None, a), (None, a), (9, ""), (9, "")]
    got = setjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(5, a), (2, b + " x"), (0, a), (0, a), (9, ""), (9, "")])


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {i: i for e in edges for i in e}
    for _ in range(200):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {i: c for i, c in low.items() if any(i in e and e[0] != e[1] for e in edges)}


def test_substrings(docs, rows):
    want = brute.kept_words([r[:2] for r in rows])
    got = by_id(substring.dedup_substrings(docs, digest=True))
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == {i: (n, n - len(k), brute.sha(" ".join(k))) for i, (n, k) in want.items()}
    assert any(n > len(k) for n, k in want.values())
    left = by_id(substring.remove_repeats(docs))
    texts = {r[0]: r[1] for r in rows}
    assert left.keys() == {i for i, (n, k) in want.items() if k or not n}
    assert all(r["text"] == (texts[i] if len(want[i][1]) == want[i][0] else " ".join(want[i][1])) for i, r in left.items())


def test_substrings_of_rows_that_repeat_an_id(spark):
    """A row that shares its id with a copy, or with a row of repeated words, loses nothing that occurs once."""
    say = lambda a, n: [f"{a}{i}" for i in range(n)]
    t = say("t", 30)
    rows = [(1, t), (5, t), (5, say("s", 6)), (5, say("u", 55)), (5, say("v", 5) + t + say("w", 20)), (7, say("u", 40)), (7, say("u", 40)), (9, say("x", 40)), (9, say("x", 40)), (None, t)]
    rows = [(i, " ".join(w)) for i, w in rows]
    order = dict(zip([r[1] for r in rows], [r[0] for r in spark.createDataFrame([(r[1],) for r in rows], "text string").select(F.xxhash64("text")).collect()], strict=True))
    distinct = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], order[r[1]]))
    left = brute.kept_words(list(enumerate(t for _, t in distinct)))
    want = {r: " ".join(left[k][1]) for k, r in enumerate(distinct)} | {r: r[1] for r in rows if r[0] is None}
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n_words int, _row string")
    got = substring.dedup_substrings(docs.repartition(3)).collect()
    assert sorted(str((r["doc_id"], r["kept"])) for r in got) == sorted(str((r[0], want[r])) for r in rows)
    kept = substring.remove_repeats(docs.repartition(3)).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in kept) == sorted(str((r[0], want[r])) for r in rows if want[r])
    assert (5, " ".join(say("s", 6))) in [(r["doc_id"], r["text"]) for r in kept]


@pytest.mark.parametrize("kind", ["long", "tinyint", "string", "decimal(30,2)", "double"])
def test_substrings_of_other_ids(spark, kind):
    """Ids below zero, far apart or of another type keep their order, and a short text's id may lie outside the others'."""
    say = lambda a, n: [f"{a}{i}" for i in range(n)]
    texts = [say("p", 6) + say("t", 30), say("t", 30) + say("u", 40), say("q", 3) + say("u", 40), say("r", 25) + say("t", 25) + say("t", 30), say("s", 4), say("t", 30)]
    for ids in [(3, -7, 5, 4, -100, 100), *([(2**63 - 1, -(2**63), 0, 5, -5, 9), (7, -1, 2**33 - 2, 5, -(2**63), 6)] if kind == "long" else [])]:
        docs = spark.createDataFrame([(str(i), " ".join(w)) for i, w in zip(ids, texts, strict=True)], "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(3)
        rows = sorted((tuple(r) for r in docs.collect()))
        want = brute.kept_words(rows)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.dedup_substrings(docs).collect()}
        assert got == {i: (n, n - len(k), " ".join(k)) for i, (n, k) in want.items()}
        assert sum(n > len(k) for n, k in want.values()) >= 3


def test_spans_of_runs(monkeypatch):
    """Windows that are no first places are merged by document, whatever rows are worked at a time."""
    rng = random.Random(5)
    for step in (1, 7, 40, 1000):
        monkeypatch.setattr(substring, "_STEP", step)
        rows, want = [], {}
        for doc in range(60):
            live = sorted({a + i for a in rng.sample(range(60), rng.randrange(1, 4)) for i in range(rng.randrange(1, 12))})
            first = [x for x in live if rng.random() < (0, 0.3, 0.9, 1)[doc % 4]]
            lo, hi = [x for x in live if x - 1 not in live], [x + 1 for x in live if x + 1 not in live]
            rows.append({"doc": doc, "lo": lo, "hi": hi, "firsts": rng.sample(first, len(first)) if first else None})
            covered = {p for x in live if x not in first for p in range(x, x + 4)}
            if covered:
                want[doc] = covered
        schema = pa.schema([("doc", pa.int64()), *((c, pa.list_(pa.int32())) for c in ("lo", "hi", "firsts"))])
        batches = [pa.RecordBatch.from_pylist(rows, schema).slice(0, 23), pa.RecordBatch.from_pylist(rows, schema).slice(23)]
        got = [r for b in substring._spans(4)(iter(batches)) for r in b.to_pylist()]
        assert {r["doc"]: {p for x in r["spans"] for p in range(x["start"], x["end"])} for r in got} == want
        assert len(got) == len(want) and all(a["end"] < b["start"] for r in got for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_substrings_take_little_disk(spark, monkeypatch, tmp_path):
    """Of texts whose windows occur twice each, with joins as on large tables: what is shuffled and written, in bytes of text."""
    say = lambda a: " ".join(f"w{a}-{i}" for i in range(300))
    rows = [(2 * a + b, say(a) + f" end{b}") for a in range(600) for b in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    shuffled = lambda: sum(x.shuffleWriteBytes() for x in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())))
    tables, write = [], substring.stash

    def noted(df, name="part"):
        out = write(df, name)
        tables.append(sum(p.stat().st_size for p in Path(out._scratch_path.removeprefix("file:")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(substring, "stash", noted)
    before, limit = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        copies, spans = substring.repeats(spark.read.parquet(str(tmp_path / "docs")))
        made = shuffled() - before
        assert spans.count() == 600 and not copies.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    size = sum(len(t) for _, t in rows)
    assert 0 < made + sum(tables) < 4 * size, (made, tables, size)


def test_class_lm_of_blank_slices(spark):
    """Partitions of null and empty texts only, before and after the training fold."""
    docs = spark.createDataFrame([(i, "one two three" if i == 40 else (None, "", " \n")[i % 3]) for i in range(41)], "doc_id long, text string").repartitionByRange(4, "doc_id")
    got = by_id(classlm.score_texts(docs, docs))
    assert len(got) == 41 and all(r["n_tokens"] == (4 if i == 40 else 1) and math.isfinite(r["score"]) for i, r in got.items())
    assert len(by_id(classlm.score_texts(docs.where("doc_id < 40"), docs.where("doc_id < 40")))) == 40


OPERATORS = {
    "quality": (quality.quality_rules, 0),
    "licenses": (licenses.scan_licenses, 0),
    "langid": (langid.held_out_predictions, 0),
    "classlm": (classlm.held_out_scores, 0),
    "bytecnn": (lambda d: bytecnn.held_out_quality(d, d.select("doc_id", F.lit(1).alias("quality"))), 0),
    "packing": (lambda d: packing.pack(d, tokenizer_path()), 0),
    "urlfilter": (lambda d: urlfilter.filter_urls(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"))), 0),
    "decontam": (lambda d: decontaminate(d, d.sparkSession.createDataFrame(ITEMS, "item_id long, text string")), 0),
    "no_items": (lambda d: decontaminate(d, d.sparkSession.createDataFrame([], "item_id long, text string")), 0),
    "jaccard": (setjoin.jaccard_classes, 0),
    "keep_one": (setjoin.keep_one, 0),
    "substrings": (substring.dedup_substrings, 0),
    "remove_repeats": (substring.remove_repeats, 0),
    "shares": (mixing.shares, 0),
    "mixed": (mixing.mixed, 0),
    "collocations": (collocations.collocations, 0),
    "search": (lambda d: search.search(d, d.sparkSession.createDataFrame(ITEMS, "item_id long, text string")), 0),
    "no_queries": (lambda d: search.search(d, d.sparkSession.createDataFrame([], "item_id long, text string")), 0),
}
#: Operators whose rows aren't those of the input.
OTHER_ROWS = {"mixed", "collocations", "search", "no_queries"}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, nothing):
    assert OPERATORS[name][0](nothing).count() == 0


@pytest.mark.parametrize("name", [x for x in OPERATORS if x not in OTHER_ROWS])
def test_repeated_rows_and_null_ids(name, spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, "one two and more words than ten are in this short text"), (None, text), (None, None), (3, "")]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = OPERATORS[name][0](docs).collect()
    key = "page_id" if name == "urlfilter" else "doc_id"
    ids = sorted(str(r[key]) for r in got)
    assert ids == sorted(str(r[0]) for r in (rows[1:] if name == "keep_one" else rows))
