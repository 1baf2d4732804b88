"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WHITE, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def white(text, lower=False):
    text = text or ""
    return WHITE.findall(text.translate(_LOWER) if lower else text)


def alnum(text):
    return ALNUM.findall((text or "").translate(_LOWER))


def remainder(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def base_statistics(text):
    """word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words, base_failed."""
    text = text or ""
    w = white(text)
    lines = [x for x in text.split("\n") if WHITE.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(grams)
    hit = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len("".join(w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w), failed


def mahalanobis(rows, q):
    """{id: squared robust distance} of (id, group, statistics, failed) by the settings of the module q."""
    import numpy as np

    floors, p = np.array(q.FLOORS), len(q.FLOORS)

    def edge(values, share, bins):
        at, n = np.unique(np.floor(values * bins), return_counts=True)
        return (at[np.searchsorted(np.cumsum(n), share * len(values))] + 1) / bins

    def estimate(x):
        return x.mean(0), np.linalg.cholesky(np.cov(x.T, bias=True).reshape(p, p) + np.diag(floors**2))

    def far(x, est):
        z = np.linalg.solve(est[1], (x - est[0]).T)
        return (z**2).sum(0)

    logdet = lambda est: 2 * np.log(np.diag(est[1])).sum()
    groups = {}
    for _, g, x, failed in rows:
        if not failed:
            groups.setdefault(g, []).append(x)
            groups.setdefault(None, []).append(x)
    groups = {g: np.array(x) for g, x in groups.items()}
    now = {}
    for g, x in groups.items():
        qs = np.array([[edge(x[:, k], s, 200.0) for s in (0.25, 0.5, 0.75)] for k in range(p)])
        mid, scale = qs[:, 1], np.maximum((qs[:, 2] - qs[:, 0]) / 1.349, floors)
        z = (x - mid) / scale
        unit = z / np.maximum(np.sqrt((z**2).sum(1)), 1e-9)[:, None] * np.sqrt(p) * scale
        now |= {(g, 0): (mid, np.diag(scale)), (g, 1): estimate(x), (g, 2): (mid, estimate(unit)[1])}
    for step in range(q.STEPS):
        nxt = {}
        for (g, k), est in now.items():
            spread = np.log1p(far(groups[g], est))
            nxt[g, k] = estimate(groups[g][spread <= edge(spread, q.SUBSET, 64.0)])
        fall = max(logdet(now[k]) - logdet(nxt[k]) for k in now)
        now = nxt
        if step and fall < q.FALL:
            break
    best = {g: now[g, min((logdet(now[g, k]), k) for k in range(3))[1]] for g in groups}
    scale = {g: max(np.expm1(edge(np.log1p(far(x, best[g])), 0.5, 256.0)) / q.MEDIAN_CHI2, 0.25) for g, x in groups.items()}
    drawn = {}
    for g, x in groups.items():
        w = 1.0 if g is None else len(x) / (len(x) + q.PRIOR_ROWS)
        (m, l), (ma, la) = best[g], best[None]
        cov = w * l @ l.T + (1 - w) * la @ la.T + w * (1 - w) * np.outer(m - ma, m - ma)
        drawn[g] = (w * m + (1 - w) * ma, np.linalg.cholesky(cov)), w * scale[g] + (1 - w) * scale[None]
    out = {}
    for i, g, x, _ in rows:
        est, s = drawn.get(g, drawn[None])
        out[i] = far(np.array([x]), est)[0] / s
    return out


def language(text, model, size):
    """(language, score) of a text by a fitted model's machines."""
    import numpy as np

    raw = (text or "").translate(_LOWER).encode()
    kinds = sorted(model["langs"])
    if not kinds or not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    x = np.zeros(size)
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        x[((a * 2654435 + b * 40503 + c) * 2654435761 & 0xFFFFFFFF) >> 20] += 1
    x = np.sqrt(x) / max(np.sqrt(x.sum()), 1e-12)

    def duel(machines, names):
        votes, least = dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for a, b, w in machines:
            m = 1 / (1 + np.exp(-3.0 * (x @ w[:-1] + w[-1])))
            votes[a] += (m >= 0.5) + m / 1000
            votes[b] += (m < 0.5) + (1 - m) / 1000
            least[a], least[b] = min(least[a], m), min(least[b], 1 - m)
        best = max(names, key=lambda n: votes[n])
        return best, least[best]

    fam, v = duel(model["families"], kinds)
    lang, u = duel(model["langs"][fam], model["only"][fam])
    return str(lang), v * u


def phrase_places(text, phrases):
    """(n_words, n_base, first, last, labels)."""
    w, found, labels = alnum(text), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        found += at
        labels |= {label} if at else set()
    return len(w), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(labels))


def license_labels(text, phrases, templates):
    """Labels and share of words in matches, by trying every way through every template at every place."""
    w = alnum(text)

    def parsed(markup):
        out, stack = [], []
        for m in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup):
            if m == "[[":
                stack.append(out)
                out = []
            elif m == "]]":
                inner, out = out, stack.pop()
                out.append(inner)
            else:
                out.append(int(m[2:-2]) if m.startswith("{{") else m)
        return out

    def ends(parts, at):
        if not parts:
            return {at}
        head, rest = parts[0], parts[1:]
        if isinstance(head, list):
            starts = {at} | ends(head, at)
        elif isinstance(head, int):
            starts = set(range(at, min(at + head, len(w)) + 1))
        else:
            starts = {at + 1} if at < len(w) and w[at] == head else set()
        return {e for s in starts for e in ends(rest, s)}

    labels, spans = set(), []
    for p, label in phrases.items():
        p = p.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        labels |= {label} if hits else set()
        spans += [(i, i + len(p)) for i in hits]
    for label, ts in templates.items():
        for t in ts:
            parts = parsed(t)
            number = [x for x in parts if isinstance(x, str)][-1].isdigit()
            for i in range(len(w)):
                good = [e for e in ends(parts, i) if e > i and not (number and e < len(w) and re.fullmatch(r"0|[1-9]\d{0,2}", w[e]))]
                if good:
                    labels.add(label)
                    spans.append((i, max(good)))
    covered = {x for a, b in spans for x in range(a, b)}
    return ",".join(sorted(labels)), round(len(covered) / len(w), 9) if covered else 0.0


def base_scores(rows, train):
    """{doc_id: (n_tokens, n_known, train tokens, score)} of add-one unigrams; one end token a text."""
    c = Counter(t for x in train for t in [*white(x, True), None])
    total, distinct = sum(c.values()), len(c)
    out = {}
    for doc_id, text in rows:
        t = [*white(text, True), None]
        out[doc_id] = len(t), sum(c[x] > 0 for x in t), total, sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in t)
    return out


def shape(word):
    raw = word.encode()
    return min(len(raw), 15) * 2 + (97 <= raw[-1] <= 122 or raw[-1] >= 128)


def class_scores(rows, train, cls, often, learned, pseudo):
    """{doc_id: score} of a class bigram model; cls: class of each training word, None is the end mark; words never seen have learned + shape."""
    seqs = lambda text: [None, *white(text, True), None]
    c = Counter(t for x in train for t in white(x, True))
    of = lambda w: cls[w] if w in cls else learned + shape(w)
    both, size = Counter(), max(cls.values()) + 1
    for x in train:
        s = seqs(x)
        for a, b in zip(s, s[1:]):
            both[of(a), of(b)] += 1
            if c[a] == 1 and b in often:
                both[learned + shape(a), of(b)] += 1
            if c[b] == 1 and a in often:
                both[of(a), learned + shape(b)] += 1
    step = {}
    for a in range(size):
        row = [both[a, b] + pseudo for b in range(size)]
        step |= {(a, b): math.log10(v / sum(row)) for b, v in enumerate(row)}
    mass, types = Counter(), Counter(shape(w) for w in c)
    for w, n in c.items():
        mass[of(w)] += n + 1
    emit = lambda w: math.log10((c[w] + 1) / mass[of(w)]) if w in c else -math.log10(types[shape(w)] + 1)
    out = {}
    for doc_id, text in rows:
        s = seqs(text)
        out[doc_id] = sum(step[of(a), of(b)] for a, b in zip(s, s[1:])) + sum(emit(w) for w in s[1:-1])
    return out


def windows(item, size=10):
    w = alnum(item)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def decontaminate(text, items):
    """n_words, n_hit, sorted ids of items with occurring windows."""
    w, hit, found = alnum(text), set(), set()
    for item_id, item in items:
        for g in windows(item):
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(str(item_id))
    return len(w), len(hit), sorted(found)


def shingles(text, k):
    w = white(text, True)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(rows, k, percent):
    """{doc_id: (set size, smallest doc_id reachable)}."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    low = {i: i for i, _ in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(i), root(j)))
                low[q] = p
    return {i: (len(s), root(i)) for i, s in sets}


def kept_words(rows, size=20):
    """{doc_id: (n_words, words left)}; rows in any order."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        w, gone = white(text), set()
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            if g in seen:
                gone |= set(range(i, i + size))
            seen.add(g)
        out[doc_id] = len(w), [x for i, x in enumerate(w) if i not in gone]
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def best_fit(sizes, length):
    """Number of sequences of plain best-fit decreasing."""
    gaps: list[int] = []
    for n in sorted(sizes, reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= n]
        if fit:
            gaps[min(fit, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(length - n)
    return len(gaps)
