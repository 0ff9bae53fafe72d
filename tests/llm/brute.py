"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


class Union:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def root(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def substrings(docs, size):
    words = {d: (t or "").encode().split() for d, t in docs}
    first, out = {}, {}
    for d in sorted(words):
        for p in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][p : p + size]), (d, p))
    for d, w in words.items():
        gone = {k for p in range(len(w) - size + 1) if first[tuple(w[p : p + size])] != (d, p) for k in range(p, p + size)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[d] = (len(w), len(gone), sha(b" ".join(kept)))
    return out


def suffixes(docs, size):
    raws = {d: (t or "").encode() for d, t in docs}
    counts = Counter(r[p : p + size] for r in raws.values() for p in range(len(r) - size + 1))
    out = {}
    for d, r in raws.items():
        gone = {k for p in range(len(r) - size + 1) if counts[r[p : p + size]] > 1 for k in range(p, p + size)}
        spans = sum(1 for k in gone if k - 1 not in gone)
        out[d] = (len(r), len(gone), spans, sha(bytes(b for k, b in enumerate(r) if k not in gone)))
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_texts(docs):
    sets = {d: shingles(t) for d, t in docs}
    groups = Union(sets)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                groups.join(a, b)
    return {d: (len(s), groups.root(d), groups.root(d) == d) for d, s in sets.items()}


def lines(docs, min_chars, min_lines):
    parts = {d: t.split("\n") for d, t in docs if t is not None}
    one, many, out = {}, {}, {}
    for d in sorted(parts):
        for k, x in enumerate(parts[d]):
            one.setdefault(x, (d, k))
            if k + min_lines <= len(parts[d]):
                many.setdefault(tuple(parts[d][k : k + min_lines]), (d, k))
    for d, t in docs:
        x = parts.get(d, [])
        gone = {k for k, v in enumerate(x) if one[v] != (d, k) and len(v) >= min_chars}
        for k in range(len(x) - min_lines + 1):
            if many[tuple(x[k : k + min_lines])] != (d, k):
                gone |= set(range(k, k + min_lines))
        out[d] = (len(x), len(gone), sum(1 for k in gone if k - 1 not in gone), sha("\n".join(v for k, v in enumerate(x) if k not in gone).encode()))
    return out


def _gram_bucket(gram, buckets):
    """The bucket of one n-gram, character by character."""
    h = 0
    for c in gram:
        h = ((h * 0x01000193 & 0xFFFFFFFF ^ ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
    h = ((h ^ (len(gram) * 0x85EBCA6B & 0xFFFFFFFF)) * 0xC2B2AE35) & 0xFFFFFFFF
    return h >> (32 - buckets.bit_length() + 1)


def _grams(text, buckets):
    """Buckets of all n-grams with a letter; all but letters count as one blank."""
    plain = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    plain = re.sub(" +", " ", plain)
    plain = plain.removeprefix(" ")
    return [_gram_bucket(plain[k : k + n], buckets) for n in (1, 2, 3, 4) for k in range(len(plain) - n + 1) if plain[k : k + n].strip()]


def languages(train, texts, buckets, smoothing):
    """(prediction, score) by a plain multinomial naive Bayes with priors."""
    seen, docs = {}, Counter()
    for text, lang in train:
        if lang is not None and text is not None:
            docs[lang] += 1
            seen.setdefault(lang, Counter()).update(_grams(text, buckets))
    langs = sorted(seen)
    out = []
    for text in texts:
        found = _grams(text, buckets)
        if not found or not langs:
            out.append(("und", 0.0))
            continue
        logs = []
        for lang in langs:
            total = sum(seen[lang].values()) + smoothing * buckets
            logs.append((math.log(docs[lang] / sum(docs.values())) + sum(math.log((seen[lang][g] + smoothing) / total) for g in found)) / math.sqrt(len(found)))
        top = max(logs)
        out.append((langs[logs.index(top)], 1 / sum(math.exp(x - top) for x in logs)))
    return out


def discriminant(x, y, points, shrink, ridge, temper):
    """Probabilities of label 1 by a plain quadratic discriminant with shrunk covariances."""
    x, y, points = np.asarray(x), np.asarray(y), np.asarray(points)
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).sum() * own[k] for k in (0, 1)) / len(y)
    density = []
    for k in (0, 1):
        c = (1 - shrink) * own[k] + shrink * pooled + ridge * np.diag(np.diag(pooled))
        away = points - x[y == k].mean(axis=0)
        density.append(-0.5 * np.einsum("ij,ij->i", away, np.linalg.solve(c, away.T).T) - 0.5 * np.linalg.slogdet(c)[1])
    prior = ((y == 1).sum() + 1) / (len(y) + 2)
    return 1 / (1 + np.exp(-(temper * (density[1] - density[0]) + np.log(prior / (1 - prior)))))


def samples(png):
    """The samples of a grey 8-bit picture, read by the format's definition."""
    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    at, body = 8, b""
    while at < len(png):
        size, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
        if kind == b"IHDR":
            width, height = int.from_bytes(png[at + 8 : at + 12], "big"), int.from_bytes(png[at + 12 : at + 16], "big")
            assert png[at + 16 : at + 21] == b"\x08\0\0\0\0"
        if kind == b"IDAT":
            body += png[at + 8 : at + 8 + size]
        at += 12 + size
    rows = zlib.decompress(body)
    assert len(rows) == height * (width + 1) and not any(rows[k * (width + 1)] for k in range(height))
    return b"".join(rows[k * (width + 1) + 1 : (k + 1) * (width + 1)] for k in range(height))


def best_fit_decreasing(lengths, capacity):
    """The number of bins."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in room if r >= n]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - n)
        else:
            room.append(capacity - n)
    return len(room)


def cut_lines(docs, min_chars, min_lines):
    """Texts without the lines that ``lines`` counts."""
    parts = {d: t.split("\n") for d, t in docs}
    one, many = {}, {}
    for d in sorted(parts):
        for k, x in enumerate(parts[d]):
            one.setdefault(x, (d, k))
            if k + min_lines <= len(parts[d]):
                many.setdefault(tuple(parts[d][k : k + min_lines]), (d, k))
    out = {}
    for d, x in parts.items():
        gone = {k for k, v in enumerate(x) if one[v] != (d, k) and len(v) >= min_chars}
        for k in range(len(x) - min_lines + 1):
            if many[tuple(x[k : k + min_lines])] != (d, k):
                gone |= set(range(k, k + min_lines))
        out[d] = "\n".join(v for k, v in enumerate(x) if k not in gone)
    return out


def cut_words(docs, size):
    """Texts without repeated words, each cut run with the white space after it."""
    raws = {d: t.encode() for d, t in docs}
    places = {d: [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", r)] for d, r in raws.items()}
    first, out = {}, {}
    for d in sorted(places):
        w = [x for _, x in places[d]]
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p : p + size]), (d, p))
    for d, x in places.items():
        w = [y for _, y in x]
        gone = {k for p in range(len(w) - size + 1) if first[tuple(w[p : p + size])] != (d, p) for k in range(p, p + size)}
        ends = [a for a, _ in x[1:]] + [len(raws[d])]
        lead = raws[d][: x[0][0]] if x else raws[d]
        out[d] = (lead + b"".join(raws[d][a:b] for k, ((a, _), b) in enumerate(zip(x, ends, strict=True)) if k not in gone)).decode()
    return out
