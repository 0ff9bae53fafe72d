import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshline.llm import lines, minhash, repeats, substrings, suffixes

random.seed(7)
WORDS = [f"w{k}" for k in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def changed(text, seed, every=40):
    r = random.Random(seed)
    return " ".join(x if r.randrange(every) else r.choice(WORDS) for x in text.split(" "))


BASE = prose(120, 1)
PASSAGE = prose(45, 2)
TEXTS = [
    BASE, BASE, None, "", " \t\n", "one", "one", "Few words here", "few WORDS here", changed(BASE, 3), changed(BASE, 4), changed(BASE, 5, 12), changed(BASE, 6, 8), prose(50, 7) + " " + PASSAGE, PASSAGE + "  " + prose(30, 8), prose(20, 9) + "\n" + PASSAGE + "\n" + prose(10, 10),
    "a " * 80, "a " * 60, "é漢字 " * 90, "x" * 900, "y" + "x" * 700, prose(600, 11), prose(300, 11) + " z " + prose(100, 12), *(changed(BASE, 100 + k, 30) for k in range(12)), *(PASSAGE + " " + prose(25, 200 + k) for k in range(6)),
]
DOCS = list(enumerate(TEXTS))


def got(frame, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in frame.collect()}


def test_substrings(frame):
    assert got(substrings.digest(frame(TEXTS, extra=True)), "n_words", "n_removed", "kept_sha256") == brute.substrings(DOCS, 20)


def test_substring_texts(frame):
    cleaned = {r["doc_id"]: r["text"] for r in substrings.clean(frame(TEXTS, extra=True)).collect()}
    for d, (_, n, kept) in brute.substrings(DOCS, 20).items():
        if n:
            assert brute.sha(b" ".join(cleaned[d].encode().split())) == kept
        else:
            assert cleaned[d] == TEXTS[d]


def test_suffixes(frame):
    assert got(suffixes.digest(frame(TEXTS, extra=True)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffixes(DOCS, 400)


def test_suffixes_of_grams_with_many_kinds(frame, monkeypatch):
    monkeypatch.setattr(suffixes, "MOST_KINDS", 1)
    texts = [PASSAGE * 3 + prose(25, 900 + k) for k in range(9)]
    assert got(suffixes.digest(frame(texts)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffixes(list(enumerate(texts)), 400)


def test_near_texts(frame):
    assert got(minhash.near_duplicates(frame(TEXTS, extra=True)), "n_shingles", "component_id", "kept") == brute.near_texts(DOCS)


def test_near_texts_in_several_blocks(frame, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    texts = [changed(BASE, 300 + k, (15, 30, 60)[k % 3]) for k in range(24)]
    assert got(minhash.near_duplicates(frame(texts)), "n_shingles", "component_id", "kept") == brute.near_texts(list(enumerate(texts)))


def test_lines(frame):
    body = ["a line of more than twenty characters", "short", "another line that is quite long enough", "Un.", ""]
    texts = ["\n".join(body), "\n".join(body), body[0], "short", "short\nUn.", "Un.\nshort\nUn.\nshort", "\n".join(body[1:4]), None, "", body[2] + "\nx\n" + body[2], "é" * 19, "é" * 19 + "\n" + "é" * 20, "é" * 20]
    want = brute.lines(list(enumerate(texts)), 20, 3)
    assert got(lines.digest(frame(texts, extra=True)), "n_lines", "n_removed", "n_runs", "kept_sha256") == want
    cleaned = {r["doc_id"]: r["text"] for r in lines.clean(frame(texts, extra=True)).collect()}
    assert all(brute.sha((cleaned[d] or "").encode()) == w[3] for d, w in want.items()) and cleaned[7] is None
    assert got(lines.digest(frame(texts), 30, 4), "n_lines", "n_removed", "n_runs", "kept_sha256") == brute.lines(list(enumerate(texts)), 30, 4)


@pytest.mark.parametrize("operator", [substrings.digest, suffixes.digest, minhash.near_duplicates, lines.digest])
def test_empty_table(frame, operator):
    assert operator(frame(["x"]).where("false")).collect() == []


@given(st.binary(max_size=200))
@settings(max_examples=60, deadline=None)
def test_suffix_order(text):
    assert suffixes.suffix_order(text, 400).tolist() == sorted(range(len(text)), key=lambda p: text[p:])


@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_least_in_windows(values, width):
    hashes = np.array(values, dtype=np.uint64) << np.uint64(40)
    want = [min(range(k, k + width), key=lambda p: (values[p], p)) for k in range(len(values) - width + 1)]
    assert repeats.least_in_windows(hashes, width).tolist() == want
