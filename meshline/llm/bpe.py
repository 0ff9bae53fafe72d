"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut into chunks where a rolling hash of the bytes says so, so equal
passages in different documents give equal chunks. Only chunks that a worker
does not hold are encoded, all those of a block together; the others give
their ids again. A cut may fall inside a word, so every join is repaired: a
window over the join, with whole words of both chunks as margins, is encoded
anew by the library, and its ids take the place of the join's when they agree
with both chunks' own ids on the margins. Where they do not, the margins are
doubled until they do; a text with a join that never agrees is encoded whole.

Edge cases: null is the empty text and has no tokens; a text without white
space is one window however long it is; special tokens' strings in a text are
those tokens, as the library has it; every row of a repeated doc_id has its
own result; an empty table gives no rows. Memory is bounded by the caches'
sizes and the largest text.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshline.llm.common import blocks, bytes_of

#: Rolling hash: window and multiplier, chunk sizes in bytes.
WINDOW, MULTIPLIER = 32, 0x5851F42D4C957F2D
LEAST, MEAN, MOST = 128, 512, 8192

_PUNCTUATION = ".,;:!?"


class Merges:
    """A vocabulary's merges, applied to many words at once in numpy: in every word the leftmost pair of the least rank, again and again, as the library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [x.split(" ", 1) if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 and on, in order.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        letters = [chr(b if b in printable else next(others)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int32)

    NONE = np.int32(2**31 - 1)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], self.NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (not empty, one pre-token each), as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(len(w), []).append(k)
        for size, at in by_size.items():
            step = max(1, (1 << 18) // size)
            for start in range(0, len(at), step):
                part = at[start : start + step]
                raw = np.frombuffer(b"".join([words[k] for k in part]), dtype=np.uint8).reshape(-1, size)
                for k, ids in zip(part, self._merge(raw), strict=True):
                    out[k] = ids
        return out

    def _merge(self, raw: np.ndarray) -> list[bytes]:
        n, size = raw.shape
        ids = np.full((n, size + 1), -1, dtype=np.int32)  # one column more, so that a right neighbour can be asked for
        ids[:, :size] = self.inner[raw]
        ids[:, size - 1] = self.last[raw[:, -1]]
        ranks = np.full((n, size), self.NONE, dtype=np.int32)
        ranks[:, : size - 1] = self._rank(ids[:, : size - 1].ravel(), ids[:, 1:size].ravel()).reshape(n, size - 1)
        rows, columns = np.arange(n), np.arange(size)
        while len(rows):
            where = ranks[rows].argmin(axis=1)
            least = ranks[rows, where]
            live = least != self.NONE
            rows, where, least = rows[live], where[live], least[live]
            if not len(rows):
                break
            after = columns[None, :] > where[:, None]
            ids[rows, where] = self.made[least]
            moved = ids[rows]
            moved[:, :size] = np.where(after, moved[:, 1:], moved[:, :size])
            ids[rows] = moved
            shifted = ranks[rows]
            shifted[:, :-1] = np.where(after[:, :-1], shifted[:, 1:], shifted[:, :-1])
            shifted[:, -1] = self.NONE
            ranks[rows] = shifted
            ranks[rows, where] = self._rank(ids[rows, where], ids[rows, where + 1])
            inner = where > 0
            r, w = rows[inner], where[inner]
            ranks[r, w - 1] = self._rank(ids[r, w - 1], ids[r, w])
        counts = (ids[:, :size] >= 0).sum(axis=1).tolist()
        flat = ids.astype("<u4").tobytes()
        width = 4 * (size + 1)
        return [flat[k * width : k * width + 4 * c] for k, c in enumerate(counts)]


class Chunk(NamedTuple):
    """A chunk's part before its first white space, ids of its middle (None: it has no white space), part after its last; the middle's first and last words and their ids."""

    head: str
    ids: bytes | None
    tail: str
    first: str
    first_ids: bytes
    last: str
    last_ids: bytes


class Encoder:
    """Exact ids of texts, by chunks that were seen before."""

    def __init__(self, path: str, words: int = 500_000, chunks: int = 30_000, joins: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.merges = Merges(path)
        self.most, self.most_chunks, self.most_joins = words, chunks, joins
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.chunks: dict[bytes, Chunk] = {}
        self.joins: dict[str, bytes] = {}
        self.encoded = 0  # chunks that were encoded, for tests
        self.tokens = [self.library.decode([i], skip_special_tokens=False).encode() for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.decimals = [b"%d" % i for i in range(len(self.tokens))]

    # Words: what stands between blanks and line feeds. The pre-tokenizer never joins across them.

    def fill(self, words: set[str]) -> None:
        """Encodes what is not known of ``words``, together. A full cache is emptied first."""
        if len(self.words) > self.most:
            self.words.clear()
        if len(self.cores) > self.most:
            self.cores.clear()
        cores, letters, others, plain = self.cores, set(), set(), []
        for w in words.difference(self.words):
            core = w.rstrip(_PUNCTUATION)
            if core.isalpha() and (core.isascii() or max(core) < "ɐ") and (low := core.lower()).isalpha():
                # Latin letters and then plain punctuation: encoded apart. No normal form changes such letters.
                tail = w[len(core) :]
                plain.append((w, low, tail))
                if low not in cores:
                    letters.add(low)
                if tail not in cores:
                    others.add(tail)
            else:
                plain.append((w, w, ""))
                if w not in cores:
                    others.add(w)
        cores[""] = b""
        others.discard("")
        if letters:
            for core, ids in zip(letters, self.merges.encode([c.encode() for c in letters]), strict=True):
                cores[core] = ids
        if others:
            some = list(others)
            for part, e in zip(some, self.library.encode_batch(some, add_special_tokens=False), strict=True):
                cores[part] = np.array(e.ids, dtype="<u4").tobytes()
        for w, core, tail in plain:
            self.words[w] = cores[core] + cores[tail]

    def word(self, word: str) -> bytes:
        """The ids of a word, as little-endian 32-bit integers."""
        if (ids := self.words.get(word)) is None:
            self.fill({word})
            ids = self.words[word]
        return ids

    def by_words(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        split = [x.replace("\n", " ").split(" ") for x in texts]
        self.fill(set().union(*split))
        get = self.words.__getitem__
        return [b"".join(map(get, x)) for x in split]

    # Chunks.

    def learn(self, raws: Iterable[bytes]) -> None:
        """Encodes the chunks that are not held, together. The oldest quarter of a full cache goes first."""
        if len(self.chunks) > self.most_chunks:
            for raw in list(islice(self.chunks, self.most_chunks // 4)):
                del self.chunks[raw]
        words: dict[bytes, tuple[str, list[str], str]] = {}
        for raw in raws:
            if raw not in self.chunks and raw not in words:
                text = raw.decode().replace("\n", " ")
                first, last = text.find(" "), text.rfind(" ")
                words[raw] = (text[:first], text[first + 1 : last].split(" "), text[last + 1 :]) if first >= 0 else (text, [], "")
        self.fill(set().union(*(w for _, w, _ in words.values())))
        for raw, (head, middle, tail) in words.items():
            ids = [self.words[w] for w in middle]
            self.chunks[raw] = Chunk(head, b"".join(ids), tail, middle[0], ids[0], middle[-1], ids[-1]) if middle else Chunk(head, None, "", "", b"", "", b"")
        self.encoded += len(words)

    def _windows(self, windows: list[str]) -> None:
        """Encodes windows over joins by the library, together."""
        if len(self.joins) > self.most_joins:
            self.joins.clear()
        new = list(dict.fromkeys(w for w in windows if w not in self.joins))
        for w, e in zip(new, self.library.encode_batch(new, add_special_tokens=False), strict=True):
            self.joins[w] = np.array(e.ids, dtype="<u4").tobytes()

    def _widened(self, left: bytes | None, held: str, right: bytes | None) -> bytes | None:
        """The ids of a join with ever more words of its chunks as margins; None if they never agree."""
        before, after = (raw.decode().replace("\n", " ").split(" ")[1:-1] if raw else [] for raw in (left, right))
        k = 1
        while k < 2 * max(len(before), len(after)):
            k *= 2
            mine, theirs = before[-k:], after[:k]
            ids = np.array(self.library.encode(" ".join([*mine, held, *theirs]), add_special_tokens=False).ids, dtype="<u4").tobytes()
            front, back = b"".join(map(self.word, mine)), b"".join(map(self.word, theirs))
            if len(ids) >= len(front) + len(back) and ids.startswith(front) and ids.endswith(back):
                return ids[len(front) : len(ids) - len(back)]
        return None

    def encode(self, raws: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        parts = []
        for raw in raws:
            ends = [0, *cuts(raw), len(raw)]
            parts.append([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        self.learn(c for p in parts for c in p)
        # Joins: from white space to white space, with a word of each side as margin.
        plans, windows = [], []
        for part in parts:
            plan, held, left = [], [], None
            for raw in [*part, None]:
                chunk = self.chunks[raw] if raw is not None else None
                if chunk is not None:
                    held.append(chunk.head)
                    if chunk.ids is None:
                        continue
                inside = "".join(held)
                window = " ".join([*([self.chunks[left].last] if left else []), inside, *([chunk.first] if chunk else [])])
                plan.append((left, inside, raw, window))
                windows.append(window)
                if chunk is not None:
                    held, left = [chunk.tail], raw
            plans.append(plan)
        self._windows(windows)
        return [self._joined(raw, plan) for raw, plan in zip(raws, plans, strict=True)]

    def _joined(self, raw: bytes, plan: list[tuple[bytes | None, str, bytes | None, str]]) -> bytes:
        out = []
        for left, inside, right, window in plan:
            front = self.chunks[left].last_ids if left else b""
            back = self.chunks[right].first_ids if right else b""
            ids = self.joins[window]
            if len(ids) >= len(front) + len(back) and ids.startswith(front) and ids.endswith(back):
                out.append(ids[len(front) : len(ids) - len(back)])
            elif (ids := self._widened(left, inside, right)) is not None:
                out.append(ids)
            else:
                return np.array(self.library.encode(raw.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
            if right:
                out.append(self.chunks[right].ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8: the vocabulary has no decoder, so its strings stand joined by blanks."""
        return b" ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file; its caches live as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_GEAR = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        up = np.full(size, MULTIPLIER, dtype=np.uint64)
        up[0] = 1
        _POWERS["up"] = np.multiply.accumulate(up)
        down = np.full(size, pow(MULTIPLIER, -1, 1 << 64), dtype=np.uint64)
        down[0] = 1
        _POWERS["down"] = np.multiply.accumulate(down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def cuts(raw: bytes) -> list[int]:
    """Where the chunks of a text end, but for its own end: after ``LEAST`` bytes, the first place at which the hash of the ``WINDOW`` bytes before it is 0 modulo ``MEAN``, or ``MOST``; never inside a character."""
    n = len(raw)
    if n <= LEAST:
        return []
    b = np.frombuffer(raw, dtype=np.uint8)
    up, down = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_GEAR[b] * up, out=sums[1:])
    rolled = (sums[WINDOW:] - sums[:-WINDOW]) * down[: n - WINDOW + 1] if n >= WINDOW else np.empty(0, np.uint64)
    at = np.flatnonzero((rolled >> np.uint64(64 - MEAN.bit_length() + 1)) == 0) + WINDOW
    at = at[at < n]
    at = at[(b[at] & 0xC0) != 0x80].tolist()
    out, start, k = [], 0, 0
    while n - start > LEAST:
        while k < len(at) and at[k] < start + LEAST:
            k += 1
        end = at[k] if k < len(at) else n
        if end - start > MOST:
            end = start + MOST
            while raw[end] & 0xC0 == 0x80:
                end -= 1
        if end >= n:
            break
        out.append(end)
        start = end
    return out


def digests(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches):
        e = encoder(path)
        for block in blocks(batches):
            counts, ids_sha, decoded_sha = [], [], []
            for ids in e.encode(bytes_of(block.column("text"))):
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(b" ".join(map(e.decimals.__getitem__, memoryview(ids).cast("I")))).hexdigest())
                decoded_sha.append(hashlib.sha256(e.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Per document: the number of its tokens and digests of its ids and of its decoded text. No shuffle."""
    return docs.select("doc_id", "text").mapInArrow(digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """Per document: its ids and its decoded text themselves."""

    def run(batches):
        e = encoder(path)
        for block in blocks(batches):
            ids = e.encode(bytes_of(block.column("text")))
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([e.decode(x).decode() for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
