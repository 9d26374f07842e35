"""Encoding of a whole corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Where the public vocabulary files are; a parameter of every function that reads them.
VOCABULARIES = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern by which this family of vocabularies cuts a text into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(np.iinfo(np.int32).max)
#: Pieces above this many bytes are merged one by one with a heap: a matrix would take their length squared.
WIDEST = 256
#: Distinct chunks a worker remembers before it starts afresh.
REMEMBERED = 1_000_000
#: Bytes of text that a worker encodes at a time.
AT_ONCE = 8_000_000
_CHUNK = re.compile(r" (?=\S)")


class Ranks:
    """A vocabulary as numpy tables: ids of single bytes, and an open-addressed hash table from pairs of ids to ids."""

    def __init__(self, lines: bytes) -> None:
        rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        self.rank = rank
        self.byte = np.full(256, -1, np.int32)
        for k, v in rank.items():
            if len(k) == 1:
                self.byte[k[0]] = v
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = [(a, b, v) for k, v in rank.items() for i in range(1, len(k)) if (a := rank.get(k[:i])) is not None and (b := rank.get(k[i:])) is not None]
        a, b, v = (np.array(x, np.uint64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.uint64),) * 3
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(v)) * 2.5))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        key, todo, step = ((a << np.uint64(32)) | b).astype(np.int64), np.arange(len(v)), 0
        while len(todo):  # every pair that finds its slot free takes it, the others look one further
            slot = (self._slot(key[todo]) + step) & ((1 << self.bits) - 1)
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = key[todo[won]], v[todo[won]]
            todo, step = np.delete(todo, won), step + 1
        self.steps = max(1, step)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the merged pairs, NONE where a pair doesn't merge (a negative id never does)."""
        key = (a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)
        out = np.full(len(key), NONE, np.int32)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        at = self._slot(key[left])
        for _ in range(self.steps):
            if not len(left):
                break
            at &= (1 << self.bits) - 1
            held = self.keys[at]
            hit = held == key[left]
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (held != -1)
            left, at = left[go], at[go] + 1
        return out


def merge_matrix(ids: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """BPE of all rows of a matrix at once: ids padded with -1 on the right. Returns the ids and their number per row.

    In each round every row merges its leftmost pair of lowest rank and closes the gap; rows without a pair are done.
    """
    n, width = ids.shape
    done, size = np.full((n, width), -1, np.int32), (ids >= 0).sum(axis=1)
    row, cur = np.arange(n), ids.astype(np.int32)
    pair = ranks.merged(cur[:, :-1].ravel(), cur[:, 1:].ravel()).reshape(n, -1) if width > 1 else np.full((n, 1), NONE, np.int32)
    while len(row):
        at = pair.argmin(axis=1)
        low = pair[np.arange(len(row)), at]
        over = low == NONE
        if over.any():
            done[row[over], : cur.shape[1]] = cur[over]
            row, cur, pair, at, low = row[~over], cur[~over], pair[~over], at[~over], low[~over]
            if not len(row):
                break
        k, w = np.arange(len(row)), cur.shape[1]
        cur[k, at] = low
        col = np.arange(w - 1)[None, :]
        cur = np.take_along_axis(cur, col + (col > at[:, None]), axis=1)
        size[row] -= 1
        if w == 2:
            pair = np.full((len(row), 1), NONE, np.int32)
            continue
        col = col[:, : w - 2]
        pair = np.take_along_axis(pair, col + (col >= at[:, None]), axis=1)
        right = at < w - 2
        pair[k[right], at[right]] = ranks.merged(cur[k[right], at[right]], cur[k[right], at[right] + 1])
        left = at > 0
        pair[k[left], at[left] - 1] = ranks.merged(cur[k[left], at[left] - 1], cur[k[left], at[left]])
    return done, size


def merge_long(piece: bytes, ranks: Ranks) -> list[int]:
    """BPE of one long piece with a heap and a linked list; the same result in n log n."""
    ids = [int(x) for x in ranks.byte[np.frombuffer(piece, np.uint8)]]
    n = len(ids)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    start = list(range(n))
    look = lambda i: ranks.rank.get(piece[start[i] : end[nxt[i]]]) if nxt[i] < n else None
    heap = [(r, i, end[nxt[i]]) for i in range(n - 1) if (r := look(i)) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        r, i, e = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != e or look(i) != r:
            continue
        j = nxt[i]
        ids[i], end[i], nxt[i], alive[j] = r, end[j], nxt[j], False
        if nxt[j] < n:
            prv[nxt[j]] = i
        for k in (prv[i], i):
            if k >= 0 and (q := look(k)) is not None:
                heapq.heappush(heap, (q, k, end[nxt[k]]))
    return [ids[i] for i in range(n) if alive[i]]


class Encoder:
    """Encodes batches of texts. A text is cut at spaces before a word, where no piece can go across; what follows
    from a cut is the same wherever it stands, so each distinct chunk is encoded once and then looked up."""

    def __init__(self, ranks: Ranks, pattern: str = PIECES) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.first: dict[str, int] = {}
        self.rest: dict[str, int] = {}
        self.piece: dict[str, int] = {}
        self.piece_at, self.piece_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.offset, self.length, self.known = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Put ids at the end of the pool; where they begin."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        at = self.used
        self.flat[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _learn_pieces(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        at, many = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        # Rows of a bucket are at most a third longer than one another.
        bucket = np.where(size <= 4, size, 4 + np.ceil(np.log(np.maximum(size, 4) / 4) / np.log(1.34)).astype(int))
        for b in np.unique(bucket[size <= WIDEST]):
            which = np.flatnonzero((bucket == b) & (size <= WIDEST))
            width = int(size[which].max())
            at_once = max(1, 4_000_000 // width)
            for lo in range(0, len(which), at_once):
                some = which[lo : lo + at_once]
                m = np.full((len(some), width), -1, np.int32)
                inside = np.arange(width)[None, :] < size[some][:, None]
                m[inside] = self.ranks.byte[np.frombuffer(b"".join([raw[i] for i in some.tolist()]), np.uint8)]
                ids, count = merge_matrix(m, self.ranks)
                base = self._keep(ids[np.arange(width)[None, :] < count[:, None]])
                at[some], many[some] = base + np.cumsum(count) - count, count
        for i in np.flatnonzero(size > WIDEST):
            ids = merge_long(raw[i], self.ranks)
            at[i], many[i] = self._keep(np.array(ids, np.int32)), len(ids)
        self.piece.update(zip(pieces, range(len(self.piece), len(self.piece) + len(pieces))))
        self.piece_at, self.piece_size = np.append(self.piece_at, at), np.append(self.piece_size, many)

    def _learn(self, chunks: list[str], lead: str, into: dict[str, int]) -> None:
        cut = [self.pattern.findall(lead + c) for c in chunks]
        fresh = list(set().union(*cut) - self.piece.keys())
        if fresh:
            self._learn_pieces(fresh)
        parts = np.fromiter(map(len, cut), np.int64, len(cut))
        which = np.fromiter(map(self.piece.__getitem__, chain.from_iterable(cut)), np.int64, int(parts.sum()))
        many = self.piece_size[which]
        total, ends = np.append(0, np.cumsum(many)), np.cumsum(parts)
        count = total[ends] - total[ends - parts]
        base = self._keep(self.flat[self._places(self.piece_at[which], many)])
        need = self.known + len(chunks)
        while need > len(self.length):
            self.offset, self.length = np.append(self.offset, np.zeros_like(self.offset)), np.append(self.length, np.zeros_like(self.length))
        self.offset[self.known : need], self.length[self.known : need] = base + np.cumsum(count) - count, count
        into.update(zip(chunks, range(self.known, need)))
        self.known = need

    @staticmethod
    def _places(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
        total = int(many.sum())
        return np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(total)

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.known > REMEMBERED:
            self._forget()
        # A run of spaces belongs to the chunk before it but for its last space; without such runs a plain split does.
        parts = [_CHUNK.split(t) if "  " in t else t.split(" ") for t in texts]
        heads = [p[0] for p in parts]
        for into, lead, chunks in ((self.first, "", set(heads)), (self.rest, " ", set().union(*parts))):
            fresh = list(chunks - into.keys())
            if fresh:
                self._learn(fresh, lead, into)
        many = np.fromiter(map(len, parts), np.int64, len(parts))
        numbers = np.fromiter(map(self.rest.__getitem__, chain.from_iterable(parts)), np.int64, int(many.sum()))
        numbers[np.cumsum(many) - many] = np.fromiter(map(self.first.__getitem__, heads), np.int64, len(heads))
        return numbers, many

    def _sizes(self, numbers: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = self.length[numbers].astype(np.int64)
        ends = np.cumsum(parts)
        total = np.append(0, np.cumsum(many))
        return many, total[ends] - total[ends - parts]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts laid end to end, and how many each text has."""
        numbers, parts = self._numbers(texts)
        many, size = self._sizes(numbers, parts)
        return self.flat[self._places(self.offset[numbers], many)], size

    def count(self, texts: list[str]) -> np.ndarray:
        return self._sizes(*self._numbers(texts))[1]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(held) -> Encoder:
    """One encoder per worker and broadcast vocabulary."""
    if held.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[held.id] = Encoder(Ranks(held.data))
    return _ENCODERS[held.id]


class _Held:
    """A broadcast vocabulary file: its size is fixed, whatever the corpus."""

    def __init__(self, spark: SparkSession, path: str, name: str) -> None:
        with open(f"{path}/{name}.tiktoken", "rb") as f:
            self._b = spark.sparkContext.broadcast(f.read())
        self.id = id(self)

    @property
    def data(self) -> bytes:
        return self._b.value


def _batches(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about AT_ONCE bytes, null as empty, with the index of the first."""
    start, size, run = 0, 0, []
    for i, t in enumerate(texts.to_pylist()):
        run.append(t or "")
        size += len(run[-1])
        if size > AT_ONCE:
            yield start, run
            start, size, run = i + 1, 0, []
    if run:
        yield start, run


def token_ids(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", path: str = VOCABULARIES) -> DataFrame:
    """(key, ids) for every row: the ids of its text without special tokens, whose strings are ordinary text.

    A null and an empty text have an empty list. Whole texts are encoded; a row's result doesn't depend on others.
    """
    held = _Held(df.sparkSession, path, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(held)
        for b in batches:
            for start, texts in _batches(b.column(1)):
                ids, size = enc.encode(texts)
                offsets = np.append(0, np.cumsum(size)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", path: str = VOCABULARIES) -> DataFrame:
    """(key, n_tokens) for every row; 0 for null and empty texts."""
    held = _Held(df.sparkSession, path, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(held)
        for b in batches:
            for start, texts in _batches(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(enc.count(texts).astype(np.int64))], names=[key, "n_tokens"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens bigint")
