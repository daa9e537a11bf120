"""Byte-level BPE encoding and decoding (7) with padded numpy matrices.

A text is cut by the pre-tokenizer's pattern; each distinct piece is encoded once. Pieces are bucketed by length and laid
in padded matrices of byte ids. In each round every row merges its leftmost pair of least rank at once: ranks come from
a hashed table of pairs, merged places are closed up, and finished rows leave the matrix. Pieces above LONG bytes share no matrix:
each is a row by itself, in which all places of the least rank merge in one round, so that rounds are bounded by the ranks in use.

Decoding joins the bytes of ids by one gather over at most DECODED ids at a time, plus one row.

Defined cases: a null or empty text has no ids and decodes to no bytes. Repeated rows get equal results. Ids that the
vocabulary lacks raise an error. Other columns stay; `ids` and `decoded` replace clashing ones.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from joinscout.llm.common import slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BUCKETS = (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256)
LONG = BUCKETS[-1]
#: Cells of a matrix at once, and distinct pieces that a worker remembers.
CELLS = 1 << 20
REMEMBERED = 1 << 18
#: Bytes of text encoded at once; a piece takes about 100 bytes as an object.
AT_ONCE = 2 << 20
DECODED = 1 << 20
NONE = np.int32(np.iinfo(np.int32).max)


class Pairs:
    """Hashed lookup (left id, right id) -> id of the merged token, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(len(key) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.merged = np.full(1 << self.bits, NONE, np.int32)
        self.probes = 0
        at, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[at[todo]] == np.iinfo(np.uint64).max
            first = np.unique(at[todo[free]], return_index=True)[1]
            put = todo[free][first]
            self.keys[at[put]], self.merged[at[put]] = key[put], merged[put]
            placed = np.zeros(len(key), bool)
            placed[put] = True
            todo = todo[~placed[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, NONE for those that don't merge; ids below 0 are padding."""
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = (left.ravel()[todo].astype(np.uint64) << np.uint64(32)) | right.ravel()[todo].astype(np.uint64)
        at, flat = self._slot(key), out.ravel()
        for _ in range(self.probes):
            there = self.keys[at]
            hit = there == key
            flat[todo[hit]] = self.merged[at[hit]]
            on = ~hit & (there != np.iinfo(np.uint64).max)
            if not on.any():
                break
            todo, key, at = todo[on], key[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


class Vocabulary:
    """Ranks of a tiktoken file; an id is its rank."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        top = max(self.ids.values()) + 1
        self.single = np.full(256, -1, np.int32)
        for b in range(256):
            self.single[b] = self.ids[bytes([b])]
        left, right, merged = [], [], []
        for token, i in self.ids.items():
            for k in range(1, len(token)):
                if (a := self.ids.get(token[:k])) is not None and (b := self.ids.get(token[k:])) is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
        self.pairs = Pairs(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32))
        #: Whether no merge makes a pair of lower rank than its own.
        self.rising = all(m > a and m > b for a, b, m in zip(left, right, merged, strict=True))
        by_id = dict(map(reversed, self.ids.items()))
        self.sizes = np.array([len(by_id.get(i, b"")) for i in range(top)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(top)), np.uint8)
        self.known: dict[str, bytes] = {}
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most `width` bytes."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        out = np.full((n, width), -1, np.int32)
        rows = np.arange(n)
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(1)  # the leftmost of the least
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                out[rows[done], :width] = ids[done]
                rows, ids, ranks, at, best = rows[~done], ids[~done], ranks[~done], at[~done], best[~done]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            ids[each, at] = best
            # close up the place after the merged one, in ids and in ranks
            behind = np.arange(width - 1) > at[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            right = np.where(at + 1 < width, ids[each, np.minimum(at + 1, width - 1)], -1)
            ranks[each, np.minimum(at, width - 2)] = np.where(at <= width - 2, self.pairs.find(best, right), NONE)
            some = at > 0
            ranks[each[some], at[some] - 1] = self.pairs.find(ids[each[some], at[some] - 1], best[some])
            used = int((ids >= 0).sum(1).max())
            if used < width:  # compaction: columns that no row needs any more
                width = max(used, 2)
                ids, ranks = ids[:, :width], ranks[:, : width - 1]
        lengths = (out >= 0).sum(1)
        flat = out[out >= 0].astype("<i4")
        return np.split(flat, np.cumsum(lengths)[:-1])

    def _row(self, piece: bytes) -> np.ndarray:
        """The same merges for one piece of any length, as a matrix of one row: all places of the least rank merge in one round, leftmost first.

        That gives what one merge a round gives, as a merge changes only the pairs beside it: places share a token only in runs,
        of which every other one merges, and a round ends at the first merge that makes a pair of lower rank. Merged places are
        skipped by links and closed up when half of the row is gone.
        """
        ids = self.single[np.frombuffer(piece, np.uint8)]
        while True:
            n = len(ids)
            ids = np.append(ids, np.int32(-1))  # padding, so that each place has a next one
            after, before = np.arange(1, n + 2), np.arange(-1, n)
            ranks = np.append(self.pairs.find(ids[:-1], ids[1:]), NONE)
            left = n
            while 2 * left >= n:
                least = ranks.min()
                if least == NONE:
                    return ids[ids >= 0].astype("<i4")
                at = np.flatnonzero(ranks == least)
                joined = np.concatenate(([False], after[at[:-1]] == at[1:]))
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(joined, 0, place))) % 2 == 0]
                right = after[at]
                rest = after[right]
                if not self.rising:
                    lower = self.pairs.find(np.full(len(at), least), ids[rest]) < least
                    old = np.where(np.concatenate(([False], rest[:-1] == at[1:])), least, ids[before[at]] * (before[at] >= 0) - (before[at] < 0))
                    lower |= self.pairs.find(old.astype(np.int32), np.full(len(at), least)) < least
                    upto = int(lower.argmax()) + 1 if lower.any() else len(at)
                    at, right, rest = at[:upto], right[:upto], rest[:upto]
                ids[at], ids[right] = least, -1
                ranks[right] = NONE
                after[at], before[rest] = rest, at
                ranks[at] = self.pairs.find(np.full(len(at), least), ids[rest])
                inner = at[before[at] >= 0]
                ranks[before[inner]] = self.pairs.find(ids[before[inner]], ids[inner])
                left -= len(at)
            ids = ids[ids >= 0]

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces into `known`, as little-endian int32."""
        buckets: dict[int, list[str]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            if (i := self.ids.get(raw)) is not None:
                self.known[p] = i.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.known[p] = self._row(raw).tobytes()
            else:
                buckets.setdefault(next(b for b in BUCKETS if b >= len(raw)), []).append(p)
        for width, own in buckets.items():
            step = max(1, CELLS // width)
            for i in range(0, len(own), step):
                part = own[i : i + step]
                for p, ids in zip(part, self._matrix([x.encode("utf-8", "surrogatepass") for x in part], width), strict=True):
                    self.known[p] = ids.tobytes()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text ends."""
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn({p for pieces in cut for p in pieces}.difference(self.known))
        get = self.known.__getitem__
        joined = [b"".join(map(get, pieces)) for pieces in cut]
        ends = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)) // 4)
        return np.frombuffer(b"".join(joined), "<i4"), ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts end to end, and where each text ends."""
        sizes = self.sizes[ids]
        if (sizes == 0).any():
            raise ValueError("an id isn't in the vocabulary")
        upto = np.cumsum(sizes)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.starts[ids] - (upto - sizes), sizes)
        return self.blob[at], np.concatenate(([0], upto))[ends]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _offsets(ends: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], ends)).astype(np.int32))


def _with(frame: DataFrame, name: str, kind: T.DataType, function) -> DataFrame:
    source = frame.drop(name)
    return source.mapInArrow(function, T.StructType([*source.schema.fields, T.StructField(name, kind)]))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Adds `ids`, an array of int, to each row; narrow."""
    path = path or public_tokenizers.path(VOCABULARY)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, limit=AT_ONCE):
            ids, ends = vocabulary(path).encode(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(_offsets(ends), pa.array(ids, pa.int32()))], names=[*part.schema.names, "ids"])

    return _with(docs, "ids", T.ArrayType(T.IntegerType()), encoded)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds `decoded`, the bytes of `ids`, to each row; narrow. Null ids decode to no bytes."""
    path = path or public_tokenizers.path(VOCABULARY)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            upto = np.cumsum(b.column(b.schema.get_field_index("ids")).value_lengths().fill_null(0).to_numpy())
            i = 0
            while i < b.num_rows:
                size = max(1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + DECODED, "right")) - i)
                part = b.slice(i, size)
                column = part.column(part.schema.get_field_index("ids"))
                ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy())
                raw, at = vocabulary(path).decode(column.flatten().to_numpy(), ends)
                out = pa.Array.from_buffers(pa.binary(), len(ends), [None, _offsets(at).buffers()[1], pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*part.schema.names, "decoded"])
                i += size

    return _with(encoded, "decoded", T.BinaryType(), decoded)
