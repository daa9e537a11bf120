"""Buckets of character 3-grams and SimHash of whole Arrow columns in numpy: what `portable` offers as column expressions.

A gram's bucket is an md5, so each worker remembers the buckets of the grams that it has met; texts share most of theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about so many bytes, which bounds the arrays made of them.
SLICE_BYTES = 1 << 20
_UNKNOWN = -1


@cache
def _ascii_table(n: int) -> np.ndarray:
    """The bucket of each gram of three 7-bit characters, filled as grams are met."""
    return np.full(1 << 21, _UNKNOWN, np.int32)


@cache
def _wide_table(n: int) -> dict[int, int]:
    """The same for grams of other characters, by their code points."""
    return {}


def _bucket(gram: bytes, n: int) -> int:
    return int(hashlib.md5(gram).hexdigest()[:7], 16) % n


def _ascii_buckets(codes: np.ndarray, n: int) -> np.ndarray:
    table = _ascii_table(n)
    found = table[codes]
    if (found == _UNKNOWN).any():
        for c in np.unique(codes[found == _UNKNOWN]).tolist():
            table[c] = _bucket(bytes((c >> 14, c >> 7 & 127, c & 127)), n)
        found = table[codes]
    return found


def _wide_buckets(codes: np.ndarray, n: int) -> np.ndarray:
    table = _wide_table(n)
    kinds, at = np.unique(codes, return_inverse=True)
    out = np.empty(len(kinds), np.int32)
    for i, c in enumerate(kinds.tolist()):
        if (found := table.get(c)) is None:
            found = _bucket("".join(map(chr, (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF))).encode(), n)
            if len(table) < 1 << 20:
                table[c] = found
        out[i] = found
    return out[at]


def _padded(characters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts behind one another, each as ^^text$$, and where a gram begins: everywhere but at the last two places of a text."""
    ends = np.cumsum(lengths + 4)
    starts = ends - lengths - 4
    out = np.empty(len(characters) + 4 * len(lengths), characters.dtype)
    text = np.ones(len(out), bool)
    for at, mark in ((starts, "^"), (starts + 1, "^"), (ends - 2, "$"), (ends - 1, "$")):
        out[at] = ord(mark)
        text[at] = False
    out[text] = characters
    begins = np.ones(len(out), bool)
    begins[ends - 2] = begins[ends - 1] = False
    return out, begins[:-2]


def counts(data: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """(texts, n): how many grams of each text fall into each bucket. `data` holds the UTF-8 of all, `lengths` the bytes of each."""
    if (data < 128).all():
        marked, begins = _padded(data, lengths)
        c = marked.astype(np.int32)
        found = _ascii_buckets((c[:-2] << 14 | c[1:-1] << 7 | c[2:])[begins], n)
    else:
        first = np.concatenate(([0], np.cumsum(data & 0xC0 != 0x80)))  # characters before each byte
        ends = np.cumsum(lengths)
        lengths = first[ends] - first[ends - lengths]
        marked, begins = _padded(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), lengths)
        c = marked.astype(np.int64)
        found = _wide_buckets((c[:-2] << 42 | c[1:-1] << 21 | c[2:])[begins], n)
    rows = np.repeat(np.arange(len(lengths), dtype=np.int64) * n, lengths + 2)
    return np.bincount(rows + found, minlength=len(lengths) * n).reshape(-1, n)


def slices(texts: pa.Array) -> Iterator[np.ndarray]:
    """Bytes and lengths of the texts of an Arrow string column, a slice at a time; a null has length 0."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES)) - 1)
        end = min(end, len(texts), start + 8192)
        yield data[offsets[start] : offsets[end]], np.diff(offsets[start : end + 1])
        start = end


def _valid(texts: pa.Array) -> pa.Buffer | None:
    return texts.is_valid().buffers()[1] if texts.null_count else None


def simhashes(texts: pa.Array, planes: np.ndarray) -> pa.Array:
    """A string of bits for each lower-cased text: the signs of its bucket counts against each plane; null stays null."""
    bits, n = planes.shape
    parts = [((counts(*part, n).astype(np.float64) @ planes.T > 0) + ord("0")).astype(np.uint8) for part in slices(texts)]
    data = np.concatenate(parts) if parts else np.empty((0, bits), np.uint8)
    offsets = np.arange(len(texts) + 1, dtype=np.int32) * bits
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data), _valid(texts), texts.null_count)


def vectors(texts: pa.Array, n: int) -> pa.Array:
    """The bucket counts of each lower-cased text as a list of n doubles; null stays null."""
    parts = [counts(*part, n).astype(np.float64) for part in slices(texts)]
    flat = np.concatenate(parts).ravel() if parts else np.empty(0)
    offsets = np.arange(len(texts) + 1, dtype=np.int32) * n
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=texts.is_null() if texts.null_count else None)
