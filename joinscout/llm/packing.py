"""Packing (1): order-preserving dynamic programming over cuts at document and sentence boundaries.

Each task lays the tokens of its rows end to end, each document followed by END, and chooses cuts so that windows of at
most WINDOW tokens have the least padding plus truncation penalties, and a small price a window. A window is padded to WINDOW, except that one whose
length is a power of two stays as it is. The best predecessor of a cut is the least f(i) + i within WINDOW tokens before
it, which a monotone queue keeps in constant time a cut; windows of a power of two add a few more transitions.

The stream is worked through in buffers of BUFFER tokens: cuts well before the end of a buffer are settled, the rest goes on
to the next one. So memory is bounded, and only the last window of a task is filled by chance. There is no shuffle: windows
never span tasks, and a repeated task gives the same windows and ids.

Defined cases: a null or empty text is END alone. Repeated rows are packed each by itself. A gap without a boundary longer than
STRIDE gets cuts every STRIDE tokens, at the penalty of a cut inside a sentence. Other columns are dropped. An empty table gives no windows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from joinscout.llm.common import slices

WINDOW = 2048
END = 1
#: Tokens of padding that a cut is worth: between documents nothing, between sentences and inside a sentence more; and a sequence.
SENTENCE_CUT, INNER_CUT, SEQUENCE = 4, 16, 8
STRIDE = 256
BUFFER = 1 << 20
#: Powers of two that windows may have besides WINDOW.
SHORT = tuple(1 << k for k in range(10, 5, -1))
ENDINGS = (".", "!", "?", "\n", "…", "。")


class Tokens:
    """Ids of texts by a byte-level BPE tokenizer file (tokenizers' JSON).

    If ids follow the order of merges, as they do for byte-level vocabularies, the file's own merges are handed to a
    faster library that gives the same ids; otherwise, and for texts whose runs of white space are too long for the faster
    one's pattern matcher, the tokenizers library is used.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre = file["model"], file["pre_tokenizer"]
        special = {x["content"]: x["id"] for x in file["added_tokens"]}
        vocab = {k: v for k, v in model["vocab"].items() if k not in special}
        # printable stand-ins of bytes, as byte-level BPE defines them: printable Latin-1 as itself, the rest from U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.text = {i: bytes(map(byte.__getitem__, k)) for k, i in vocab.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ordered = all(vocab["".join(p)] == 256 + i for i, p in enumerate(pairs)) and not model.get("ignore_merges")
        usual = file["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in file["added_tokens"])
        self.fast = None
        if ordered and usual:
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in self.text.items()}, special_tokens=special)
        self.slow = Tokenizer.from_file(path)
        self.ends = np.zeros(max([*self.text, *special.values()]) + 1, bool)
        endings = tuple(x.encode() for x in ENDINGS)
        self.ends[[i for i, b in self.text.items() if b.endswith(endings)]] = True

    def encode(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
            except ValueError:  # the pattern matcher's stack ends within a long run of white space
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def tokens(path: str) -> Tokens:
    return Tokens(path)


def choose_cuts(places: np.ndarray, costs: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indexes into `places` (increasing, the first and last fixed; gaps of at most `window`) of the cheapest cuts; `costs` hold a sequence's."""
    last = len(places) - 1
    index = np.full(int(places[-1]) + 1, -1, np.int64)
    index[places] = np.arange(last + 1)
    more: dict[int, list[int]] = {}
    for size in SHORT:
        if size < window:
            at = np.flatnonzero(places >= size)
            before = index[places[at] - size]
            for j, i in zip(at[before >= 0].tolist(), before[before >= 0].tolist(), strict=True):
                more.setdefault(j, []).append(i)
    where, cost = places.tolist(), costs.tolist()
    total, came = [0.0] * (last + 1), [0] * (last + 1)
    queue, head = [0], 0  # indexes whose total + place increases; the head is the best within the window
    keys = [float(where[0])]
    for j in range(1, last + 1):
        p = where[j]
        while where[queue[head]] < p - window:
            head += 1
        i = queue[head]
        best = keys[head] + window - p
        if j in more:
            for k in more[j]:
                if total[k] < best:
                    best, i = total[k], k
        came[j] = i
        best += cost[j]
        total[j] = best
        key = best + p
        while len(queue) > head and keys[-1] >= key:
            queue.pop()
            keys.pop()
        queue.append(j)
        keys.append(key)
    out = [last]
    while out[-1]:
        out.append(came[out[-1]])
    return out[::-1]


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class _Stream:
    """The tokens of a task that are not settled yet, and their documents."""

    def __init__(self, task: int, window: int) -> None:
        self.window, self.next_id = window, task << 33
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple] = []  # doc_id, tokens of it before the buffer, tokens of it in all
        self.marks: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray, sentence_ends: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids)))
        self.parts.append(ids)
        self.marks.append(sentence_ends + self.size)
        self.size += len(ids)

    def settle(self, final: bool) -> dict[str, list]:
        """Pieces of the windows that are settled; the rest of the buffer stays."""
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
        if not self.size:
            return out
        ids = np.concatenate(self.parts)
        sizes = np.array([n - before for _, before, n in self.docs], np.int64)
        ends = np.cumsum(sizes)
        cost = np.full(self.size + 1, -1, np.int8)
        cost[np.concatenate(self.marks)] = SENTENCE_CUT
        cost[0] = 0
        cost[ends] = 0
        places = np.flatnonzero(cost >= 0)
        gaps = np.diff(places)
        if len(wide := np.flatnonzero(gaps > STRIDE)):
            n = (gaps[wide] - 1) // STRIDE
            inner = np.repeat(places[wide], n) + STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
            cost[inner] = INNER_CUT
            places = np.flatnonzero(cost >= 0)
        cuts = places[choose_cuts(places, cost[places] + SEQUENCE, self.window)]
        if not final:
            cuts = cuts[cuts <= self.size - 16 * self.window]
        doc, begins, raw = 0, ends - sizes, ids.astype("<u4").tobytes()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = a
            while at < b:
                while ends[doc] <= at:
                    doc += 1
                upto = min(b, int(ends[doc]))
                doc_id, before, n = self.docs[doc]
                for k, v in zip(out, (doc_id, before + at - int(begins[doc]), upto - at, raw[4 * at : 4 * upto], n, self.next_id, at - a), strict=True):
                    out[k].append(v)
                at = upto
            self.next_id += 1
        done = int(cuts[-1])
        left = int(np.searchsorted(ends, done, "right"))
        if left < len(self.docs):
            doc_id, before, n = self.docs[left]
            self.docs = [(doc_id, before + done - int(begins[left]), n), *self.docs[left + 1 :]]
        else:
            self.docs = []
        marks = np.concatenate(self.marks)
        self.parts, self.marks = ([ids[done:]] if done < self.size else []), [marks[marks > done] - done]
        self.size -= done
        return out


def _packer(path: str, window: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens(path)
        stream = _Stream(TaskContext.get().partitionId(), window)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

        def settled(final: bool) -> pa.RecordBatch:
            found = stream.settle(final)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found.values(), kinds, strict=True)], names=list(found))

        for part, texts in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                ids = np.append(coder.encode(text or ""), np.uint32(END))
                stream.add(doc_id, ids, np.flatnonzero(coder.ends[ids]) + 1)
                if stream.size >= BUFFER:
                    yield settled(False)
        yield settled(True)

    return packed


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of documents (doc_id, start, length, ids as little-endian uint32, doc_tokens, sequence_id, offset)."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_packer(path, window), PIECES)
