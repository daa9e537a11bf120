"""Substring dedup (6): level-wise doubling from 5 to 10 to 20 words.

A window of WINDOW words is judged by its anchor, the 5-word window in it of least hash (leftmost of equals). Equal
windows have equal anchors at equal places, so it is enough to look at anchors, about one place in nine. Consecutive
windows with one anchor form a run of at most WINDOW - 4 windows.

1. Level 5: anchors found once in the whole corpus drop out with all windows of their runs. Equal runs within a slice of
   input are reduced to their first occurrence before the shuffle, so a passage that fills a third of all rows sends
   one row a slice.
2. Equal runs are reduced to the first; every word of the others is covered by repeated windows.
3. Level 10: what is left (runs that share an anchor but differ, as at the ends of copied passages) must also share the
   10 words after the anchor, or the 5 words on either side of where it begins, as the window's place asks.
4. Level 20: surviving windows alone are compared as a whole. All but the first occurrence are removed.

A level without candidates ends the search. Windows are identified by two 64-bit hashes (the anchor's and the
window's). The words to remove are carried as ranges by document and applied to its text in one join.

How much each step removes depends on the texts: whole copied passages go in step 2 by runs, which are windows of 20 words grouped by
their level-5 anchor and compared as a whole (length 20 at once, for a run that has survived level 5); their ends, and passages that
begin or end differently, go through levels 10 and 20.

Defined cases: a null text has no words. Rows with equal doc_id and text are one document and get equal results; rows with
equal doc_id and unequal texts are told apart by a hash of the text, whose order decides between them. A null doc_id counts as
the smallest. Texts under WINDOW words lose nothing. Other columns stay unchanged in `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinscout.llm.common import Scratch, slices, unused

WINDOW = 20
ANCHOR = 5
#: Places an anchor can have in a window.
PLACES = WINDOW - ANCHOR + 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NULL_ID = -(1 << 63)
_HALF = np.uint64(32)


class _Hashes(dict):
    """Hashes of words, looked up many times."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


class Hashed:
    """Word hashes of some texts laid end to end, and rolling hashes by doubling: 5, 10 and 20 words from each place."""

    def __init__(self, texts: list[str | None]) -> None:
        known, found = _Hashes(), []
        sizes = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = t.encode("utf-8", "surrogatepass").split() if t else []
            sizes[i] = len(own)
            found.extend(map(known.__getitem__, own))
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        self.begins = self.ends - sizes
        code = np.array(found, np.uint64)
        total = len(code)
        rolled = np.zeros(total, np.uint64)
        for i in range(ANCHOR):
            rolled *= _BASE
            rolled[: max(0, total - i)] += code[i:]
        self.at = {ANCHOR: rolled}
        width = ANCHOR
        while width < WINDOW:
            rolled = self.at[width] * _power(width)
            rolled[: max(0, total - width)] += self.at[width][width:]
            width *= 2
            self.at[width] = rolled

    def hashes(self, width: int) -> np.ndarray:
        return _mixed(self.at[width] + np.uint64(width))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each run: its text, its first window's place, how many windows it has, and its anchor's place."""
        key = self.hashes(ANCHOR)
        best, width = np.arange(len(key)), 1
        while width < PLACES:
            step = min(width, PLACES - width)
            ahead = best[step:]
            best = np.concatenate((np.where(key[ahead] < key[best[: len(ahead)]], ahead, best[: len(ahead)]), best[len(ahead) :]))
            width += step
        doc = np.repeat(np.arange(len(self.sizes)), np.maximum(self.sizes - WINDOW + 1, 0))
        many = np.maximum(self.sizes - WINDOW + 1, 0)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.begins, many)
        anchor = best[place]
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))) if len(doc) else np.empty(0, np.int64)
        return doc[new], place[new], np.diff(np.append(new, len(doc))), anchor[new]


#: A run's place in its document, its number of windows and its anchor's place in it are packed into one long.
def _pack(start: np.ndarray, windows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 10) | (windows.astype(np.int64) << 5) | offset.astype(np.int64)


#: `key` is an anchor or a run's hash and `other` the other of them; `near` holds 32 bits each of the hashes of the 10 words from the anchor
#: on and of those from 5 before it.
DEALT = "key bigint, kind tinyint, other bigint, near bigint, doc bigint, text_hash bigint, pack bigint"
#: Kinds of dealt rows: keyed by anchor, keyed by run, anchors found twice in a slice, ranges that are repeated.
ONCE, OFTEN, VOTE, GONE = 0, 1, 2, 3
_DEALT = ("key", "kind", "other", "near", "doc", "text_hash", "pack")


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each slice of input, equal ones reduced to the first; a GONE row packs a range of words that are repeated."""
    for part, texts in slices(batches):
        h = Hashed(texts)
        ids = part.column(0).fill_null(_NULL_ID).to_numpy()
        text_hash = part.column(1).to_numpy()
        doc, place, windows, anchor = h.runs()
        if not len(doc):
            continue
        five, ten, twenty = h.hashes(ANCHOR), h.hashes(2 * ANCHOR), h.hashes(WINDOW)
        offset = anchor - place
        run = _mixed(twenty[place] * _BASE + twenty[place + windows - 1] + _pack(windows, offset, offset).view(np.uint64))
        start = place - h.begins[doc]
        order = np.lexsort((start, text_hash[doc], ids[doc], run))
        same = np.concatenate(([False], run[order[1:]] == run[order[:-1]]))
        # rows of equal doc_id and text are one document: their runs are one as well
        twin = np.concatenate(([False], (start[order[1:]] == start[order[:-1]]) & (ids[doc[order[1:]]] == ids[doc[order[:-1]]]) & (text_hash[doc[order[1:]]] == text_hash[doc[order[:-1]]])))
        lead = order[~same]
        first = ~same
        for i in np.flatnonzero(twin & same):
            first[i] = first[i - 1]
        gone = order[~first]
        gone = gone[np.lexsort((start[gone], doc[gone]))]
        key5 = five[anchor[lead]]
        _, inverse, count = np.unique(key5, return_inverse=True, return_counts=True)
        often = count[inverse] > 1
        vote = np.unique(key5[often])
        a = anchor[lead]
        back = np.maximum(a - ANCHOR, 0)
        g_doc, g_start, g_end = doc[gone], start[gone], start[gone] + windows[gone] + WINDOW - 1
        if len(gone):
            cut = np.flatnonzero(np.concatenate(([True], (g_doc[1:] != g_doc[:-1]) | (g_start[1:] > g_end[:-1]))))
            g_end = np.maximum.reduceat(g_end, cut)
            g_doc, g_start = g_doc[cut], g_start[cut]
        n, v, g = len(lead), len(vote), len(g_doc)
        columns = {
            "key": np.concatenate((np.where(often, run[lead], key5), vote, ids[g_doc].view(np.uint64))).view(np.int64),
            "kind": np.concatenate((np.where(often, OFTEN, ONCE), np.full(v, VOTE), np.full(g, GONE))).astype(np.int8),
            "other": np.concatenate((np.where(often, key5, run[lead]), np.zeros(v + g, np.uint64))).view(np.int64),
            "near": np.concatenate((((ten[a] >> _HALF) << _HALF) | (ten[back] >> _HALF), np.zeros(v + g, np.uint64))).view(np.int64),
            "doc": np.concatenate((ids[doc[lead]], np.zeros(v, np.int64), ids[g_doc])),
            "text_hash": np.concatenate((text_hash[doc[lead]], np.zeros(v, np.int64), text_hash[g_doc])),
            "pack": np.concatenate((_pack(start[lead], windows[lead], offset[lead]), np.zeros(v, np.int64), (g_start << 31) | g_end)),
        }
        yield pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in _DEALT], names=list(_DEALT))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of candidate runs: (anchor, whole, doc, text_hash, start)."""
    for part, texts in slices(batches):
        h = Hashed(texts)
        five, twenty = h.hashes(ANCHOR), h.hashes(WINDOW)
        runs = part.column(part.schema.get_field_index("runs"))
        rows = np.repeat(np.arange(len(texts)), runs.value_lengths().to_numpy())
        flat = runs.flatten()
        pack, side = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        start, windows, offset = pack >> 10, (pack >> 5) & 31, pack & 31
        # a window that has its anchor `offset - j` words in is vouched for by the 10 words after the anchor, or around it
        low = np.where(side == 0, np.maximum(offset - 2 * ANCHOR, 0), 0)
        high = np.where(side == 0, windows, np.minimum(windows, np.maximum(offset - 2 * ANCHOR, 0)))
        n = np.maximum(high - low, 0)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start + low, n)
        doc = np.repeat(rows, n)
        place = at + h.begins[doc]
        anchor = np.repeat(start + offset + h.begins[rows], n)
        ids = part.column(0).fill_null(_NULL_ID).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(five[anchor].view(np.int64)), pa.array(twenty[place].view(np.int64)), pa.array(ids[doc]), pa.array(part.column(1).to_numpy()[doc]), pa.array(at)], names=["anchor", "whole", "doc", "text_hash", "start"])


def repeated_ranges(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, text_hash, ranges): ranges (start, end) of words, of which all are covered by windows found earlier; they may overlap."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    dealt = base.mapInArrow(_dealt, DEALT).repartition("key")
    met = dealt.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    once = F.col("kind") == ONCE
    names = [F.when(once, F.col("key")).otherwise(F.col("other")).alias("anchor"), F.when(once, F.col("other")).otherwise(F.col("key")).alias("run")]
    level5 = scratch.keep(met.where(f"kind IN ({OFTEN}, {GONE}) OR kind = {ONCE} AND n > 1").select("kind", *names, "near", "doc", "text_hash", "pack"))
    scratch.free_shuffles()

    start, windows, offset = F.shiftright("pack", 10), F.shiftright("pack", 5).bitwiseAND(31), F.col("pack").bitwiseAND(31)
    gone = [level5.where(f"kind = {GONE}").select("doc", "text_hash", F.shiftright("pack", 31).alias("start"), F.col("pack").bitwiseAND((1 << 31) - 1).alias("end"))]
    by_run = Window.partitionBy("anchor", "run").orderBy("doc", "text_hash", "pack")
    ranked = scratch.keep(level5.where(f"kind IN ({ONCE}, {OFTEN})").withColumns({"nth": F.dense_rank().over(by_run), "row": F.row_number().over(by_run)}))
    gone.append(ranked.where("nth > 1").select("doc", "text_hash", start.alias("start"), (start + windows + (WINDOW - 1)).alias("end")))
    runs = ranked.where("row = 1")

    half = 2 * ANCHOR
    sides = F.array_compact(F.array(
        F.when(offset - windows + 1 <= half, F.struct(F.lit(0).alias("side"), F.shiftrightunsigned("near", 32).alias("ten"))),
        F.when(offset > half, F.struct(F.lit(1).alias("side"), F.col("near").bitwiseAND((1 << 32) - 1).alias("ten"))),
    ))
    level10 = runs.select("doc", "text_hash", "pack", "anchor", F.explode(sides).alias("s")).select("doc", "text_hash", "pack", "anchor", "s.*")
    often = level10.groupBy("anchor", "side", "ten").count().where("count > 1").drop("count")
    candidates = scratch.keep(level10.join(often, ["anchor", "side", "ten"]).select("doc", "text_hash", "pack", "side"))
    scratch.free_shuffles()
    if not candidates.isEmpty():
        by_doc = candidates.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("pack", "side")).alias("runs")).withColumnRenamed("text_hash", "own_hash").hint("merge")
        texts = base.join(by_doc, (F.coalesce("doc_id", F.lit(_NULL_ID)) == by_doc.doc) & (base.text_hash == by_doc.own_hash)).select("doc_id", "text_hash", "text", "runs")
        found = scratch.keep(texts.mapInArrow(_windows, "anchor bigint, whole bigint, doc bigint, text_hash bigint, start bigint"))
        scratch.free_shuffles()
        place = F.struct("doc", "text_hash", "start")
        firsts = found.groupBy("anchor", "whole").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
        gone.append(found.join(firsts, ["anchor", "whole"]).where(place > F.col("first")).select("doc", "text_hash", "start", (F.col("start") + WINDOW).alias("end")))
    out = gone[0]
    for g in gone[1:]:
        out = out.unionByName(g)
    ranges = scratch.keep(out.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("ranges")))
    scratch.drop(*(frame for frame, _ in scratch.kept if frame is not ranges))
    scratch.free_shuffles()
    return ranges


def _applied(added: tuple[str, str, str], held: str):
    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            yield _apply(part, texts, added, held)

    return applied


def _apply(part: pa.RecordBatch, texts: list[str | None], added: tuple[str, str, str], held: str) -> pa.RecordBatch:
    ranges = part.column(part.schema.get_field_index(held))
    sizes = ranges.fill_null([]).value_lengths().to_pylist() if part.num_rows else []
    flat = ranges.flatten()
    begins, ends = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    kept, n_words, n_removed, at = [], [], [], 0
    for text, size in zip(texts, sizes, strict=True):
        own = text.encode("utf-8", "surrogatepass").split() if text else []
        n_words.append(len(own))
        if size:
            edge = np.zeros(len(own) + 1, np.int64)
            np.add.at(edge, begins[at : at + size], 1)
            np.add.at(edge, ends[at : at + size], -1)
            keep = np.cumsum(edge[:-1]) == 0
            own = [w for w, k in zip(own, keep.tolist(), strict=True) if k]
            at += size
        n_removed.append(n_words[-1] - len(own))
        kept.append(b" ".join(own).decode("utf-8", "surrogatepass"))
    names = [n for n in part.schema.names if n != held]
    rest = [part.column(part.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*rest, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*names, *added])


def deduplicate(docs: DataFrame, added: tuple[str, str, str] = ("n_words", "n_removed", "kept")) -> DataFrame:
    """Adds n_words, n_removed and `kept` (the kept words joined by one space) to each row; they replace clashing columns."""
    source = docs.drop(*added)
    scratch = Scratch(docs.sparkSession, "substrings")
    ranges = repeated_ranges(source.select("doc_id", F.col("text").cast("string").alias("text")), scratch)
    doc, text_hash, held = unused(source.columns, "doc", "text_hash", "ranges")
    by_doc = ranges.select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), F.col("ranges").alias(held))
    keyed = source.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)), text_hash: F.xxhash64(F.col("text").cast("string"))})
    joined = keyed.join(by_doc.hint("merge"), [doc, text_hash], "left").drop(doc, text_hash)
    schema = T.StructType([*source.schema.fields, *(T.StructField(n, k) for n, k in zip(added, (T.LongType(), T.LongType(), T.StringType()), strict=True))])
    return joined.mapInArrow(_applied(added, held), schema)
