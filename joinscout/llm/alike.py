"""Near copies by similarity: documents whose sets of word shingles have a Jaccard similarity of LEAST or more.

1. Each text's shingles are hashed as in simhash; equal sets are one node. Candidates come from two sides: simhash's fingerprints of
   these sets, linked within its RADIUS by its pigeonhole, and BANDS bands of ROWS MinHash values that name buckets. Fingerprints
   reach the closest pairs only (similarity 0.8 means about ten bits apart, where parts of 64 bits no longer prune); two sets of
   similarity 0.8 share no band with a chance of (1 - 0.8**ROWS)**BANDS, 5e-8.
2. Nodes of a bucket are linked to its smallest one, and components of all links hold all candidate pairs.
3. One text of each candidate set goes to its component, cut into a grid of cells above CELL nodes, and sets are compared exactly
   there; a cell gives a spanning forest of its links, never all pairs. Components follow from those.

Defined cases: null, empty and blank texts have one set, texts of fewer words than a shingle the whole sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from joinscout.llm.common import Scratch, grouped, slices, unused
from joinscout.llm.components import components
from joinscout.llm.simhash import links as simhash_links
from joinscout.llm.simhash import majority

SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = 4, 5
BANDS, ROWS = 32, 4
CELL = 2048
SEED = 42
_KEYS = np.random.default_rng(SEED).integers(1, 2**63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - shingle + 1)
    spans = zip(begins[:n].tolist(), ends[min(shingle, len(found)) - 1 :].tolist() or [0], strict=True)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:z], SEED) for a, z in spans), np.uint64, n))


def bands(own: np.ndarray) -> np.ndarray:
    least = np.full((BANDS * ROWS, 1), 2**64 - 1, np.uint64)
    for s in range(0, len(own), 2048):
        x = own[s : s + 2048] * _KEYS[0]
        x = (x ^ (x >> np.uint64(32))) * _KEYS[1]
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(1, keepdims=True))
    named = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(named)], np.uint64).view(np.int64)


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text_hash, *more, text) of each row; the first two tell texts apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), *more, text.alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, fp, bands, again) of each id and text; node names the set of shingles, `again` tells of repeated rows."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            nodes, fps, named = [], [], []
            for text in texts:
                own = shingles(text)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                fps.append(majority(own))
                named.append(bands(own))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(named)))
            numbers = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *numbers, lists], names=["doc_id", "text_hash", "node", "fp", "bands"])

    found = _rows(docs).mapInArrow(sketched, "doc_id bigint, text_hash bigint, node bigint, fp bigint, bands array<bigint>")
    return found.groupBy("doc_id", "text_hash", "node", "fp").agg(F.first("bands").alias("bands"), (F.count(F.lit(1)) > 1).alias("again"))


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between the places of sets that are alike, spanning all such pairs: each set is compared with those not reached yet."""
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begins = np.cumsum(sizes) - sizes
    mark = np.zeros(int(codes.max()) + 1, bool)
    left, out = np.arange(len(sets)), []
    up, down = LEAST
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            i = reached.pop()
            own = codes[begins[i] : begins[i] + sizes[i]]
            near = left[(down * sizes[left] >= up * sizes[i]) & (up * sizes[left] <= down * sizes[i])]
            if not len(near):
                continue
            mark[own] = True
            n = sizes[near]
            first = np.cumsum(n) - n
            both = np.add.reduceat(mark[codes[np.arange(n.sum()) - np.repeat(first - begins[near], n)]], first, dtype=np.int64)
            mark[own] = False
            hit = near[(up + down) * both >= up * (sizes[i] + n)]
            out += [(i, j) for j in hit.tolist()]
            reached += hit.tolist()
            left = np.setdiff1d(left, hit, assume_unique=True)
    return out


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each node of a band, in order, to the band's first."""
    held, least = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        band, node = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
        first = node[new]
        if held == band[0]:
            first[0] = least
        held, least = band[-1], first[-1]
        to = np.repeat(first, np.diff(np.append(new, len(band))))
        yield pa.RecordBatch.from_arrays([pa.array(node[node != to]), pa.array(to[node != to])], names=["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of alike sets of each cell; rows are (cell, node, text)."""
    for b in grouped(batches):
        cell, node = b.column(0).to_numpy(), b.column(1).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]))
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if z - a > 1 and (found := forest([shingles(x) for x in b.column(2).slice(a, z - a).to_pylist()])):
                at = a + np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]])], names=["a", "b"])


def links(rows: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between the nodes of `rows` (sketches of `docs`) that span all pairs of LEAST similarity among the candidates."""
    one = rows.groupBy("node").agg(F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.min(F.struct("doc_id", "text_hash", "again")).alias("x"))
    one = scratch.keep(one.select("node", "bands", "fp", "x.doc_id", "x.text_hash", "x.again"))
    named = scratch.keep(one.groupBy("fp").agg(F.min("node").alias("rep")))
    print_links = simhash_links(named, scratch.spark).unionByName(one.join(named, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")))
    dealt = one.select(F.explode("bands").alias("band"), "node").repartition("band").sortWithinPartitions("band", "node")
    stars = dealt.mapInArrow(_stars, "a bigint, b bigint")
    near = scratch.keep(components(stars.unionByName(print_links), scratch))
    sized = near.join(near.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("chunks")), "component")
    # texts move once, by a merge join at every size; on from there those of candidates alone, one for each set
    wanted = scratch.keep(sized.join(one, "node").select(_key("doc_id").alias("key"), "text_hash", "node", "component", "chunks", "again"))
    scratch.drop(one, named, near)
    scratch.free_shuffles()
    texts = _rows(docs).select(_key("doc_id").alias("key"), "text_hash", "text").join(wanted.hint("merge"), ["key", "text_hash"])
    texts = texts.where("NOT again").unionByName(texts.where("again").dropDuplicates(["node"]))
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    cells = texts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    cell = F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other"))
    placed = cells.select(cell.alias("cell"), "node", "text").repartition("cell").sortWithinPartitions("cell", "node")
    return placed.mapInArrow(_compare, "a bigint, b bigint")


def _key(doc_id: str) -> F.Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(doc_id).isNull())


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, in whole: that of the smallest doc_id, null ones last."""
    scratch = Scratch(docs.sparkSession, "alike")
    rows = scratch.keep(sketches(docs))
    linked = components(links(rows, docs, scratch), scratch)
    grouped = rows.select("node", "doc_id", "text_hash", "again").join(linked, "node", "left").withColumn("group", F.coalesce("component", "node"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    least = grouped.groupBy("group").agg(F.min(place).alias("x"))
    key, text_hash, nth, kept, again, part = unused(docs.columns, "key", "text_hash", "nth", "kept", "again", "part")
    judged = grouped.join(least, "group").select(_key("doc_id").alias(key), F.col("text_hash").alias(text_hash), (place == F.col("x")).alias(kept), F.col("again").alias(again))
    # what goes, and what stays of rows that repeat id and text
    judged = scratch.keep(judged.where(~F.col(kept) | F.col(again)))
    scratch.drop(rows)
    scratch.free_shuffles()
    hashed = docs.withColumns({key: _key("doc_id"), text_hash: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    # both branches read one exchange of the texts; rows that repeat are cut down in parts, so that none is too large for a task
    joined = hashed.join(judged.hint("merge"), [key, text_hash], "left")
    alone = joined.where(F.col(kept).isNull())
    repeated = joined.where(F.col(kept) & F.col(again)).withColumn(part, F.spark_partition_id())
    for by in ((key, text_hash, part), (key, text_hash)):
        first = Window.partitionBy(*by).orderBy("text")
        repeated = repeated.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1)
    return alone.select(*docs.columns).unionByName(repeated.select(*docs.columns))
