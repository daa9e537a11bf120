"""Approximate nearest neighbours (10): NN-descent builds neighbour graphs; queries walk them greedily.

Unless told otherwise, `nearest` deals the nodes into blocks and builds and walks a graph in each (blocks.py). With `one_graph` it builds
one graph over all nodes by Spark joins, as told below: a query then measures fewer vectors, but vectors are shuffled again and again,
many times the input in each round.

Rows of equal vectors are one node, known by its smallest id and its first ids, so a vector that a third of all rows share costs
no more than another.

Graph: nodes first get neighbours from leaves of a few random-projection trees (a sign pattern, cut into chunks of LEAF
rows at most). Then each round joins neighbours of neighbours: a node's sampled neighbours, new ones first, and the nodes
that sampled it meet at the node with their vectors, all their distances are taken in one matrix product, and what improves a
member's list is sent to it. A list holds DEGREE neighbours; each task sends a hub SAMPLE links at most and REVERSE of them meet,
so no task gathers all of a hub's links. Rounds go on until a round changes at most CHANGE of the lists' entries.

Search: a query node begins with its own list. Each round it expands its nearest unexpanded nodes by a join with the
graph, fetches the vectors of nodes not seen before by another join, and measures them in double precision on the
original vectors, until its `beam` nearest are all expanded. Then the recall of PROBES query nodes is measured against brute
force, and while it is under `recall`, the beam grows by half and the search goes on from where it stands; so the beam grows with
the table as far as the vectors need it. Every row is indexed; nothing is fitted on a sample.

As queries are nodes, a graph with good lists needs a narrow beam only: what a query measures follows from the beam, not from the table.

Defined cases: vectors that are null, empty, all zero or hold a null or non-finite component take no part. Vectors of unequal length have
no distance, so each length is searched by itself; more than MOST_LENGTHS of them raise an error. Repeated rows of one id and vector are
one row; a null id takes no part. Equal distances go by id. A query without other rows has no result. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from joinscout.llm import blocks
from joinscout.llm.common import Scratch, grouped

DEGREE, SAMPLE, REVERSE, GIVEN = 64, 32, 32, 16
TREES, LEAF = 4, 256
#: Share of the lists' entries that the last round of descent may still change.
CHANGE = 0.07
#: Beam to begin with, and links back of a node that a search follows.
BEAM, LINKS_BACK = 48, 24
#: Least recall, and the query nodes on which it is measured.
RECALL, PROBES = 0.96, 100
MOST_LENGTHS = 64
SEED = 20240
NEIGHBOURS = "id bigint, ids array<bigint>, gaps array<float>"
GRAPH = "id bigint, vec binary, ids array<bigint>, gaps array<float>, fresh array<tinyint>"
MEMBERS = "id bigint, other bigint, vec binary, worst float, sent boolean"
#: Bytes of vectors that a task sends on at a time.
SENT_BYTES = 8 << 20


def packed(vectors: DataFrame, is_query: F.Column, id_column: str, vector_column: str) -> tuple[DataFrame, str]:
    """(vec_id, vec, asks) of the rows that take part, `vec` the bytes of floats or doubles without a negative zero, and numpy's name of these."""
    v, kind = F.col(vector_column), dict(vectors.dtypes)[vector_column]
    v = v if kind in ("array<float>", "array<double>") else v.cast("array<double>")
    dtype = "<f4" if kind == "array<float>" else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.and_(b.column(0).is_valid(), b.column(1).is_valid()))
            flat, sizes = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype), b.column(1).value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            odd, some = (np.concatenate(([0], np.cumsum(x))) for x in (~np.isfinite(flat), flat != 0))  # a null component is not a number here
            sound = (odd[ends] == odd[ends - sizes]) & (some[ends] > some[ends - sizes])
            raw = (flat + np.zeros(1, dtype))[np.repeat(sound, sizes)].tobytes()
            offsets = np.concatenate(([0], np.cumsum(sizes[sound]))) * np.dtype(dtype).itemsize
            vec = pa.Array.from_buffers(pa.binary(), int(sound.sum()), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
            rest = b.filter(pa.array(sound))
            yield pa.RecordBatch.from_arrays([rest.column(0), vec, rest.column(2)], names=["vec_id", "vec", "asks"])

    asks = is_query if is_query is not None else F.lit(False)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"), asks.alias("asks"))
    return rows.mapInArrow(pack, "vec_id bigint, vec binary, asks boolean"), dtype


def _firsts(most: int):
    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the rows (vec, vec_id) of a batch those with the `most` smallest ids of each vector."""
        for b in batches:
            code, ids = b.column(0).dictionary_encode().indices.to_numpy(), b.column(1).to_numpy()
            by = np.lexsort((ids, code))
            code, ids = code[by], ids[by]
            one = np.concatenate(([True], (code[1:] != code[:-1]) | (ids[1:] != ids[:-1])))[: len(by)]
            by, code = by[one], code[one]
            nth = np.arange(len(by)) - np.searchsorted(code, code)
            yield b.take(pa.array(by[nth < most]))

    return firsts


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _lists(keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray, gaps: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(gaps.astype(np.float32)))], names=["id", "ids", "gaps"])


def _nearest(points: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the points its nearest others (places, squared gaps); batched over a leading axis."""
    p = points - points.mean(-2, keepdims=True)
    square = (p * p).sum(-1)
    gap = square[..., :, None] + square[..., None, :] - 2 * (p @ np.swapaxes(p, -1, -2))
    n = gap.shape[-1]
    gap[..., np.arange(n), np.arange(n)] = np.inf
    keep = min(keep, n - 1)
    at = np.argpartition(gap, keep - 1, -1)[..., :keep] if keep < n - 1 else np.argsort(gap, -1)[..., :keep]
    return at, np.take_along_axis(gap, at, -1)


def _in_leaves(dtype: str):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in grouped(batches):
            leaf, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            vectors = _matrix(b.column(2), dtype).astype(np.float32)
            edges = np.concatenate(([0], np.flatnonzero(leaf[1:] != leaf[:-1]) + 1, [len(leaf)]))
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for s in range(a, z, 4 * LEAF):  # chunks are about LEAF long; this bounds the matrix whatever happens
                    own = slice(s, min(z, s + 4 * LEAF))
                    if own.stop - own.start > 1:
                        at, gap = _nearest(vectors[own], DEGREE)
                        yield _lists(ids[own], np.full(len(at), at.shape[1]), ids[own][at].ravel(), gap.ravel())

    return near


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's list of its DEGREE nearest, from the list it had (the row with its vector) and those found; `fresh` marks new entries."""
    for b in grouped(batches):
        key, sizes, own = b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy(), b.column(3).is_valid()
        held = own.to_numpy(zero_copy_only=False)
        ids, gaps = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
        keys, new = np.repeat(key, sizes), np.repeat(~held, sizes)
        order = np.lexsort((gaps, new, ids, keys))
        keys, ids, gaps, new = keys[order], ids[order], gaps[order], new[order]
        one = ids != keys
        one[1:] &= (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids, gaps, new = keys[one], ids[one], gaps[one], new[one]
        order = np.lexsort((ids, gaps, keys))
        keys, ids, gaps, new = keys[order], ids[order], gaps[order], new[order]
        nodes = key[held]
        start = np.searchsorted(keys, nodes)
        count_of = np.searchsorted(keys, nodes, "right") - start
        top = np.arange(len(keys)) - np.repeat(start, count_of) < DEGREE
        lists = _lists(nodes, np.minimum(count_of, DEGREE), ids[top], gaps[top])
        offsets = lists.column(1).offsets
        fresh = pa.ListArray.from_arrays(offsets, pa.array(new[top].astype(np.int8)))
        yield pa.RecordBatch.from_arrays([lists.column(0), b.column(3).filter(own), lists.column(1), lists.column(2), fresh], names=["id", "vec", "ids", "gaps", "fresh"])


def merged(graph: DataFrame, found: DataFrame) -> DataFrame:
    """The graph's lists (id, vec, ids, gaps), improved by lists (id, ids, gaps) found for its nodes."""
    rows = graph.select("id", "ids", "gaps", "vec").union(found.select("id", "ids", "gaps", F.lit(None).cast("binary")))
    return rows.repartition("id").sortWithinPartitions("id").mapInArrow(_merge, GRAPH)


def _mixed(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    """A hash of each pair and the turn, the same whenever a task is run again."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(turn * 0x165667B1)
    for shift in (31, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sampled(b: pa.RecordBatch, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """SAMPLE entries of each list (row, id), new ones first; columns id, ids, fresh."""
    sizes, ids, fresh = b.column(1).value_lengths().to_numpy(), b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((_mixed(b.column(0).to_numpy()[row], ids, turn), -fresh, row))
    nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    taken = order[nth < SAMPLE]
    return row[taken], ids[taken]


def _ask(turn: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, other): each node's sampled neighbours, whose vectors it wants."""
        for b in batches:
            row, other = _sampled(b, turn)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[row]), pa.array(other)], names=["id", "other"])

    return ask


def _send(turn: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each node with its vector, sent to itself and to its sampled neighbours; to one node REVERSE times at most in a task."""
        known, had = np.empty(0, np.int64), np.empty(0, np.int64)
        for whole in batches:
            step = max(16, SENT_BYTES // (SAMPLE * max(1, whole.column(3).nbytes // max(1, whole.num_rows))))
            for s in range(0, whole.num_rows, step):
                b = whole.slice(s, step)
                row, to = _sampled(b, turn)
                order = np.lexsort((row, to))
                row, to = row[order], to[order]
                names, first, n = np.unique(to, return_index=True, return_counts=True)
                at = np.searchsorted(known, names)
                there = at < len(known)
                there[there] = known[at[there]] == names[there]
                before = np.zeros(len(names), np.int64)
                before[there] = had[at[there]]
                fits = np.arange(len(to)) - np.repeat(first, n) + np.repeat(before, n) < REVERSE
                had[at[there]] += n[there]
                known, had = np.insert(known, at[~there], names[~there]), np.insert(had, at[~there], n[~there])
                row, to = np.concatenate((row[fits], np.arange(b.num_rows))), np.concatenate((to[fits], b.column(0).to_numpy()))
                by = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(to), b.column(0).take(by), b.column(3).take(by), b.column(4).take(by), pa.array(np.ones(len(to), bool))], names=["id", "other", "vec", "worst", "sent"])

    return send


def _invited(b: pa.RecordBatch, turn: int) -> pa.RecordBatch:
    """Each group's members once; of those only sent to it the node itself and REVERSE others."""
    key, other, sent = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(4).to_numpy(zero_copy_only=False)
    order = np.lexsort((sent, other, key))
    key, other, sent = key[order], other[order], sent[order] & (key[order] != other[order])
    one = np.ones(len(key), bool)
    one[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
    key, other, sent, order = key[one], other[one], sent[one], order[one]
    by = np.lexsort((_mixed(key, other, turn), sent, key))
    key, sent, order = key[by], sent[by], order[by]
    run = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (sent[1:] != sent[:-1]))))
    nth = np.arange(len(key)) - np.repeat(run, np.diff(np.append(run, len(key))))
    return b.take(pa.array(order[~sent | (nth < REVERSE)]))


def _meet(dtype: str, turn: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """At each node, its members' distances to each other; each member gets those that improve its list, GIVEN at most."""
        for every in grouped(batches):
            whole = _invited(every, turn)
            keys = whole.column(0).to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            step = 512
            for g in range(0, len(edges) - 1, step):
                bounds = edges[g : g + step + 1]
                b = whole.slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
                ids, vectors, worst = b.column(1).to_numpy(), _matrix(b.column(2), dtype).astype(np.float32), b.column(3).to_numpy()
                sizes = np.diff(bounds)
                group = np.repeat(np.arange(len(sizes)), sizes)
                at = np.arange(len(ids)) - np.repeat(bounds[:-1] - bounds[0], sizes)
                w = int(sizes.max())
                if w < 2:
                    continue
                cube = np.zeros((len(sizes), w, vectors.shape[1]), np.float32)
                cube[group, at] = vectors
                here = np.zeros((len(sizes), w), bool)
                here[group, at] = True
                name, limit = np.full((len(sizes), w), -1), np.zeros((len(sizes), w), np.float32)
                name[group, at], limit[group, at] = ids, worst
                square = (cube * cube).sum(-1)
                gap = square[:, :, None] + square[:, None, :] - 2 * (cube @ cube.transpose(0, 2, 1))
                gap = np.maximum(gap, 0)
                bad = ~here[:, None, :] | (gap >= limit[:, :, None]) | (name[:, :, None] == name[:, None, :])
                gap[bad] = np.inf
                if w > GIVEN:
                    best = np.argpartition(gap, GIVEN - 1, -1)[:, :, :GIVEN]
                    gap = np.take_along_axis(gap, best, -1)
                    other = np.take_along_axis(np.broadcast_to(name[:, None, :], bad.shape), best, -1)
                else:
                    other = np.broadcast_to(name[:, None, :], bad.shape)
                good = np.isfinite(gap) & here[:, :, None]
                n = good.sum(-1)
                some = n > 0
                yield _lists(name[some], n[some], other[good], gap[good])

    return meet


def _few(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """At most `limit` rows for each value of `by`, nearest first; Spark cuts a hub's rows to `limit` in each task before they meet."""
    nearest_first = Window.partitionBy(by).orderBy("gap", "other")
    return rows.withColumn("nth", F.row_number().over(nearest_first)).where(F.col("nth") <= limit).drop("nth")


def build_graph(nodes: DataFrame, dtype: str, scratch: Scratch, change: float = CHANGE) -> DataFrame:
    """(id, ids, gaps): each node's nearest nodes, found by NN-descent over `nodes` (id, vec)."""
    n = nodes.count()
    first = nodes.select("vec").first()
    dim = len(first["vec"]) // np.dtype(dtype).itemsize if first else 1
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    planes = np.random.default_rng(SEED).normal(size=(TREES, dim, max(bits, 1))).astype(np.float32)
    middle = scratch.spark.sparkContext.broadcast((planes, bits))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, b = middle.value
        for batch in batches:
            vectors = _matrix(batch.column(1), dtype).astype(np.float32) if batch.num_rows else np.zeros((0, h.shape[1]), np.float32)
            for tree in range(TREES):
                key = ((vectors @ h[tree] > 0) @ (1 << np.arange(h.shape[2], dtype=np.int64))) if b else np.zeros(len(vectors), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key * TREES + tree), *batch.columns], names=["leaf", "id", "vec"])

    leaves = nodes.select("id", "vec").mapInArrow(signed, "leaf bigint, id bigint, vec binary")
    counts = leaves.groupBy("leaf").count()
    chunk = F.pmod(F.xxhash64("id", "leaf"), F.ceil(F.col("count") / (2 * LEAF)))
    cut = leaves.join(counts, "leaf").select(F.xxhash64("leaf", chunk).alias("leaf"), "id", "vec")
    bare = nodes.select("id", "vec", F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<float>").alias("gaps"))
    graph = scratch.keep(merged(bare, cut.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_in_leaves(dtype), NEIGHBOURS)))
    worst = F.when(F.size("gaps") >= DEGREE, F.element_at("gaps", -1)).otherwise(F.lit(float("inf"))).cast("float").alias("worst")
    for descent in count():  # ends, as lists only get nearer
        turn = SEED + descent
        sent = graph.select("id", "ids", "fresh", "vec", worst).mapInArrow(_send(turn), MEMBERS)
        asked = graph.select("id", "ids", "fresh").mapInArrow(_ask(turn), "id bigint, other bigint")
        brought = asked.join(graph.select(F.col("id").alias("other"), "vec", worst), "other").select("id", "other", "vec", "worst", F.lit(False).alias("sent"))
        met = sent.union(brought).repartition("id").sortWithinPartitions("id")
        better = scratch.keep(merged(graph, met.mapInArrow(_meet(dtype, turn), NEIGHBOURS)))
        changed = better.agg(F.sum(F.aggregate("fresh", F.lit(0), lambda total, x: total + x))).first()[0] or 0
        scratch.drop(graph)
        scratch.free_shuffles()
        graph = better
        if changed <= change * n * DEGREE:
            return graph


STATE = "id bigint, vec binary, ids binary, gaps binary, fresh binary, front array<bigint>, seen array<bigint>"


def _pools(b: pa.RecordBatch, pools: list[tuple[np.ndarray, np.ndarray, np.ndarray]], beam: int) -> pa.RecordBatch:
    """Rows of STATE: the nearest unexpanded nodes of each pool, marked as expanded and given as its front, and all nodes seen."""
    columns: list[list] = [[], [], [], [], []]
    for ids, gaps, fresh in pools:
        at = np.flatnonzero(fresh[:beam])[: max(1, beam // 3)]
        fresh[at] = 0
        for column, x in zip(columns, (ids.tobytes(), gaps.tobytes(), fresh.tobytes(), ids[at], ids), strict=True):
            column.append(x)
    kinds = (pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "vec", "ids", "gaps", "fresh", "front", "seen"])


def _measure(dtype: str, beam: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds fetched nodes to each query's pool and takes the next step; columns id, vec, ids, gaps, fresh, new, vectors."""
        for whole in batches:
            for s in range(0, whole.num_rows, 64):
                b, pools = whole.slice(s, 64), []
                for vec, ids, gaps, fresh, new, vectors in zip(*(b.column(i).to_pylist() for i in range(1, 7)), strict=True):
                    mine = np.frombuffer(vec, dtype).astype(np.float64)
                    found = np.frombuffer(b"".join(vectors or ()), dtype).reshape(-1, len(mine)).astype(np.float64)
                    far = np.sqrt(((found - mine) ** 2).sum(1))
                    all_ids = np.concatenate((np.frombuffer(ids, np.int64), np.array(new or (), np.int64)))
                    all_gaps = np.concatenate((np.frombuffer(gaps, np.float64), far))
                    all_fresh = np.concatenate((np.frombuffer(fresh, np.int8), np.ones(len(far), np.int8)))
                    order = np.lexsort((all_ids, all_gaps))
                    pools.append((all_ids[order], all_gaps[order], all_fresh[order]))
                yield _pools(b, pools, beam)

    return measure


def _step(beam: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Takes the next step of pools that a wider beam gives more to expand."""
        for b in batches:
            kept = zip(*(b.column(i).to_pylist() for i in range(2, 5)), strict=True)
            yield _pools(b, [(np.frombuffer(i, np.int64), np.frombuffer(g, np.float64), np.frombuffer(f, np.int8).copy()) for i, g, f in kept], beam)

    return step


def _reach(queries: DataFrame, nodes: DataFrame, dtype: str, k: int) -> dict[int, tuple[int, float]]:
    """By brute force, for PROBES of the query nodes at most: how many nodes, itself among them, its k nearest others are, and the distance of the last."""
    asked = queries.orderBy(F.xxhash64("id"), "id").limit(PROBES).select("id", "vec").collect()
    points = [(r["id"], np.frombuffer(r["vec"], dtype).astype(np.float64)) for r in asked]

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [np.empty(0)] * len(points)
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                found = _matrix(whole.column(0).slice(s, 1024), dtype).astype(np.float64)
                for i, (_, mine) in enumerate(points):
                    top[i] = np.sort(np.concatenate((top[i], np.sqrt(((found - mine) ** 2).sum(1)))))[: k + 1]
        ids = np.repeat([i for i, _ in points], [len(x) for x in top]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(top))], names=["id", "gap"])

    if not points:
        return {}
    nearest_gaps = F.slice(F.array_sort(F.collect_list("gap")), 1, k + 1)
    least = nodes.select("vec").mapInArrow(far, "id bigint, gap double").groupBy("id").agg(nearest_gaps.alias("gaps"))
    return {r["id"]: (len(r["gaps"]), r["gaps"][-1]) for r in least.collect()}


def _recall(state: DataFrame, reach: dict[int, tuple[int, float]], k: int) -> float:
    """Share of the nearest others of the probed nodes that their pools hold."""
    pools = state.where(F.col("id").isin(list(reach))).select("id", F.substring("gaps", 1, 8 * (k + 1)).alias("gaps")).collect()
    held = sum(min(reach[r["id"]][0], int((np.frombuffer(r["gaps"]) <= reach[r["id"]][1]).sum())) - 1 for r in pools)
    return held / max(1, sum(n - 1 for n, _ in reach.values())) if any(n > 1 for n, _ in reach.values()) else 1.0


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, dtype: str, scratch: Scratch, k: int = 10, beam: int = BEAM, recall: float = RECALL) -> DataFrame:
    """(id, ids, gaps): the pool of each query node (id, vec), as bytes, nearest first; `beam` is what the search begins with."""
    ahead = graph.select("id", F.explode(F.arrays_zip("ids", "gaps")).alias("x")).select("id", F.col("x.ids").alias("other"), F.col("x.gaps").alias("gap"))
    back = _few(ahead.select(F.col("other").alias("id"), F.col("id").alias("other"), "gap"), "id", LINKS_BACK)
    around = scratch.keep(ahead.union(back).groupBy("id").agg(F.collect_set("other").alias("around")))
    reach = _reach(queries, nodes, dtype, k)
    empty = F.lit(b"")
    state = scratch.keep(queries.select("id", "vec", empty.alias("ids"), empty.alias("gaps"), empty.alias("fresh"), F.array("id").alias("new"), F.array("vec").alias("vectors")).mapInArrow(_measure(dtype, beam), STATE))
    while True:
        last = state
        if state.where(F.size("front") > 0).isEmpty():
            # A pool of which nothing is fresh has seen all nodes that links lead to.
            if _recall(state, reach, k) >= recall or state.where(F.hex("fresh").contains("01")).isEmpty():
                return state.select("id", "ids", "gaps")
            beam += max(1, beam // 2)
            state = scratch.keep(last.mapInArrow(_step(beam), STATE))
            scratch.drop(last)
            continue
        front = last.select(F.col("id").alias("query"), F.explode("front").alias("id")).join(around, "id")
        met = front.groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("around"))).alias("met"))
        fresh = met.join(last.select(F.col("id").alias("query"), "seen"), "query").select("query", F.explode(F.array_except("met", "seen")).alias("id"))
        fetched = fresh.join(nodes, "id").groupBy("query").agg(F.collect_list(F.struct("id", "vec")).alias("got"))
        joined = last.join(fetched, last.id == fetched["query"], "left").select("id", "vec", "ids", "gaps", "fresh", F.col("got.id").alias("new"), F.col("got.vec").alias("vectors"))
        state = scratch.keep(joined.mapInArrow(_measure(dtype, beam), STATE))
        scratch.drop(last)
        scratch.free_shuffles()


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", beam: int = BEAM, recall: float = RECALL, one_graph: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest other rows found, by Euclidean distance.

    The search begins with `beam`, which grows by half until `recall` is measured. `one_graph`: one graph of all rows, not one a block.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows, dtype = packed(vectors, is_query, id_column, vector_column)
    flat = scratch.keep(rows)
    lengths = [r[0] for r in flat.select(F.length("vec")).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    found = [_nearest_of_length(flat.where(F.length("vec") == n), dtype, scratch, k, beam, recall, one_graph) for n in sorted(lengths)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")


def _nearest_of_length(flat: DataFrame, dtype: str, scratch: Scratch, k: int, beam: int, recall: float, one_graph: bool) -> DataFrame:
    """`nearest` over rows (vec_id, vec, asks) whose vectors have one length."""
    # First ids of each vector: k + 1 of each batch, then of those, so that no vector's rows all meet in a task.
    parts = flat.select("vec", "vec_id").mapInArrow(_firsts(k + 1), "vec binary, vec_id bigint")
    members = parts.groupBy("vec").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("members"))
    nodes = scratch.keep(members.select(F.element_at("members", 1).alias("id"), "vec", "members"))
    # Two hashes stand for a vector here, so that the nodes' vectors need not be shuffled again.
    same = [F.xxhash64("vec").alias("one"), F.xxhash64("vec", F.lit(SEED)).alias("two")]
    named = nodes.select(*same, "id")
    asking = scratch.keep(flat.where("asks").select("vec_id", "vec", *same).distinct().join(named, ["one", "two"]).select("vec_id", "id", "vec"))
    scratch.free_shuffles()
    queries, points = asking.select("id", "vec").distinct(), nodes.select("id", "vec")
    if one_graph:
        best = _walked(queries, points, dtype, scratch, k, beam, recall)
    else:
        best = blocks.search(scratch.keep(queries), points, dtype, scratch, k + 1, beam, recall, CHANGE)
    # A node's members have one distance, so the k + 1 first members of all nodes found, by (distance, id), hold every answer.
    spread = best.join(nodes.select(F.col("id").alias("node"), "members"), "node").select("id", "score", F.explode("members").alias("vec_id"))
    firsts = spread.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("score", "vec_id"))).where(F.col("nth") <= k + 1)
    answers = firsts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    each = asking.select(F.col("vec_id").alias("query_id"), "id").join(answers, "id").select("query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("place", "x"))
    return each.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _walked(queries: DataFrame, nodes: DataFrame, dtype: str, scratch: Scratch, k: int, beam: int, recall: float) -> DataFrame:
    """(id, node, score): the nearest nodes of each query node (id, vec) that a search of one graph finds."""
    pools = search(queries, nodes, build_graph(nodes, dtype, scratch), dtype, scratch, k, beam, recall)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, ids, gaps in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own, gap = np.frombuffer(ids, np.int64), np.frombuffer(gaps, np.float64)
                own, gap = own[: int(np.searchsorted(gap, gap[: k + 1][-1], "right"))], gap[: int(np.searchsorted(gap, gap[: k + 1][-1], "right"))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), key)), pa.array(own), pa.array(gap)], names=["id", "node", "score"])

    return pools.mapInArrow(top, "id bigint, node bigint, score double")
