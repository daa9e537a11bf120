"""SimHash near-dedup (9): fingerprints linked by the generalised pigeonhole principle.

1. Fingerprints: 64 majority bits over the XXH64 hashes of word shingles, repeats included. Equal ones are one node.
2. Correlated bits are grouped into parts of equal width, by a 64 x 64 table of co-occurrence summed over all nodes.
3. Each fingerprint divides radius + 1 distance shells among the parts, by dynamic programming on estimated candidate
   counts. A fingerprint within the radius must then lie within the shells of at least one part, so nothing is lost.
   The estimates come from histograms of at most 2**16 values a part, whatever the corpus: a proven bound to broadcast.
4. Index and probe rows meet by (part, value). Buckets above CELL rows are cut into a grid of cells, so that no task
   gathers a large group; probes are streamed past the cell's index rows in numpy and verified.
5. What is found is reduced in numpy, for PAIRS_AT_ONCE pairs at a time, to a spanning forest of its links: at most one link a
   row, never all pairs. Components follow from those.

The number of parts falls as the corpus grows (the values get longer), which changes cost but never the result.

Defined cases: null, empty and blank texts have no words and the fingerprint 0, linked like any other. Texts of fewer
words than a shingle use the whole sequence. Repeated rows share a fingerprint. A row with a null doc_id keeps its row and takes
the component of its fingerprint, a null one if no row with an id has that. Rows of one doc_id with unequal texts are one node: the id
reaches what any of them reaches. Other columns of the input are kept out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinscout.llm.common import Scratch, slices
from joinscout.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Index rows that a task holds of one bucket; larger buckets are cut.
CELL = 4096
#: Most shells a part may get, so that probes stay within 1 + w + w*(w-1)/2 a part.
SHELLS = 3
PAIRS_AT_ONCE = 1 << 20
_PLACES = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one whole text, unsigned."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - shingle + 1)
    spans = zip(begins[:n].tolist(), ends[min(shingle, len(found)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << _PLACES[2 * ones > n]).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), fp being the fingerprint's bits as a long; narrow."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            fps = np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(hashed, "doc_id bigint, fp bigint")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each two bits are both set in a task's fingerprints, and how many there are."""
    total, n = np.zeros((64, 64)), 0
    for b in batches:
        bits = _bits(b.column(0).to_numpy()).astype(np.float32)
        total += bits.T @ bits
        n += len(bits)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["at", "n"])


def grouped_bits(both: np.ndarray, n: int, parts: int) -> list[np.ndarray]:
    """Divides the 64 bits among `parts`, correlated ones together: each part grows from the strongest pair left."""
    mean = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        rest = sorted(left)
        start = rest[int(tie[np.ix_(rest, rest)].max(1).argmax())]
        own = [start]
        left.discard(start)
        while len(own) < width:
            best = max(sorted(left), key=lambda x: tie[x, own].sum())
            own.append(best)
            left.discard(best)
        out.append(np.array(sorted(own)))
    return out


def values(fps: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits at `places`, packed."""
    out = np.zeros(len(fps), np.int64)
    raw = fps.view(np.uint64)
    for i, p in enumerate(places):
        out |= ((raw >> np.uint64(p)) & np.uint64(1)).astype(np.int64) << i
    return out


def number_of_parts(n: int, radius: int = RADIUS) -> int:
    """The count of parts that makes rows moved plus candidates checked cheapest; a candidate costs about 1/400 of a row."""

    def cost(parts: int) -> float:
        shells = [(radius + 1) // parts + (k < (radius + 1) % parts) for k in range(parts)]
        width = 64 // parts
        probes = sum(sum(len(list(combinations(range(width), d))) for d in range(e)) for e in shells)
        return parts + probes + probes * n / 2**width / 400

    return min((p for p in (4, 3, 2) if p == 4 or radius + 1 <= SHELLS * p), key=cost)


class Plan:
    """Parts, and for each part and shell count the estimated rows within reach of a value's first 16 bits."""

    def __init__(self, places: list[np.ndarray], counts: list[np.ndarray], radius: int) -> None:
        self.places, self.radius = places, radius
        self.slots = [min(16, len(p)) for p in places]
        self.ball = []
        for own, slots, full in zip(counts, self.slots, places, strict=True):
            reach = [np.zeros(1 << slots, np.float32), own.astype(np.float32)]
            v = np.arange(1 << slots)
            near = own + sum(own[v ^ (1 << i)] for i in range(slots))
            reach.append(near.astype(np.float32))
            reach.append((near + sum(own[v ^ (1 << i) ^ (1 << j)] for i, j in combinations(range(slots), 2))).astype(np.float32))
            thin = 2.0 ** (len(full) - slots)
            self.ball.append(np.stack([reach[0], *(r / thin for r in reach[1:])]))

    def reach(self, part: int, value: np.ndarray, shells: int) -> np.ndarray:
        return self.ball[part][shells][value & ((1 << self.slots[part]) - 1)]

    def allocate(self, vals: list[np.ndarray]) -> list[np.ndarray]:
        """Shells for each part and row: radius + 1 in all, the fewest estimated candidates and probes."""
        total = self.radius + 1
        n = len(vals[0])
        best = np.full((total + 1, n), np.inf)
        best[0] = 0
        choice = []
        for part, value in enumerate(vals):
            width = len(self.places[part])
            probes = np.cumsum([0, 1, width, width * (width - 1) / 2])
            new, took = np.full((total + 1, n), np.inf), np.zeros((total + 1, n), np.int8)
            for e in range(SHELLS + 1):
                cost = self.reach(part, value, e) / 400 + probes[e]
                for have in range(e, total + 1):
                    c = best[have - e] + cost
                    better = c < new[have]
                    new[have][better] = c[better]
                    took[have][better] = e
            best = new
            choice.append(took)
        have, out = np.full(n, total), []
        for took in reversed(choice):
            e = took[have, np.arange(n)]
            out.append(e)
            have = have - e
        return out[::-1]


def _dealer(plan):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for b in batches:
            fps, reps = b.column(0).to_numpy(), b.column(1).to_numpy()
            for start in range(0, len(fps), 2000):
                fp, rep = fps[start : start + 2000], reps[start : start + 2000]
                vals = [values(fp, x) for x in p.places]
                shells = p.allocate(vals)
                rows: list[tuple] = []

                def put(part, value, who, role, rows=rows, fp=fp, rep=rep):
                    """To one row (index) or column (probe) of its bucket's grid of cells, or to all of the other kind."""
                    held = p.reach(part, value, 1)
                    down = np.ceil(held / CELL).astype(np.int64).clip(1)
                    across = np.ceil(p.reach(part, value, 2) / (32 * CELL)).astype(np.int64).clip(1)
                    own = (fp[who].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                    copies = across if role == 0 else down
                    nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                    mine = np.repeat(own % (down if role == 0 else across), copies)
                    cell = (mine * np.repeat(across, copies) + nth) if role == 0 else (nth * np.repeat(across, copies) + mine)
                    at = np.repeat(who, copies)
                    rows.append((np.repeat((value << 2) | part, copies), cell, np.full(len(at), role, np.int8), fp[at], rep[at]))

                everyone = np.arange(len(fp))
                for part, value in enumerate(vals):
                    put(part, value, everyone, 0)
                    width = len(p.places[part])
                    for e in range(1, SHELLS + 1):
                        who = np.flatnonzero(shells[part] >= e)
                        if len(who):
                            for flips in combinations(range(width), e - 1):
                                probe = value[who] ^ sum(1 << i for i in flips)
                                least = 1 if e == 1 and p.slots[part] == width else 0  # only itself there
                                seen = p.reach(part, probe, 1) > least
                                if seen.any():
                                    put(part, probe[seen], who[seen], 1)
                key, cell, role, f, r = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cell.astype(np.int32)), pa.array(role), pa.array(f), pa.array(r)], names=["key", "cell", "role", "fp", "rep"])

    return deal


def spanning(a: np.ndarray, b: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links a - b that join, after the `known` ones, what isn't joined yet: a spanning forest."""
    nodes, flat = np.unique(np.concatenate((*known, a, b)), return_inverse=True)
    k, n = len(known[0]), len(a)
    root, keep = np.arange(len(nodes)), np.zeros(n, bool)
    for left, right, new in ((flat[:k], flat[k : 2 * k], False), (flat[2 * k : 2 * k + n], flat[2 * k + n :], True)):
        at = np.arange(len(left))
        while len(at):  # each root hooks onto a smaller one by one of its links; then paths are shortened
            one, other = root[left[at]], root[right[at]]
            apart = one != other
            at, one, other = at[apart], one[apart], other[apart]
            above, first = np.unique(np.maximum(one, other), return_index=True)
            root[above] = np.minimum(one, other)[first]
            if new:
                keep[at[first]] = True
            while not np.array_equal(up := root[root], root):
                root = up
    return a[keep], b[keep]


def _verifier(radius: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (key, cell, role): each cell's index rows, then its probes."""
        held, index_fp, index_rep = None, np.empty(0, np.uint64), np.empty(0, np.int64)
        for b in batches:
            key, cell, role, fp, rep = (b.column(i).to_numpy() for i in range(5))
            if not len(key):
                continue
            fp = fp.view(np.uint64)
            if held != (key[0], cell[0]):
                index_fp, index_rep = index_fp[:0], index_rep[:0]
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))))
            group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key))))
            is_index = role == 0
            size = np.bincount(group[is_index], minlength=len(new))
            size[0] += len(index_fp)
            index_fp, index_rep = np.concatenate((index_fp, fp[is_index])), np.concatenate((index_rep, rep[is_index]))
            first = np.cumsum(size) - size
            probes = np.flatnonzero(~is_index)
            probes = probes[size[group[probes]] > 0]
            ends = np.cumsum(size[group[probes]])
            done, sent = 0, (np.empty(0, np.int64), np.empty(0, np.int64))  # chunks of one cell mostly find the same links
            while done < len(probes):
                upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS_AT_ONCE, "right")))
                own = probes[done:upto]
                n = size[group[own]]
                left = np.repeat(own, n)
                right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[group[own]], n)
                near = np.bitwise_count(fp[left] ^ index_fp[right]) <= radius
                a, z = spanning(rep[left[near]], index_rep[right[near]], sent)
                if len(a):
                    sent = np.concatenate((sent[0], a)), np.concatenate((sent[1], z))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], names=["a", "b"])
                done = upto
            held = key[-1], cell[-1]
            index_fp, index_rep = index_fp[first[-1] :], index_rep[first[-1] :]

    return verify


def links(nodes: DataFrame, spark: SparkSession, radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """Links (a, b) between the reps of `nodes` (fp, rep; distinct fps) that span all pairs within `radius` bits.

    Fewer parts than radius + 1 shells can be dealt to raise an error, as links would be lost.
    """
    together = nodes.select("fp").mapInArrow(_together, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(4097)
    flat[together["at"].to_numpy()] = together["n"].to_numpy()
    n = int(flat[4096])
    parts = parts or number_of_parts(n, radius)
    if radius + 1 > SHELLS * parts:
        raise ValueError(f"{parts} parts of {SHELLS} shells don't cover a radius of {radius}")
    places = grouped_bits(flat[:4096].reshape(64, 64), n, parts)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << min(16, len(p)), np.int64) for p in places]
        for b in batches:
            for p, t in zip(places, total, strict=True):
                t += np.bincount(values(b.column(0).to_numpy(), p) & (len(t) - 1), minlength=len(t))
        for k, t in enumerate(total):
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int8)), pa.array(at.astype(np.int32)), pa.array(t[at])], names=["part", "value", "n"])

    found = nodes.select("fp").mapInArrow(counted, "part tinyint, value int, n bigint").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    counts = []
    for k, p in enumerate(places):
        own = np.zeros(1 << min(16, len(p)), np.int64)
        here = found["part"].to_numpy() == k
        own[found["value"].to_numpy()[here]] = found["n"].to_numpy()[here]
        counts.append(own)
    plan = spark.sparkContext.broadcast(Plan(places, counts, radius))
    dealt = nodes.select("fp", "rep").mapInArrow(_dealer(plan), "key bigint, cell int, role tinyint, fp bigint, rep bigint")
    return dealt.repartition("key", "cell").sortWithinPartitions("key", "cell", "role").mapInArrow(_verifier(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of each row; component_id is the smallest doc_id that links lead to."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    fps = scratch.keep(fingerprints(docs, shingle))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    linked = components(links(nodes.where("rep IS NOT NULL"), spark, radius), scratch)
    named = nodes.join(linked, nodes.rep == linked.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp") -> F.Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
