"""MinHash signatures of columns, their Jaccard estimates, and a count-min estimate of chain cardinality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinscout.functions import portable


def signatures(keys: DataFrame, key: str, k: int = portable.PERMUTATIONS, seed: int = 1) -> DataFrame:
    """(tbl, col, signature) over the non-null values of `key`.

    A value is hashed once, by the JVM. Each task takes the minima of all permutations of its columns' hashes in numpy, so that one row a
    column and task is all that is shuffled; their minima by place are the signature.
    """
    hashed = keys.select("tbl", "col", portable.h28(F.col(key)).alias("h")).where(F.col(key).isNotNull())
    factors = np.array(portable.permutations(k, seed), np.uint64)[:, :, None]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            tbl, col = (batch.column(i).dictionary_encode() for i in (0, 1))
            codes = tbl.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(col.dictionary) + col.indices.to_numpy(zero_copy_only=False)
            h = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
            for code in np.unique(codes).tolist():
                t, c = divmod(code, len(col.dictionary))
                have = held.setdefault((tbl.dictionary[t].as_py(), col.dictionary[c].as_py()), np.full(k, portable.PRIME, np.int64))
                np.minimum(have, _minima(h[codes == code], factors), out=have)
        names = [[n[i] for n in held] for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(names[0], pa.string()), pa.array(names[1], pa.string()), pa.array([x.tolist() for x in held.values()], pa.list_(pa.int64()))], names=["tbl", "col", "signature"])

    return merged(hashed.mapInArrow(least, "tbl string, col string, signature array<bigint>"), k)


def _minima(h: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each permutation over hashes. The prime is 2^31 - 1, so a remainder is high and low bits added, less the prime if that is reached."""
    prime = np.uint64(portable.PRIME)
    out = np.full(len(factors), portable.PRIME, np.int64)
    for s in range(0, len(h), 512):
        x = factors[:, 0] * h[s : s + 512] + factors[:, 1]
        x = (x & prime) + (x >> np.uint64(31))
        np.minimum(x, x - prime, out=x)  # unsigned: below the prime the difference is huge
        np.minimum(out, x.min(1).astype(np.int64), out=out)
    return out


def merged(sketches: DataFrame, k: int = portable.PERMUTATIONS) -> DataFrame:
    """The signature of each (tbl, col) from several: minima by place."""
    places = sketches.select("tbl", "col", F.posexplode("signature").alias("place", "x")).groupBy("tbl", "col", "place").agg(F.min("x").alias("x"))
    return places.groupBy("tbl", "col").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("s")).select("tbl", "col", F.col("s.x").alias("signature"))


def estimated_jaccard(sketches: DataFrame, columns: DataFrame) -> DataFrame:
    """(tbl1, col1, tbl2, col2, jaccard) for all pairs of columns of different tables, tbl1 < tbl2.

    There is one sketch for each column, so this pairs the catalog, not data. Columns without values take part with 0.
    """
    # all sketches, of fixed size, in one row: they are made once, though two sides read them
    own = F.collect_list(F.struct("tbl", "col", F.col("signature").alias("s")))
    grid = columns.select("tbl", "col").join(sketches, ["tbl", "col"], "left").agg(own.alias("all"))
    pairs = grid.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a.tbl < b.tbl")
    same = F.aggregate(F.zip_with("a.s", "b.s", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda acc, x: acc + x)
    return pairs.select(F.col("a.tbl").alias("tbl1"), F.col("a.col").alias("col1"), F.col("b.tbl").alias("tbl2"), F.col("b.col").alias("col2"), F.coalesce(same / F.size("a.s"), F.lit(0.0)).alias("jaccard"))


def _cell(key: str, row: int, width: int) -> F.Column:
    return portable.h28(F.concat_ws(":", F.lit(row), F.col(key).cast("string"))) % width


def count_min(weights: DataFrame, key: str, weight: str, depth: int = 5, width: int = 2048) -> DataFrame:
    """(row, cell, total): a count-min sketch of `weight` by `key`; at most depth x width rows."""
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("row"), _cell(key, r, width).alias("cell")) for r in range(depth)))).alias("at")
    return weights.select(rows, F.col(weight).alias("w")).groupBy("at.row", "at.cell").agg(F.sum("w").alias("total"))


def count_min_estimate(keys: DataFrame, key: str, sketch: DataFrame, depth: int = 5, width: int = 2048) -> DataFrame:
    """`keys` with `estimate`, never below the true weight; keys that the sketch surely lacks are left out. The sketch has a proven size bound."""
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("row"), _cell(key, r, width).alias("cell")) for r in range(depth)))).alias("at")
    at = keys.select("*", rows).select(*keys.columns, "at.row", "at.cell")
    found = at.join(F.broadcast(sketch), ["row", "cell"])
    return found.groupBy(*keys.columns).agg(F.min("total").alias("estimate"), F.count(F.lit(1)).alias("hits")).where(F.col("hits") == depth).drop("hits")


def count_min_cardinality(first: DataFrame, hops: list[DataFrame], last: DataFrame, depth: int = 5, width: int = 2048) -> DataFrame:
    """An upper estimate of a chain join's size: `first` (key, n), `hops` (kin, kout, n) and `last` (key, n), with
    what has come so far held in a count-min sketch by the next join value."""
    sketch = count_min(first, "key", "n", depth, width)
    for hop in hops:
        met = count_min_estimate(hop.withColumnRenamed("kin", "key"), "key", sketch, depth, width)
        sketch = count_min(met.select("kout", (F.col("estimate") * F.col("n")).alias("w")), "kout", "w", depth, width)
    end = count_min_estimate(last, "key", sketch, depth, width)
    return end.agg(F.coalesce(F.sum(F.col("estimate") * F.col("n")), F.lit(0)).alias("cardinality"))
