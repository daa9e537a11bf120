"""Combinations in order of rank, and small list operations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinscout.functions import portable


def ranked_combinations(lists: list[DataFrame]) -> DataFrame:
    """All choices of one item of each list (item, r), ordered by the sum of ranks, then by the ranks in turn.

    Columns are item1, r1, item2, r2, ... and rank_sum; meant for candidate lists, which are short by design.
    """
    named = [f.select(F.col("item").alias(f"item{i}"), F.col("r").alias(f"r{i}")) for i, f in enumerate(lists, 1)]
    both = reduce(lambda a, b: a.crossJoin(b), named)
    ranks = [F.col(f"r{i}") for i in range(1, len(lists) + 1)]
    return both.withColumn("rank_sum", reduce(lambda a, b: a + b, ranks)).orderBy("rank_sum", *ranks)


def lazy_combinations(sizes: Sequence[int]) -> Iterator[tuple[int, ...]]:
    """Index tuples in the same order, made one by one: each rank sum is split over the lists in every way that fits, smaller first ranks first."""
    if not sizes or min(sizes) == 0:
        return
    room = [sum(n - 1 for n in sizes[i:]) for i in range(len(sizes) + 1)]

    def splits(total: int, i: int) -> Iterator[tuple[int, ...]]:
        if i == len(sizes):
            yield ()
        else:
            for r in range(max(0, total - room[i + 1]), min(total, sizes[i] - 1) + 1):
                for rest in splits(total - r, i + 1):
                    yield (r, *rest)

    for total in range(room[0] + 1):
        yield from splits(total, 0)


def between_marks(items: Column, marks: Column) -> Column:
    """The part of an array from its first to its last marked place; null without a mark."""
    at = F.filter(F.sequence(F.lit(1), F.size(items)), lambda i: F.element_at(marks, i))
    return F.when(F.size(at) > 0, F.slice(items, F.array_min(at), F.array_max(at) - F.array_min(at) + 1))


def interleave(a: Column, b: Column) -> Column:
    """a1, b1, a2, b2, ...; what one array has over comes last."""
    return F.array_compact(F.flatten(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.array(x["a"], x["b"]))))


def positions(items: Column, value: Column) -> Column:
    """Places from 0 where an array has a value."""
    return F.transform(F.filter(F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"] == value), lambda s: s["i"])


def top_of_map(m: Column, k: int) -> Column:
    """The k entries of a map of largest value, ties by key."""
    by = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.transform(F.slice(by, 1, k), lambda s: F.struct(s["k"].alias("key"), (-s["v"]).alias("value")))


def sampled(frame: DataFrame, key: str, count: int | None = None, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """A seeded sample by md5 of `key`, the same on every run and engine: so many rows, or about such a share."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), F.col(key).cast("string"))
    if count is not None:
        return frame.withColumn("__h", F.md5(text.cast("binary"))).orderBy("__h", key).limit(count).drop("__h")
    return frame.where(portable.h28(text) < int((fraction or 0) * (1 << 28)))
