"""Hash-based primitives that give the same values in Spark and in any SQL engine with md5.

All arithmetic is on integers, so results don't depend on the order of summation or on the engine.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinscout.functions import grams

#: Prime of the MinHash permutations; hashes have 28 bits and multipliers 31, so products fit in a long.
PRIME = 2147483647
PERMUTATIONS = 128
BITS = 18
BUCKETS = 64


def h28(x: Column) -> Column:
    """The first 28 bits of md5 of a string."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long")


def h28_sql(x: str) -> str:
    return f"CAST(concat('0x', substr(md5({x}), 1, 7)) AS BIGINT)"


def permutations(k: int = PERMUTATIONS, seed: int = 1) -> list[tuple[int, int]]:
    """(multiplier, offset) of each permutation."""
    out = []
    for j in range(k):
        digest = hashlib.md5(f"{seed}:{j}".encode()).hexdigest()
        out.append((int(digest[:8], 16) % (PRIME - 1) + 1, int(digest[8:16], 16) % PRIME))
    return out


def minhash(h: Column, k: int = PERMUTATIONS, seed: int = 1) -> Column:
    """Aggregate: the MinHash signature of a group's hashes (h28), duplicates allowed."""
    return F.array(*(F.min((h * a + b) % PRIME) for a, b in permutations(k, seed)))


def minhash_sql(x: str, k: int = PERMUTATIONS, seed: int = 1) -> str:
    return "[" + ", ".join(f"min(({h28_sql(x)} * {a} + {b}) % {PRIME})" for a, b in permutations(k, seed)) + "]"


def buckets_sql(x: str, n: int = BUCKETS) -> str:
    """Buckets of the character 3-grams of a string, lower-cased and padded; repeats kept."""
    padded = f"concat('^^', lower({x}), '$$')"
    return f"list_transform(range(1, length({padded}) - 1), lambda i: {h28_sql(f'substr({padded}, i, 3)')} % {n})"


def signs(bits: int = BITS, n: int = BUCKETS) -> list[list[int]]:
    """Seeded hyperplanes of +1 and -1, one row for each bit."""
    return [[1 if int(hashlib.md5(f"{b}:{d}".encode()).hexdigest()[0], 16) % 2 else -1 for d in range(n)] for b in range(bits)]


@cache
def _simhash_udf(bits: int, n: int):
    planes = np.array(signs(bits, n), np.float64)

    def hashed(texts: pa.Array) -> pa.Array:
        return grams.simhashes(texts, planes)

    return F.arrow_udf(hashed, T.StringType())


def simhash(x: Column, bits: int = BITS, n: int = BUCKETS) -> Column:
    """Sign bits of the 3-gram counts against each hyperplane, as a string; null stays null, a sum of 0 gives 0. Texts are hashed in numpy, a batch at a time."""
    return _simhash_udf(bits, n)(F.lower(x))


def simhash_sql(found: str, bits: int = BITS, n: int = BUCKETS) -> str:
    """From a column of buckets (buckets_sql)."""
    each = " || ".join(f"CASE WHEN list_sum(list_transform({found}, lambda b: {row}[b + 1])) > 0 THEN '1' ELSE '0' END" for row in signs(bits, n))
    return f"CASE WHEN {found} IS NOT NULL THEN {each} END"


@cache
def _vector_udf(n: int):
    def counted(texts: pa.Array) -> pa.Array:
        return grams.vectors(texts, n)

    return F.arrow_udf(counted, T.ArrayType(T.DoubleType()))


def gram_counts(x: Column, n: int = BUCKETS) -> Column:
    """The default encoder: how many 3-grams fall into each bucket, as an array of n doubles; null stays null."""
    return _vector_udf(n)(F.lower(x))


def gram_counts_sql(x: str, n: int = BUCKETS) -> str:
    return f"list_transform(range({n}), lambda d: len(list_filter({buckets_sql(x, n)}, lambda b: b = d))::DOUBLE)"  # for labels, which are few
