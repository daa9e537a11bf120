"""Similarities of array columns, hyperplane hashes, and content hashes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, guarded: bool = True) -> Column:
    """Cosine; the guard keeps zero vectors at 0 instead of null."""
    size = norm(a) * norm(b)
    return dot(a, b) / (F.greatest(size, F.lit(EPS)) if guarded else F.nullif(size, F.lit(0.0)))


def squared_euclid(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclid(a, b))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    size = norm(a)
    return F.when(size == 0, a.cast("array<double>")).otherwise(F.transform(a.cast("array<double>"), lambda x: x / size))


def normalized_euclid_similarity(a: Column, b: Column) -> Column:
    """1 minus half the distance of the unit vectors, so from 0 (opposite) to 1 (same direction)."""
    return 1 - euclid(unit(a), unit(b)) / 2


def hyperplane_hash(a: Column, planes: list[list[float]]) -> Column:
    """Sign bits against each plane, as a string; null stays null, a product of 0 gives 0."""
    bits = (F.when(dot(a, F.array(*(F.lit(float(x)) for x in row))) > 0, F.lit("1")).otherwise(F.lit("0")) for row in planes)
    return F.when(a.isNotNull(), F.concat(*bits))


def sign_hash(a: Column, bits: int) -> Column:
    """Signs of the first components."""
    return F.array_join(F.transform(F.slice(a, 1, bits), lambda x: F.when(x > 0, F.lit("1")).otherwise(F.lit("0"))), "")


def jaccard_of_arrays(a: Column, b: Column) -> Column:
    """Exact Jaccard of two arrays as sets, nulls left out; two empty ones give 1."""
    x, y = F.array_distinct(F.array_compact(a)), F.array_distinct(F.array_compact(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def content_hash(items: Column) -> Column:
    """md5 of an array of strings written as a JSON list with ', ' between."""
    return F.md5(F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]")).cast("binary"))


def tuple_hash(*items: Column) -> Column:
    return F.sha2(F.concat_ws("", *items), 256)


def json_list(prose: Column, schema: str) -> Column:
    """What stands from the first [ to the last ] of a text, read as JSON; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(prose, r"(?s)(\[.*\])", 1), F.lit("")), schema)
