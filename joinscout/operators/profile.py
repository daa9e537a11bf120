"""Column profiles from value counts: frequent values, the numeric flag, diversity, evenness and entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joinscout.functions import portable

TOP = 10


def top_values(counts: DataFrame, n: int = TOP) -> DataFrame:
    """(tbl, col, value, n, nth): the most frequent values, nulls left out, ties by value."""
    w = Window.partitionBy("tbl", "col").orderBy(F.desc("n"), "value")
    return counts.where("value IS NOT NULL").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def numeric_flags(counts: DataFrame, columns: DataFrame) -> DataFrame:
    """(tbl, col, is_numeric): over half of the characters of the most frequent values are digits; empty columns are text."""
    digits = F.sum(F.length(F.regexp_replace("value", "[^0-9]", "")))
    found = top_values(counts).groupBy("tbl", "col").agg((digits * 2 > F.sum(F.length("value"))).alias("is_numeric"))
    return columns.select("tbl", "col").join(found, ["tbl", "col"], "left").select("tbl", "col", F.coalesce("is_numeric", F.lit(False)).alias("is_numeric"))


def simhash_counts(counts: DataFrame, bits: int = portable.BITS, buckets: int = portable.BUCKETS) -> DataFrame:
    """(tbl, col, simhash, n): each distinct value is hashed once; null is a species of its own."""
    return counts.withColumn("simhash", portable.simhash(F.col("value"), bits, buckets)).groupBy("tbl", "col", "simhash").agg(F.sum("n").alias("n"))


def simpson(species: DataFrame, n: str = "n") -> DataFrame:
    """(tbl, col, diversity): chance that two rows differ in species; 0 for less than two rows."""
    c = F.col(n).cast("double")
    total = F.sum(c)
    return species.groupBy("tbl", "col").agg(F.when(total > 1, 1 - F.sum(c * (c - 1)) / (total * (total - 1))).otherwise(F.lit(0.0)).alias("diversity"))


def _spread(species: DataFrame, log) -> DataFrame:
    """(tbl, col, kinds, h): the kinds of each column and their Shannon entropy, log(total) - sum(n log n) / total; one aggregate, without shares."""
    n = F.col("n").cast("double")
    h = log(F.sum(n)) - F.sum(n * log(n)) / F.sum(n)
    return species.groupBy("tbl", "col").agg(F.count(F.lit(1)).alias("kinds"), F.greatest(h, F.lit(0.0)).alias("h"))


def evenness(species: DataFrame) -> DataFrame:
    """(tbl, col, evenness): Shannon entropy over that of equal shares; 0 for one species."""
    share = F.col("h") / F.log(F.col("kinds").cast("double"))
    return _spread(species, F.log).select("tbl", "col", F.when(F.col("kinds") > 1, share).otherwise(F.lit(0.0)).alias("evenness"))


def entropy(counts: DataFrame) -> DataFrame:
    """(tbl, col, entropy) in bits over the values; null counts as a value."""
    return _spread(counts, F.log2).select("tbl", "col", F.col("h").alias("entropy"))


def entropy_of_list(items: Column) -> Column:
    """Entropy in bits of an array's values; an empty one gives 0."""
    kinds = F.array_distinct(items)
    shares = F.transform(kinds, lambda k: F.size(F.filter(items, lambda x: x.eqNullSafe(k))) / F.size(items))
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def null_profile(counts: DataFrame) -> DataFrame:
    """(tbl, col, n_rows, n_nulls, n_distinct) of each column."""
    return counts.groupBy("tbl", "col").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_nulls"), F.count("value").alias("n_distinct"))
