"""Set metrics and precision over a workload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_metrics(truth: DataFrame, found: DataFrame, item: str) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1, accuracy) of `found` against `truth`, as sets of `item`; ratios of nothing are 0."""
    a, b = truth.select(item).distinct().withColumn("t", F.lit(1)), found.select(item).distinct().withColumn("f", F.lit(1))
    sums = a.join(b, item, "full_outer").agg(
        F.coalesce(F.sum(F.when(F.col("t").isNotNull() & F.col("f").isNotNull(), 1).otherwise(0)), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("t").isNull(), 1).otherwise(0)), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(F.col("f").isNull(), 1).otherwise(0)), F.lit(0)).alias("fn"),
    )

    def ratio(n, d):
        return F.when(d == 0, F.lit(0.0)).otherwise(n / d)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = sums.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp, tp + fp + fn)})
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def precision_at_k(results: DataFrame) -> DataFrame:
    """(n_queries, precision) of results (query_id, path_nth, rows_found, rows_asked): a query counts if some path finds all rows."""
    each = results.groupBy("query_id").agg(F.max((F.col("rows_found") >= F.col("rows_asked")).cast("int")).alias("hit"))
    return each.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("hit").alias("precision"))
