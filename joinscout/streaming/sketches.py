"""MinHash sketches kept up to date from a stream: new rows change minima only, so batches merge in any order and may repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from joinscout.functions import portable
from joinscout.operators.sketch import merged, signatures


def merge_signatures(a: DataFrame, b: DataFrame, k: int = portable.PERMUTATIONS) -> DataFrame:
    """The signatures (tbl, col, signature) of the union of two inputs: minima by place."""
    return merged(a.unionByName(b), k)


def stream_cells(rows: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """(tbl, col, value) of a streaming table."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    return rows.selectExpr(f"'{table}' AS tbl", f"stack({len(columns)}, {pairs}) AS (col, value)")


def maintain(rows: DataFrame, table: str, columns: list[str], folder: str, checkpoint: str, k: int = portable.PERMUTATIONS) -> StreamingQuery:
    """Writes after each batch the signatures of all rows so far to a new folder <folder>/v<batch>; the largest is the newest.

    A batch that is run again after a failure writes the same folder with the same minima, so results are exactly-once.
    """
    def update(batch: DataFrame, number: int) -> None:
        new = signatures(batch.distinct(), "value", k)
        if number > 0:
            new = merge_signatures(batch.sparkSession.read.parquet(f"{folder}/v{number - 1}"), new, k)
        new.write.mode("overwrite").parquet(f"{folder}/v{number}")

    return stream_cells(rows, table, columns).writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
