"""What the operators share: scratch tables in the shared folder, batches bounded by bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where scratch tables go if a local session names no shared folder, as in tests.
LOCAL_SCRATCH = "/tmp/checkpoints"
#: Python works on slices of at most this many bytes of text at a time, plus one document.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode LOCAL_SCRATCH serves if that is unset."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{LOCAL_SCRATCH}"


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to clash with no column, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Tables written to the shared folder to cut lineage, so that lost executors lose nothing.

    `keep` writes a frame once and reads it again; `drop` removes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.kept: list[tuple[DataFrame, str]] = []
        self.n = 0

    def keep(self, frame: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for path in [path for own, path in self.kept if any(own is x for x in frames)]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.kept = [(own, path) for own, path in self.kept if not any(own is x for x in frames)]

    def free_shuffles(self) -> None:
        """Lets Spark's cleaner delete shuffle files of plans that are done with; they go only when the JVM collects garbage."""
        self.spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cuts Arrow batches so that the texts of each part take about `limit` bytes at most; gives the part and its texts."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                part = batch.slice(start, i - start)
                yield part, column.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start), column.slice(start).to_pylist()


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins sorted batches so that rows of one first column are never parted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def crc_of_id(column: str) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))
