"""A lake of tables of strings, and the relations that everything else reads: columns, cells and value counts."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a CSV cell may hold instead of nothing.
NULL_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1f]'
NAME_LIMIT = 50
RID = "__rid"
_EXTRA = "__extra"


def clean_header(name: str) -> str:
    """A column name without characters that file systems refuse."""
    return re.sub(FORBIDDEN, "__", name).strip()


def short_names(names: Iterable[str], limit: int = NAME_LIMIT) -> dict[str, str]:
    """Names of at most `limit` characters where possible, all different.

    A name is known by the end of it that tells it apart from more of the others; where neither does, it is numbered.
    """
    names = list(names)
    heads = {n: sum(m[:limit] == n[:limit] for m in names) for n in names}
    tails = {n: sum(m[-limit:] == n[-limit:] for m in names) for n in names}
    out: dict[str, str] = {}
    numbered: dict[str, int] = {}
    for n in names:
        if heads[n] > tails[n]:
            short = n[-limit:]
        elif heads[n] < tails[n] or heads[n] == 1:
            short = n[:limit]
        else:
            numbered[n[:limit]] = numbered.get(n[:limit], 0) + 1
            short = f"{n[:limit]}_{numbered[n[:limit]]}"
        again = 0
        while (tried := f"{short}{again or ''}") in out.values():
            again += 1
        out[n] = tried
    return out


def null_words(frame: DataFrame) -> DataFrame:
    """Cells that say they hold nothing become null."""
    return frame.select(*(F.when(~F.col(f"`{c}`").isin(*NULL_WORDS) & (F.lower(F.col(f"`{c}`")) != "nan"), F.col(f"`{c}`")).alias(c) for c in frame.columns))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; rows longer than the header are skipped, shorter ones filled up with nulls.

    A row of another length than the header's comes with its raw text, whose separators outside quotes tell which it is.
    """
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))] + [T.StructField(_EXTRA, T.StringType())])
    options = {"header": True, "enforceSchema": True, "multiLine": True, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _EXTRA}
    raw = spark.read.schema(schema).options(**options).csv(path)
    # the first cell, emptied, keeps Spark from reading raw texts alone, which it refuses
    bare = F.concat(F.regexp_replace(_EXTRA, '"[^"]*"', ""), F.regexp_replace(F.coalesce("c0", F.lit("")), "(?s).+", ""))
    fits = F.coalesce(F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) < len(header), F.lit(True))
    names = _unique([clean_header(h) for h in header])
    return null_words(raw.where(fits).drop(_EXTRA).toDF(*names))


def csv_tables(spark: SparkSession, folder: str) -> dict[str, str]:
    """The path of each CSV file or folder of CSV parts in a folder, by table name."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    paths = sorted(str(x.getPath()) for x in found)
    return {p.rsplit("/", 1)[1].removesuffix(".csv"): p for p in paths if p.endswith(".csv")}


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, -1) + 1
        out.append(f"{n}.{seen[n]}" if seen[n] else n)
    return out


def repair_utf8(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, bytes that aren't UTF-8 left out. A replacement character that the file holds stays, by way of a noncharacter."""
    held = F.make_valid_utf8(F.replace(F.col("value"), F.lit("\ufffd"), F.lit("\ufdd0")))
    return spark.read.text(path).select(F.translate(F.replace(held, F.lit("\ufffd"), F.lit("")), "\ufdd0", "\ufffd").alias("line"))


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def drop_empty_columns(frame: DataFrame) -> DataFrame:
    """Without columns that hold nulls alone; one aggregate over the table decides."""
    counts = frame.agg(*(F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(frame.columns))).first()
    return frame.select(*(F.col(f"`{c}`") for i, c in enumerate(frame.columns) if counts[str(i)]))


def cap_rows(frame: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A sample of n rows, the same on every run: those whose seeded hash is least. A top-k, not a full sort."""
    key = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in frame.columns)).cast("binary"))
    return frame.withColumn("__key", key).orderBy("__key").limit(n).drop("__key")


def keep_last_columns(frame: DataFrame) -> DataFrame:
    """Of columns of one name, the last."""
    names = frame.columns
    last = {n: i for i, n in enumerate(names)}
    keep = sorted(last.values())
    return frame.toDF(*(f"__{i}" for i in range(len(names)))).select(*(F.col(f"__{i}").alias(names[i]) for i in keep))


def first_rows(frame: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Of rows equal on `columns`, the first by `order`."""
    w = Window.partitionBy(*columns).orderBy(*order)
    return frame.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def conjunctive_count(frame: DataFrame, values: dict[str, str]) -> DataFrame:
    """How many rows equal all the given values."""
    return frame.where(reduce(lambda a, b: a & b, (F.col(c) == v for c, v in values.items()))).agg(F.count(F.lit(1)).alias("n"))


def from_grid(spark: SparkSession, grid: dict) -> DataFrame:
    """A table from {"columns": [...], "data": {"0": [...], ...}}, rows in order of their keys."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in grid["columns"]])
    rows = [tuple(None if v is None else str(v) for v in grid["data"][k]) for k in sorted(grid["data"], key=int)]
    return spark.createDataFrame(rows, schema)


def to_grid(frame: DataFrame) -> DataFrame:
    """Each row as a JSON object of strings."""
    return frame.select(F.to_json(F.struct(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")).alias(c) for c in frame.columns))).alias("row"))


QUERY_TABLES = "query_id string, query array<struct<semantic_type:string,examples:array<string>,table:string,column:string>>, path array<string>, join_order array<struct<parent:string,child:string,parent_column:string,child_column:string,join_type:string>>"


def read_query_tables(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Query tables of a JSON array, or of one object a line."""
    return spark.read.schema(QUERY_TABLES).option("multiLine", not lines).json(path)


def write_query_tables(spark: SparkSession, queries: list[dict], path: str) -> None:
    """Stores query tables as one JSON object a line, to be read by read_query_tables."""
    lines = [(json.dumps({k: q[k] for k in ("query_id", "query", "path", "join_order") if k in q}),) for q in queries]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; in local mode under /tmp/checkpoints if that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{root or 'file:///tmp/checkpoints'}/joinscout-{uuid.uuid4().hex[:12]}"


def write_artifact(frame: DataFrame, path: str) -> DataFrame:
    """Stores a relation as Parquet and reads it again, so that later plans begin there."""
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@dataclass
class Lake:
    """Tables by name. Each has string columns and RID, a row id that is stable over re-reads."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    typed: dict[str, DataFrame] = field(default_factory=dict)
    texts: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, frames: dict[str, DataFrame], columns: dict[str, list[str]] | None = None, rids: dict[str, str] | None = None, texts: dict[str, str] | None = None) -> Lake:
        """A lake over any frames. `rids` gives an SQL expression of a table's row id; the rows of other tables are numbered and stored in
        the shared folder, so that ids are the same at every scan. `texts` gives an SQL expression of a column's string, else it is cast."""
        tables, folder = {}, None
        for name in sorted(frames):
            f, cols = frames[name], (columns or {}).get(name) or frames[name].columns
            known = bool(rids and name in rids)
            rid = F.expr(rids[name]) if known else F.monotonically_increasing_id()
            cells = (F.expr(texts[c]) if texts and c in texts else F.col(f"`{c}`").cast("string") for c in cols)
            tables[name] = f.select(*(x.alias(c) for x, c in zip(cells, cols, strict=True)), rid.cast("long").alias(RID))
            if not known:
                folder = folder or shared_folder(spark)
                tables[name] = write_artifact(tables[name], f"{folder}/table-{len(tables)}")
        return cls(spark, tables, dict(frames), dict(texts or {}))

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, columns: dict[str, list[str]], rids: dict[str, str] | None = None, texts: dict[str, str] | None = None) -> Lake:
        return cls.of(spark, {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in columns}, columns, rids, texts)

    @classmethod
    def from_csv(cls, spark: SparkSession, paths: dict[str, str] | str, cap: int | None = None) -> Lake:
        """CSV files by table name, or all of a folder, cleaned: no empty tables, no empty columns, at most `cap` rows each if given."""
        paths = csv_tables(spark, paths) if isinstance(paths, str) else paths
        names = short_names(paths)
        frames = {}
        for name, path in paths.items():
            f = read_csv(spark, path)
            if not f.isEmpty():
                f = cap_rows(f, cap) if cap else f
                frames[names[name]] = drop_empty_columns(f)
        return cls.of(spark, frames)

    def columns_of(self, table: str) -> list[str]:
        return [c for c in self.tables[table].columns if c != RID]

    def register(self) -> Lake:
        """Temporary views, for Spark SQL over the lake."""
        for name, f in self.tables.items():
            f.createOrReplaceTempView(name)
        return self

    def catalog(self) -> DataFrame:
        """(tbl, col, tbl_ord, col_ord): bounded by the schema, so made on the driver."""
        rows = [(t, c, i, j) for i, t in enumerate(sorted(self.tables)) for j, c in enumerate(self.columns_of(t))]
        return self.spark.createDataFrame(rows, "tbl string, col string, tbl_ord int, col_ord int")

    def cells(self, tables: Iterable[str] | None = None) -> DataFrame:
        """(tbl, col, rid, value), nulls included; one pass over each table."""
        parts = []
        for t in sorted(tables or self.tables):
            pairs = ", ".join(f"'{c}', `{c}`" for c in self.columns_of(t))
            parts.append(self.tables[t].selectExpr(f"'{t}' AS tbl", f"`{RID}` AS rid", f"stack({len(self.columns_of(t))}, {pairs}) AS (col, value)").select("tbl", "col", "rid", "value"))
        return reduce(DataFrame.union, parts)

    def value_counts(self) -> DataFrame:
        """(tbl, col, value, n), a null value included: what all profiles and sketches are made from.

        Each column is counted by itself and named afterwards: a scan reads one column, and only its distinct values are shuffled, without
        names. Numbers and times are counted as they are and turned to text once a distinct value. Later steps work on distinct values only.
        """
        parts = []
        for t in sorted(self.tables):
            for c in self.columns_of(t):
                parts.append(self._counted(t, c).select(F.lit(t).alias("tbl"), F.lit(c).alias("col"), "value", "n"))
        return reduce(DataFrame.union, parts)

    def _counted(self, table: str, column: str) -> DataFrame:
        """(value, n) of a column. Whole numbers differ as texts if they differ; other kinds are counted again by their texts."""
        typed = self.typed.get(table)
        kind = typed.schema[column].dataType if typed is not None and column in typed.columns and typed.columns.count(column) == 1 else None
        text = self.texts.get(column)
        rows, n = F.count(F.lit(1)).alias("n"), F.sum("n").alias("n")
        if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)) or (text is None and isinstance(kind, T.DecimalType)):
            return self.tables[table].groupBy(F.col(f"`{column}`").alias("value")).agg(rows)
        own = F.col(f"`{column}`")
        keys = [own]
        if isinstance(kind, T.FractionalType):
            keys.append(((own == 0) & (own.cast("string") == "-0.0")).alias("__minus"))  # grouping takes the two zeros for one
        counts = typed.groupBy(*keys).agg(rows)
        if len(keys) > 1:
            counts = counts.withColumn(column, F.when(F.col("__minus"), F.lit("-0.0").cast(kind)).otherwise(own))
        named = counts.select((F.expr(text) if text else own.cast("string")).alias("value"), "n")
        return named if text is None and isinstance(kind, T.IntegralType) else named.groupBy("value").agg(n)
