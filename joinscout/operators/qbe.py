"""Query by example: from a few example rows under semantic labels to a joined table that holds them.

Offline, `Discovery` relates all columns and paths. Online, `answer` finds columns by label and example, picks the shortest
paths that cover them, cuts the tables down to rows that can matter, joins, and counts the example rows it finds.
Only plans come to the driver: candidate columns (top K a label), the few chosen paths and counts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from joinscout.functions import portable, vectors
from joinscout.operators import execute, graph, labels, lists, profile, similarity, sketch
from joinscout.sources.lake import RID, Lake, shared_folder, write_artifact

#: Rows of the join that a workload's query is drawn from.
MOST_ROWS = 10_000_000
#: Combinations of candidate columns that are ranked by co-occurrence; `answers` takes another number, or None for all.
MOST_COMBINATIONS = 100_000


@dataclass
class Discovery:
    """What is known of a lake before any query. Each part is a lazy frame; `kept` stores those that many plans read
    in `folder`, by default a new one in the shared folder."""

    lake: Lake
    rules: graph.EdgeRules = graph.EdgeRules()
    longest: int = 5
    given_labels: DataFrame | None = None
    exact: bool = False
    folder: str | None = None

    def __post_init__(self) -> None:
        self.folder = self.folder or shared_folder(self.lake.spark)
        self._joins: dict[tuple[str, ...], bool] = {}

    def build(self) -> Discovery:
        """Makes the whole index in `folder`; a Discovery of the same lake and rules opened on that folder later reads it."""
        self.ranked, self.profile, self.labels  # noqa: B018
        return self

    def kept(self, frame: DataFrame, name: str) -> DataFrame:
        """Written to `folder` and read back, unless it is there already: later plans begin there, and lost executors lose nothing of it."""
        path = f"{self.folder}/{name}"
        spark = self.lake.spark
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            return spark.read.schema(frame.schema).parquet(path)
        return write_artifact(frame, path)

    @cached_property
    def columns(self) -> DataFrame:
        return self.lake.catalog()

    @cached_property
    def counts(self) -> DataFrame:
        """Value counts with the simhash of each distinct value."""
        counts = self.lake.value_counts()
        return self.kept(counts.withColumn("simhash", portable.simhash(F.col("value"))), "value_counts")

    @cached_property
    def species(self) -> DataFrame:
        """(tbl, col, simhash, n): the simhashes of each column, a bounded number."""
        return self.kept(self.counts.groupBy("tbl", "col", "simhash").agg(F.sum("n").alias("n")), "species")

    @cached_property
    def profile(self) -> DataFrame:
        """(tbl, col, tbl_ord, col_ord, is_numeric, diversity)."""
        flags = profile.numeric_flags(self.counts, self.columns)
        both = self.columns.join(flags, ["tbl", "col"]).join(profile.simpson(self.species), ["tbl", "col"], "left")
        return self.kept(both.select("tbl", "col", "tbl_ord", "col_ord", "is_numeric", F.coalesce("diversity", F.lit(0.0)).alias("diversity")), "column_profile")

    @cached_property
    def numeric(self) -> dict[tuple[str, str], bool]:
        """The numeric flags by column, on the driver: one for each column of the catalog."""
        return {(r["tbl"], r["col"]): r["is_numeric"] for r in self.profile.collect()}

    def _jaccard(self, key: str) -> DataFrame:
        if self.exact:
            return similarity.jaccard(similarity.overlaps(self.counts, self.columns, key)).select("tbl1", "col1", "tbl2", "col2", "jaccard")
        return sketch.estimated_jaccard(sketch.signatures(self.species if key == "simhash" else self.counts, key), self.columns)

    @cached_property
    def labels(self) -> DataFrame:
        found = labels.given_labels(self.columns, self.given_labels) if self.given_labels is not None else labels.header_labels(self.columns)
        return self.kept(labels.encoded(found), "semantic_types")

    @cached_property
    def edges(self) -> DataFrame:
        found = graph.join_edges(self._jaccard("value"), self._jaccard("simhash"), similarity.label_similarity(self.labels), self.profile, self.rules)
        return self.kept(found, "join_edges")

    @cached_property
    def paths(self) -> DataFrame:
        """(path, join_order) of all simple paths."""
        return self.kept(graph.join_orders(graph.simple_paths(self.edges, self.longest, self.kept), self.edges), "join_paths")

    def _quality(self) -> DataFrame:
        """(path, log_quality) of all paths."""
        best = graph.best_edges(self.edges).selectExpr("src AS parent", "dst AS child", "quality")
        return graph.hops(self.paths.select("path")).join(best, ["parent", "child"]).groupBy("path").agg(F.sum(F.log("quality")).alias("log_quality"))

    @cached_property
    def in_order(self) -> dict[tuple[str, ...], list[dict]]:
        """The join orders of all paths, empty ones too, on the driver: shortest first, then by quality product and name. They grow with the schema, not with rows."""
        rows = self.paths.join(self._quality(), "path").collect()
        rows.sort(key=lambda r: (len(r["path"]), -r["log_quality"], ">".join(r["path"])))
        return {tuple(r["path"]): [h.asDict() for h in r["join_order"]] for r in rows}

    def joins(self, path: tuple[str, ...]) -> bool:
        """Whether a path joins to something. Found for the paths that are asked for only, each once; a part of a path is a path, so its hops are asked first."""
        order = self.in_order[path]
        if path not in self._joins:
            parts = [p if p in self.in_order else p[::-1] for p in zip(path, path[1:], strict=False)] if len(order) > 1 else []
            self._joins[path] = all(map(self.joins, parts)) and execute.cardinality(execute.project(self.lake, order), order).first()["cardinality"] > 0
        return self._joins[path]

    def first_covering(self, tables: set[str]) -> tuple[str, ...] | None:
        """The first path in order that holds all the tables and joins to something."""
        return next((p for p in self.in_order if tables <= set(p) and self.joins(p)), None)

    @cached_property
    def ranked(self) -> DataFrame:
        """(path, join_order, cardinality, nth): paths that join to something, shortest first, then by quality product and name."""
        orders = [{"join_order": [h.asDict() for h in r["join_order"]]} for r in self.paths.select("join_order").collect()]
        if not orders:
            return self.paths.withColumns({"cardinality": F.lit(0).cast(execute.BIG), "nth": F.lit(0)}).limit(0)
        sizes = execute.path_cardinalities(self.lake, orders, self.kept).withColumnRenamed("path", "name")
        found = self.paths.withColumn("name", F.concat_ws(">", "path")).join(sizes, "name").where("cardinality > 0").join(self._quality(), "path")
        nth = F.row_number().over(Window.orderBy(F.size("path"), F.desc("log_quality"), "name"))  # paths of a schema graph, not data
        return self.kept(found.withColumn("nth", nth).select("path", "join_order", "cardinality", "nth"), "ranked_paths")


def examples_of(spark, query: list[dict]) -> DataFrame:
    """(q, example_row, example) of a query table's columns; example i of all columns makes row i."""
    rows = [(q, i, str(v)) for q, column in enumerate(query) for i, v in enumerate(column["examples"])]
    return spark.createDataFrame(rows, "q int, example_row int, example string")


def nearest_columns(known: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(q, tbl, col, nth): for each wanted label (q, semantic_type) the k columns of likest label; ties by column order."""
    asked = labels.encoded(wanted).select("q", F.col("vec").alias("asked"))
    far = vectors.euclid(vectors.unit(F.col("asked")), vectors.unit(F.col("vec")))
    w = Window.partitionBy("q").orderBy(F.round("far", 9), "tbl", "col")
    return known.crossJoin(asked).withColumn("far", far).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).select("q", "tbl", "col", "nth")


def postings(lake: Lake, columns: list[tuple[int, str, str]], numeric: dict[tuple[str, str], bool], examples: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(q, tbl, col, example_row, rid): rows of candidate columns that hold an example, by value or by simhash.

    One pass over each candidate column, joined to the handful of examples, which are of fixed size and broadcast. Texts are hashed once
    a distinct value, or not at all where `counts` has the value counts with their simhashes.
    """
    keyed = examples.withColumn("hashed", portable.simhash(F.col("example"))).collect()  # hashed once, not for each candidate
    parts = []
    for q, t, c in columns:
        own = F.broadcast(lake.spark.createDataFrame([r for r in keyed if r["q"] == q], "q int, example_row int, example string, hashed string"))
        cells = lake.tables[t].select(F.col(RID).alias("rid"), F.col(f"`{c}`").alias("key"))
        if numeric[t, c]:
            match = cells.join(own, cells.key == own.example)
        else:
            if counts is not None:
                kinds = counts.where((F.col("tbl") == t) & (F.col("col") == c)).select("value", "simhash")
            else:
                kinds = cells.select(F.col("key").alias("value")).distinct().withColumn("simhash", portable.simhash(F.col("value")))
            match = cells.join(kinds.join(own, kinds.simhash == own.hashed), F.col("key") == F.col("value"))
        parts.append(match.select("q", F.lit(t).alias("tbl"), F.lit(c).alias("col"), "example_row", "rid"))
    return reduce(DataFrame.union, parts)


def full_matches(found: DataFrame, n_examples: int) -> DataFrame:
    """(q, tbl, col) of columns in which every example is found."""
    return found.groupBy("q", "tbl", "col").agg(F.countDistinct("example_row").alias("n")).where(F.col("n") == n_examples).select("q", "tbl", "col")


def common_rows(found: DataFrame) -> DataFrame:
    """(tbl, example_row, rid): rows of a table that hold an example row in all its detected columns together."""
    n = found.groupBy("tbl").agg(F.countDistinct("q").alias("n"))
    return found.groupBy("tbl", "example_row", "rid").agg(F.countDistinct("q").alias("k")).join(n, "tbl").where("k = n").select("tbl", "example_row", "rid")


def rows_together(found: DataFrame) -> DataFrame:
    """(tbl, matched): in tables with two detected columns or more, how many example rows some row holds."""
    several = found.groupBy("tbl").agg(F.countDistinct("q").alias("n")).where("n > 1").select("tbl")
    return common_rows(found.join(several, "tbl", "left_semi")).groupBy("tbl").agg(F.countDistinct("example_row").alias("matched"))


def verify(tables: dict[str, DataFrame], order: list[dict], marks: dict[str, DataFrame]) -> DataFrame:
    """(rows_found): how many example rows stand in the table that an order joins, without joining it.

    `tables` are as `execute.project` gives them; `marks` has (example_row, rid) of the rows of a table that hold an example row in all
    its detected columns. From the leaves of the order to its root only the pairs of key and example row that some joined row has are carried.
    """
    below: dict[str, list[tuple[str, dict]]] = {}
    for parent, child, hop in execute.numbered(order):
        below.setdefault(parent, []).append((child, hop))

    def alive(table: str, key: str | None) -> DataFrame:
        """(key, example_row), once each, of the rows under a table that join; without example_row where nothing is detected."""
        hops = [(child, hop, execute.key_name(table, hop["parent_column"], hop["join_type"])) for child, hop in below.get(table, [])]
        names = list(dict.fromkeys([*([key] if key else []), *(n for _, _, n in hops)]))
        out = tables[table]
        if table in marks:
            out = out.join(marks[table], out[f"Index_{table}"] == marks[table].rid)
        out = out.select(*(F.col(f"`{n}`").alias(f"k{i}") for i, n in enumerate(names)), *(["example_row"] if table in marks else [])).distinct()
        for child, hop, name in hops:
            on = f"k{names.index(name)}"
            under = alive(child, execute.key_name(child, hop["child_column"], hop["join_type"])).withColumnRenamed("key", on)
            shared = [on, *({"example_row"} & {*out.columns} & {*under.columns})]
            out = out.join(under, shared, "inner" if "example_row" in under.columns else "left_semi")
        return out.select(*([F.col("k0").alias("key")] if key else []), *({"example_row"} & {*out.columns})).distinct()

    return alive(order[0]["parent"], None).agg(F.count("example_row").alias("rows_found"))


@dataclass
class Answer:
    path: list[str]
    join_order: list[dict]
    detected: list[tuple[int, str, str]]
    cardinality: int
    rows_found: int
    table: DataFrame


def answers(d: Discovery, query: list[dict], k_columns: int = 10, k_paths: int = 5, most_rows: int | None = None, most_combinations: int | None = MOST_COMBINATIONS) -> list[Answer]:
    """Up to k_paths joined tables for a query table, the likeliest first; ends with the first that holds all example rows.

    Paths that join to more than `most_rows` are left out if it is given; example rows are found without joining, so none need be.
    Combinations are ranked by co-occurrence among the first `most_combinations` by label rank, or among all if that is None.
    """
    spark = d.lake.spark
    examples = examples_of(spark, query)
    n = len(query[0]["examples"])
    wanted = spark.createDataFrame([(q, c["semantic_type"].lower()) for q, c in enumerate(query)], "q int, semantic_type string")
    near = [(r["q"], r["tbl"], r["col"]) for r in nearest_columns(d.labels, wanted, k_columns).orderBy("q", "nth").collect()]
    near = [x for x in near if d.first_covering({x[1]})]
    if not near:
        return []
    found = d.kept(postings(d.lake, near, d.numeric, examples, d.counts), f"postings-{uuid.uuid4().hex[:12]}")
    full = {(r["q"], r["tbl"], r["col"]) for r in full_matches(found, n).collect()}
    choices = [[x for x in near if x[0] == q and x in full] for q in range(len(query))]
    if not all(choices):
        return []
    combos = [[choices[q][i] for q, i in enumerate(at)] for at in islice(lists.lazy_combinations([len(c) for c in choices]), most_combinations)]
    together = {}
    for t in sorted({x[1] for x in full}):
        for own in {tuple(x for x in combo if x[1] == t) for combo in combos}:
            if len(own) > 1:
                chosen = spark.createDataFrame([(q, c) for q, _, c in own], "q int, col string")
                hit = rows_together(found.where(F.col("tbl") == t).join(F.broadcast(chosen), ["q", "col"])).first()
                together[own] = hit["matched"] if hit else 0

    def score(combo: list) -> int:
        return sum(together.get(tuple(x for x in combo if x[1] == t), 0) for t in {x[1] for x in combo})

    combos.sort(key=score, reverse=True)  # stable: equal scores keep the order of rank sums
    covering: dict[frozenset[str], tuple[str, ...] | None] = {}
    seen: set[tuple[str, ...]] = set()
    out = []
    for detected in combos:
        tables = frozenset(t for _, t, _ in detected)
        if tables not in covering:
            covering[tables] = d.first_covering(set(tables))
        path = covering[tables]
        if path is None or path in seen:
            continue
        seen.add(path)
        answer = run_path(d, list(path), d.in_order[path], detected, found, most_rows)
        if answer:
            out.append(answer)
            if answer.rows_found >= n:
                break
        if len(seen) == k_paths:
            break
    return out


def run_path(d: Discovery, path: list[str], order: list[dict], detected: list[tuple[int, str, str]], found: DataFrame, most_rows: int | None = None) -> Answer | None:
    """One path over the rows that examples leave; None if they join to nothing, or to more than `most_rows` if that is given. Only counts are run."""
    tables = execute.project(d.lake, order)
    reduced, marks = dict(tables), {}
    for t in dict.fromkeys(t for _, t, _ in detected):
        own = [(q, c) for q, u, c in detected if u == t]
        here = found.where(F.col("tbl") == t).join(F.broadcast(d.lake.spark.createDataFrame(own, "q int, col string")), ["q", "col"])
        marks[t] = (common_rows(here) if len(own) > 1 else here).select("example_row", "rid")
        reduced[t] = execute.semi_reduce(tables[t], marks[t].select("rid").distinct(), t)
    size = int(execute.cardinality(reduced, order).first()["cardinality"])
    if not size or (most_rows is not None and size > most_rows):
        return None
    rows = verify(tables, order, marks).first()["rows_found"]
    full = execute.fetch_columns(d.lake, execute.perform_joins(reduced, order), [(t, c) for _, t, c in detected])
    return Answer(path, order, detected, size, rows, full.select(*dict.fromkeys(f"{t}_{c}" for _, t, c in detected), *(f"Index_{t}" for t in path)))
