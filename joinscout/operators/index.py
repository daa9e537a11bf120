"""The inverted index from tables to join paths, and lookups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def path_tables(paths: DataFrame) -> DataFrame:
    """(path, tbl): which tables lie on which paths."""
    return paths.select("path", F.explode("path").alias("tbl"))


def covering(paths: DataFrame, needs: DataFrame) -> DataFrame:
    """(need_id, path) of paths that hold all tables of a need (need_id, tables), in any order and place."""
    want = needs.select("need_id", F.explode(F.array_distinct("tables")).alias("tbl"))
    sizes = needs.select("need_id", F.size(F.array_distinct("tables")).alias("n"))
    met = want.join(path_tables(paths), "tbl").groupBy("need_id", "path").agg(F.count(F.lit(1)).alias("met"))
    return met.join(sizes, "need_id").where("met = n").select("need_id", "path")


def first_covering(ranked: DataFrame, needs: DataFrame) -> DataFrame:
    """For each need the first path that covers it, by `nth` of ranked paths (path, nth): the shortest, then by quality and name."""
    found = covering(ranked.select("path"), needs).join(ranked, "path")
    w = Window.partitionBy("need_id").orderBy("nth")
    return found.withColumn("k", F.row_number().over(w)).where("k = 1").select("need_id", "path", "nth")


def distinct_orders(chosen: DataFrame, k: int = 5) -> DataFrame:
    """The first k different paths in order of need_id."""
    return chosen.groupBy("path").agg(F.min("need_id").alias("need_id")).orderBy("need_id").limit(k)


def tables_without_paths(columns: DataFrame, paths: DataFrame) -> DataFrame:
    return columns.select("tbl").distinct().join(path_tables(paths).select("tbl").distinct(), "tbl", "left_anti")


def orders_between(paths: DataFrame, start: str, end: str) -> DataFrame:
    """(path, join_order) from `start` to `end`, of paths that are kept in one direction: those kept the other way are turned round."""
    there = paths.where((F.element_at("path", 1) == start) & (F.element_at("path", -1) == end)).select("path", "join_order")
    turned = F.transform(
        F.reverse("join_order"),
        lambda h: F.struct(h["child"].alias("parent"), h["parent"].alias("child"), h["child_column"].alias("parent_column"), h["parent_column"].alias("child_column"), h["join_type"].alias("join_type")),
    )
    back = paths.where((F.element_at("path", 1) == end) & (F.element_at("path", -1) == start)).select(F.reverse("path").alias("path"), turned.alias("join_order"))
    return there.unionByName(back)
