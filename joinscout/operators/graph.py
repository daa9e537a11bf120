"""The join graph: edges between columns, their ranking, simple and induced paths, join orders.

An edge joins two columns of two tables. Both are numeric: a natural join on values. Both are text: a semantic-hash join
on simhashes. Mixed columns never join. Edges are held in both directions, and ties keep the order of the columns as the
tables are enumerated (by name), so both directions agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NATURAL, SEMANTIC_HASH = "natural", "semantichash"
NO_WEIGHT = 999999.0


@dataclass(frozen=True)
class EdgeRules:
    join_edge_threshold: float = 0.5
    semantic_type_similarity_threshold: float = 0.9
    diversity_enabled: bool = False
    diversity_multiplier_threshold: float = 0.1
    natural_join_enabled: bool = True
    semantic_join_enabled: bool = True


def join_edges(value_jaccard: DataFrame, simhash_jaccard: DataFrame, type_similarity: DataFrame, profile: DataFrame, rules: EdgeRules = EdgeRules()) -> DataFrame:
    """(src, dst, src_col, dst_col, quality, edge_type, diversity, type_similarity, nth), nth from 1 by quality for each (src, dst).

    `profile` has (tbl, col, tbl_ord, col_ord, is_numeric, diversity). The type gate comes first, as it leaves the fewest pairs.
    """
    pair = ["tbl1", "col1", "tbl2", "col2"]
    p1, p2 = (profile.select("tbl", "col", "col_ord", "is_numeric", "diversity").toDF(f"tbl{i}", f"col{i}", f"ord{i}", f"num{i}", f"div{i}") for i in (1, 2))
    near = type_similarity.where(F.col("type_similarity") >= rules.semantic_type_similarity_threshold)
    both = near.join(p1, ["tbl1", "col1"]).join(p2, ["tbl2", "col2"])
    both = both.join(value_jaccard.withColumnRenamed("jaccard", "vj"), pair).join(simhash_jaccard.withColumnRenamed("jaccard", "sj"), pair)
    diversity = F.col("div1") * F.col("div2")
    if rules.diversity_enabled:
        both = both.where(diversity >= rules.diversity_multiplier_threshold)
    natural = F.col("num1") & F.col("num2") & (F.col("vj") >= rules.join_edge_threshold) & F.lit(rules.natural_join_enabled)
    hashed = ~F.col("num1") & ~F.col("num2") & (F.col("sj") >= rules.join_edge_threshold) & F.lit(rules.semantic_join_enabled)
    kind = F.when(natural, F.lit(NATURAL)).when(hashed, F.lit(SEMANTIC_HASH))
    quality = F.when(natural, F.col("vj")).when(hashed, F.col("sj"))
    found = both.select(*pair, "ord1", "ord2", quality.alias("quality"), kind.alias("edge_type"), diversity.alias("diversity"), "type_similarity").where("quality > 0")
    nth = F.row_number().over(Window.partitionBy("tbl1", "tbl2").orderBy(F.desc("quality"), "ord1", "ord2"))
    ranked = found.withColumn("nth", nth)
    rest = ["quality", "edge_type", "diversity", "type_similarity", "nth"]
    there = ranked.selectExpr("tbl1 AS src", "tbl2 AS dst", "col1 AS src_col", "col2 AS dst_col", *rest)
    back = ranked.selectExpr("tbl2 AS src", "tbl1 AS dst", "col2 AS src_col", "col1 AS dst_col", *rest)
    return there.union(back)


def best_edges(edges: DataFrame) -> DataFrame:
    """The best edge of each table pair, with its weight -log2(quality)."""
    weight = F.when(F.col("quality") > 0, -F.log2("quality") + 0.0).otherwise(F.lit(NO_WEIGHT))
    return edges.where("nth = 1").withColumn("weight", weight)


def neighbours(edges: DataFrame, table: str) -> DataFrame:
    return edges.where(F.col("src") == table).select("dst").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst), both directions, once each."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def _grow(frontier: DataFrame, links: DataFrame) -> DataFrame:
    step = frontier.join(links, F.element_at("path", -1) == links.src)
    return step.where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))


#: Stores a frame under a name and reads it back.
Keep = Callable[[DataFrame, str], DataFrame]


def _levels(links: DataFrame, longest: int, grow, keep: Keep | None) -> list[DataFrame]:
    """Paths of 1, 2, ... vertices. Levels are stored by `keep`, if given, so that each is made once."""
    links = keep(links, "links") if keep else links
    level = links.select(F.array("src").alias("path")).distinct()
    out = [level]
    for i in range(longest - 1):
        level = grow(level, links)
        level = keep(level, f"level-{grow.__name__}-{i}") if keep else level
        out.append(level)
    return out


def simple_paths(edges: DataFrame, longest: int = 5, keep: Keep | None = None) -> DataFrame:
    """(path): simple paths of 2 to `longest` tables, once for each unordered pair of ends (the smaller end first)."""
    levels = _levels(adjacency(edges), longest, _grow, keep)[1:]
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out.where(F.element_at("path", 1) < F.element_at("path", -1))


def paths_of(edges: DataFrame, vertices: int) -> DataFrame:
    """Simple paths of exactly so many tables."""
    return simple_paths(edges, vertices).where(F.size("path") == vertices)


def induced_paths(edges: DataFrame, vertices: int, keep: Keep | None = None) -> DataFrame:
    """(path): simple paths of exactly `vertices` tables without an edge between tables that aren't consecutive.

    A step is taken only if the new table is no neighbour of any before the last: one anti-join with the edges a level.
    """
    links = adjacency(edges)

    def grow(level: DataFrame, links: DataFrame) -> DataFrame:
        step = _grow(level, links)
        chord = links.toDF("c_src", "c_dst")
        earlier = F.slice("path", 1, F.greatest(F.size("path") - 2, F.lit(0)))
        return step.join(chord, (F.element_at("path", -1) == chord.c_dst) & F.array_contains(earlier, chord.c_src), "left_anti")

    return _levels(links, vertices, grow, keep)[vertices - 1].where(F.element_at("path", 1) < F.element_at("path", -1))


def shuffled(paths: DataFrame, seed: int) -> DataFrame:
    """Paths in a seeded order, each once: a stream of random paths for workloads."""
    return paths.orderBy(F.md5(F.concat_ws("\x1f", F.lit(str(seed)), "path").cast("binary")))


def hops(paths: DataFrame) -> DataFrame:
    """(path, hop, parent, child) of each step, hop from 1."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(i.alias("hop"), F.element_at("path", i).alias("parent"), F.element_at("path", i + 1).alias("child")))
    return paths.select("path", F.explode(steps).alias("h")).select("path", "h.*")


def join_orders(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, join_order): for each step the best edge of its two tables."""
    best = best_edges(edges).selectExpr("src AS parent", "dst AS child", "src_col AS parent_column", "dst_col AS child_column", "edge_type AS join_type")
    each = hops(paths).join(best, ["parent", "child"])
    order = F.array_sort(F.collect_list(F.struct("hop", "parent", "child", "parent_column", "child_column", "join_type")))
    return each.groupBy("path").agg(F.transform(order, lambda h: F.struct(h["parent"], h["child"], h["parent_column"], h["child_column"], h["join_type"])).alias("join_order"))


def matched_span(path: Column, tables: Column) -> Column:
    """The part of a path from the first to the last of the given tables."""
    at = F.filter(F.transform(tables, lambda t: F.array_position(path, t)), lambda i: i > 0)
    return F.when(F.size(at) > 0, F.slice(path, F.array_min(at).cast("int"), (F.array_max(at) - F.array_min(at) + 1).cast("int")))


def rank_paths(paths: DataFrame, tables: list[str]) -> DataFrame:
    """Paths (path, cardinality) by tables matched, then shorter span, then most of the span matched, then cardinality."""
    need = F.array(*map(F.lit, tables))
    span = matched_span(F.col("path"), need)
    matched = F.size(F.array_intersect("path", need))
    scored = paths.withColumns({"matched": matched, "span": F.coalesce(F.size(span), F.lit(0))}).withColumn("contiguity", F.when(F.col("span") > 0, F.col("matched") / F.col("span")).otherwise(F.lit(0.0)))
    return scored.orderBy(F.desc("matched"), "span", F.desc("contiguity"), F.desc("cardinality"), F.concat_ws(">", "path"))


def dot_text(edges: DataFrame) -> DataFrame:
    """The graph in DOT, one line a row, for drawing elsewhere."""
    line = F.format_string('"%s" -- "%s" [label="%s=%s"];', "src", "dst", "src_col", "dst_col")
    return best_edges(edges).where("src < dst").select(line.alias("line"))
