"""Queries for single operators over the driver's tables, with SQL for each: sources, cleaning, joins, lists, graph and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinscout.functions import portable, vectors
from joinscout.operators import execute, graph, index, labels, lists, profile, qbe, similarity, sketch, workload
from joinscout.plans.driver_lake import COLUMNS, driver_lake, with_sql
from joinscout.plans.registry import _FIVE, PAIR, Query, _known, _text, chain, example_query, r6, read
from joinscout.sources import lake as lakes

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return lakes.shared_folder(spark)


# --- sources and cleaning ----------------------------------------------------------------------------------------------


@query("""SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ', "x"' END AS quoted FROM customer""")
def csv_round_trip(spark, sf_dir):
    """Written as CSV, with null words and quotes in cells, and read again."""
    at = _folder(spark)
    c = read(spark, sf_dir, "customer")
    word = F.when(F.col("c_nationkey") % 3 == 0, F.element_at(F.array(*map(F.lit, ("N/A", "null", "NaN"))), (F.col("c_nationkey") / 3 % 3).cast("int") + 1)).otherwise(F.col("c_mktsegment"))
    odd = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(', "x"')))
    lakes.write_csv(c.select("c_custkey", "c_name", word.alias("c_mktsegment"), odd.alias("quoted")), f"{at}/c.csv")
    return lakes.read_csv(spark, f"{at}/c.csv")


@query("SELECT n_nationkey::VARCHAR AS a, n_name AS b, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey::VARCHAR END AS c FROM nation WHERE n_nationkey % 3 <> 2")
def csv_ragged_rows(spark, sf_dir):
    """Rows longer than the header are skipped, though their surplus cells be empty; shorter ones are filled up."""
    at = f"{_folder(spark)}/ragged.csv"
    line = F.expr("concat_ws(',', n_nationkey, n_name, CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN string(n_regionkey) ELSE concat(n_regionkey, ',,') END)")
    head = spark.createDataFrame([("a,b,c",)], "value string")
    head.union(read(spark, sf_dir, "nation").select(line)).coalesce(1).write.text(at)
    return lakes.read_csv(spark, at)


_LAKE_CSV = """SELECT tbl, col, n_rows, n_nulls FROM (
SELECT 'customers' AS tbl, unnest(['c_custkey', 'c_name__x', 'seg']) AS col, count(*) AS n_rows, unnest([0, 0, count(*) FILTER (WHERE c_nationkey = 1)]) AS n_nulls FROM customer UNION ALL
SELECT 'nations', unnest(['n_nationkey', 'n_name']), count(*), 0 FROM nation)"""


@query(_LAKE_CSV)
def csv_lake_cleaned(spark, sf_dir):
    """A folder of CSV files as a lake: headers cleaned, an empty table and a column without values left out."""
    at = _folder(spark)
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("c_name:x"), F.lit(None).cast("string").alias("nothing"), F.when(F.col("c_nationkey") != 1, F.col("c_mktsegment")).alias("seg"))
    lakes.write_csv(c, f"{at}/customers.csv")
    lakes.write_csv(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), f"{at}/nations.csv")
    lakes.write_csv(read(spark, sf_dir, "region").where("r_regionkey < 0"), f"{at}/empty.csv")
    return profile.null_profile(lakes.Lake.from_csv(spark, at).value_counts()).select("tbl", "col", "n_rows", "n_nulls")


@query("SELECT n_name || '�' AS line FROM nation")
def utf8_repaired(spark, sf_dir):
    """Text with bytes that aren't UTF-8 in it, and with a replacement character of its own."""
    at = f"{_folder(spark)}/broken"
    broken = F.concat(F.unhex(F.lit("FF")), F.col("n_name").cast("binary"), F.unhex(F.lit("C3")), F.lit("�").cast("binary"), F.unhex(F.lit("80"))).cast("string")
    read(spark, sf_dir, "nation").select(broken.alias("value")).write.text(at)
    return lakes.repair_utf8(spark, at)


@query(with_sql(r"SELECT tbl, col, trim(regexp_replace(tbl || ':' || col || '? /x\', '[<>:\"/\\|?*\x00-\x1f]', '__', 'g')) AS clean FROM cols", "cols"))
def sanitize_headers(spark, sf_dir):
    rows = driver_lake(spark, sf_dir).catalog().select("tbl", "col").collect()  # the catalog
    return spark.createDataFrame([(r.tbl, r.col, lakes.clean_header(f"{r.tbl}:{r.col}? /x\\")) for r in rows], "tbl string, col string, clean string")


@query(with_sql("""SELECT name, CASE WHEN h > t THEN right(name, 20) WHEN h < t OR h = 1 THEN left(name, 20) ELSE left(name, 20) || '_' || row_number() OVER (PARTITION BY h > t, h < t OR h = 1, left(name, 20) ORDER BY name) END AS short
FROM (SELECT name, count(*) OVER (PARTITION BY left(name, 20)) AS h, count(*) OVER (PARTITION BY right(name, 20)) AS t FROM (SELECT 'a_long_start_of_name_' || tbl || '_' || col AS name FROM cols))""", "cols"))
def shortened_names(spark, sf_dir):
    names = sorted(f"a_long_start_of_name_{t}_{c}" for t, cols in COLUMNS.items() for c in cols)
    return spark.createDataFrame(list(lakes.short_names(names, 20).items()), "name string, short string")


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5(concat_ws(chr(31), '3', c_custkey, c_name)) LIMIT 40")
def capped_rows(spark, sf_dir):
    return lakes.cap_rows(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), 40, seed=3)


@query("SELECT n_regionkey AS b, n_name AS a FROM nation")
def last_of_equal_columns(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    return lakes.keep_last_columns(n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"), F.col("n_name").alias("a")))


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5(concat_ws(chr(31), '5', o_orderkey)), o_orderkey LIMIT 100")
def sampled_rows(spark, sf_dir):
    return lists.sampled(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", count=100, seed=5)


@query(f"SELECT o_orderkey FROM orders WHERE {portable.h28_sql("concat_ws(chr(31), '5', o_orderkey)")} < {int(0.1 * (1 << 28))}")
def sampled_share(spark, sf_dir):
    return lists.sampled(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", fraction=0.1, seed=5)


@query("SELECT '{\"r_regionkey\":\"' || r_regionkey || '\",\"r_name\":\"' || r_name || '\"}' AS row FROM region")
def grid_rows(spark, sf_dir):
    return lakes.to_grid(read(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query("SELECT r_regionkey::VARCHAR AS r_regionkey, nullif(r_name, 'ASIA') AS r_name FROM region")
def grid_table(spark, sf_dir):
    rows = read(spark, sf_dir, "region").orderBy("r_regionkey").collect()  # a grid is a small document
    grid = {"columns": ["r_regionkey", "r_name"], "data": {str(i): [r.r_regionkey, None if r.r_name == "ASIA" else r.r_name] for i, r in enumerate(rows)}}
    return lakes.from_grid(spark, grid)


@query(f"WITH {_FIVE} SELECT 'q1' AS query_id, unnest([0, 1, 2]) AS q, unnest(['mktsegment', 'name', 'name']) AS semantic_type, i::INT AS example_row, unnest([c_mktsegment, n_name, r_name]) AS example FROM f")
def query_tables_stored(spark, sf_dir):
    """Query tables written as JSON and read again."""
    at = f"{_folder(spark)}/queries"
    lakes.write_query_tables(spark, [{"query_id": "q1", "query": example_query(spark, sf_dir)}], at)
    column = lakes.read_query_tables(spark, at, lines=True).select("query_id", F.posexplode("query").alias("q", "c"))
    return column.select("query_id", "q", "c.semantic_type", F.posexplode("c.examples").alias("example_row", "example"))


# --- joins -------------------------------------------------------------------------------------------------------------

_TWO = chain("orders.o_custkey=customer.c_custkey", "customer.c_nationkey=nation.n_nationkey")
_BACK = chain("nation.n_regionkey=region.r_regionkey", "region.r_regionkey=nation.n_regionkey")
_KEYED = "md5(concat_ws(chr(31), '7', {}))"


@query(f"""WITH a AS (SELECT c_custkey, o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY {_KEYED.format("c_custkey, o_orderkey")} LIMIT 300)
SELECT o_orderkey AS orders_rid, c_custkey AS customer_rid, n_nationkey::BIGINT AS nation_rid FROM a JOIN nation ON c_nationkey = n_nationkey ORDER BY {_KEYED.format("c_custkey, n_nationkey, o_orderkey")} LIMIT 300""")
def sampled_join(spark, sf_dir):
    out = execute.perform_joins(execute.project(driver_lake(spark, sf_dir), _TWO), _TWO, sample=300, seed=7)
    return out.select(*(F.col(f"Index_{t}").alias(f"{t}_rid") for t in ("orders", "customer", "nation")))


@query("SELECT a.n_nationkey::BIGINT AS first_rid, r_regionkey::BIGINT AS region_rid, b.n_nationkey::BIGINT AS second_rid FROM nation a JOIN region ON a.n_regionkey = r_regionkey JOIN nation b ON b.n_regionkey = r_regionkey")
def self_join(spark, sf_dir):
    out = execute.perform_joins(execute.project(driver_lake(spark, sf_dir), _BACK), _BACK, self_join=True)
    return out.select(F.col("Index_nation").alias("first_rid"), F.col("Index_region").alias("region_rid"), F.col("Index_nation__2").alias("second_rid"))


@query("""SELECT 'skipped' AS mode, count(*) AS cardinality FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'joined', count(*) FROM nation a JOIN region ON a.n_regionkey = r_regionkey JOIN nation b ON b.n_regionkey = r_regionkey""")
def repeated_table_cardinality(spark, sf_dir):
    tables = execute.project(driver_lake(spark, sf_dir), _BACK)
    each = [execute.cardinality(tables, _BACK, again).select(F.lit(mode).alias("mode"), F.col("cardinality").cast("long").alias("cardinality")) for mode, again in (("skipped", False), ("joined", True))]
    return each[0].union(each[1])


@query("SELECT DISTINCT c_custkey AS customer_rid FROM customer JOIN orders ON o_custkey = c_custkey")
def matched_rows(spark, sf_dir):
    """Row ids of a table that a join keeps."""
    order = chain("customer.c_custkey=orders.o_custkey")
    return execute.perform_joins(execute.project(driver_lake(spark, sf_dir), order), order).select(F.col("Index_customer").alias("customer_rid")).distinct()


@query(f"""WITH c AS (SELECT simhash_key, count(*) AS n FROM (SELECT {portable.simhash_sql('b')} AS simhash_key FROM (SELECT {portable.buckets_sql('p_type')} AS b FROM part)) GROUP BY 1)
SELECT simhash_key AS key, n FROM c""")
def keys_by_family(spark, sf_dir):
    """Join keys of a text column: simhashes with their counts."""
    p = driver_lake(spark, sf_dir).tables["part"]
    return p.select(execute.key_of("p_type", graph.SEMANTIC_HASH).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _cells_sql(key: str, weight: str, source: str, depth: int, width: int) -> str:
    cell = portable.h28_sql(f"concat_ws(':', row, {key})")
    return f"SELECT row, {cell} % {width} AS cell, sum({weight}) AS total FROM {source}, (SELECT unnest(range({depth})) AS row) GROUP BY 1, 2"


def _estimate_sql(key: str, source: str, cells: str, depth: int, width: int) -> str:
    cell = portable.h28_sql(f"concat_ws(':', row, {key})")
    return f"SELECT s.*, min(total) AS estimate FROM (SELECT * FROM {source}) s, (SELECT unnest(range({depth})) AS row) r JOIN {cells} k ON k.row = r.row AND k.cell = {cell.replace('row', 'r.row')} % {width} GROUP BY ALL HAVING count(*) = {depth}"


@query(f"""WITH first AS (SELECT c_nationkey AS key, count(*) AS n FROM customer GROUP BY 1), hop AS (SELECT n_nationkey AS kin, n_regionkey AS kout, count(*) AS n FROM nation GROUP BY 1, 2), last AS (SELECT r_regionkey AS key, count(*) AS n FROM region GROUP BY 1),
k1 AS ({_cells_sql('key', 'n', 'first', 3, 16)}), e1 AS ({_estimate_sql('kin', 'hop', 'k1', 3, 16)}),
k2 AS ({_cells_sql('kout', 'estimate * n', 'e1', 3, 16)}), e2 AS ({_estimate_sql('key', 'last', 'k2', 3, 16)}) SELECT sum(estimate * n)::BIGINT AS cardinality FROM e2""")
def count_min_cardinality(spark, sf_dir):
    """A chain's size from count-min sketches so narrow that keys collide."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    first = c.groupBy(F.col("c_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    hop = n.groupBy(F.col("n_nationkey").alias("kin"), F.col("n_regionkey").alias("kout")).agg(F.count(F.lit(1)).alias("n"))
    last = r.groupBy(F.col("r_regionkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return sketch.count_min_cardinality(first, [hop], last, depth=3, width=16).select(F.col("cardinality").cast("long").alias("cardinality"))


# --- profiles and similarity -------------------------------------------------------------------------------------------


@query("SELECT c_nationkey, round(abs(-sum(p * log2(p))), 6) AS entropy FROM (SELECT c_nationkey, count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey) AS p FROM customer GROUP BY c_nationkey, c_mktsegment) GROUP BY 1")
def entropy_of_lists(spark, sf_dir):
    items = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list("c_mktsegment").alias("items"))
    return items.select("c_nationkey", r6(F.abs(profile.entropy_of_list(F.col("items")))).alias("entropy"))


@query("""WITH a AS (SELECT c_nationkey AS k, list_distinct(list(c_mktsegment || c_custkey % 4)) AS s FROM customer GROUP BY 1)
SELECT x.k AS k1, y.k AS k2, round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 6) AS jaccard FROM a x JOIN a y ON x.k < y.k""")
def jaccard_of_lists(spark, sf_dir):
    items = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(F.concat("c_mktsegment", F.col("c_custkey") % 4)).alias("items"))
    both = items.toDF("k1", "i1").join(items.toDF("k2", "i2"), F.col("k1") < F.col("k2"))  # nations
    return both.select("k1", "k2", r6(vectors.jaccard_of_arrays(F.col("i1"), F.col("i2"))).alias("jaccard"))


_FAMILY = """k AS (SELECT DISTINCT tbl, col, is_numeric, CASE WHEN is_numeric THEN 'v' || value ELSE 's' || simhash END AS key FROM sh JOIN flags USING (tbl, col) WHERE value IS NOT NULL),
s AS (SELECT f.tbl, f.col, f.is_numeric, count(key) AS n FROM flags f LEFT JOIN k USING (tbl, col) GROUP BY ALL),
b AS (SELECT x.tbl AS tbl1, x.col AS col1, y.tbl AS tbl2, y.col AS col2, count(*) AS n_both FROM k x JOIN k y ON x.key = y.key AND x.tbl < y.tbl GROUP BY ALL),
g AS (SELECT x.tbl AS tbl1, x.col AS col1, y.tbl AS tbl2, y.col AS col2, x.is_numeric, x.n AS n1, y.n AS n2, coalesce(n_both, 0) AS n_both FROM s x JOIN s y ON x.tbl < y.tbl AND x.is_numeric = y.is_numeric
 LEFT JOIN b ON b.tbl1 = x.tbl AND b.col1 = x.col AND b.tbl2 = y.tbl AND b.col2 = y.col)"""


@query(with_sql(f"|, {_FAMILY} SELECT tbl1, col1, tbl2, col2, is_numeric, round(CASE WHEN n1 + n2 = n_both THEN 1 ELSE n_both / (n1 + n2 - n_both) END, 6) AS jaccard FROM g", "sh", "flags").replace(" |,", ","))
def family_jaccard(spark, sf_dir):
    d = _known(spark, sf_dir)
    return similarity.family_jaccard(d.counts, d.profile, d.columns).select(*PAIR, "is_numeric", r6("jaccard").alias("jaccard"))


_TRUTH = f"""{_FAMILY}, t AS (SELECT tbl1, col1, tbl2, col2, is_numeric, round(CASE WHEN n1 > 0 AND n2 > 0 THEN (n_both / n1 + n_both / n2) / 2 ELSE 0 END, 6) AS joinability FROM g)
"""


@query(with_sql(f"|, {_TRUTH} SELECT tbl1, col1, tbl2, col2, joinability, CASE WHEN is_numeric THEN 'natural' ELSE 'semantichash' END AS edge_type, row_number() OVER (PARTITION BY tbl1, tbl2 ORDER BY joinability DESC, col1, col2) AS nth FROM t WHERE joinability >= 0.3", "sh", "flags").replace(" |,", ","))
def truth_edges(spark, sf_dir):
    """Edges by exact containment, ranked for each pair of tables: the graph that sketches are held against."""
    found = workload.ground_truth_edges(_known(spark, sf_dir), 0.3).withColumn("joinability", r6("joinability"))
    return workload.ranked_truth(found).select(*PAIR, "joinability", "edge_type", "nth")


@query("SELECT n_regionkey, md5('[' || string_agg('\"' || n_name || '\"', ', ' ORDER BY n_name) || ']') AS content_hash, sha256(string_agg(n_name, '' ORDER BY n_name)) AS tuple_hash FROM nation GROUP BY 1")
def content_hashes(spark, sf_dir):
    names = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return names.select("n_regionkey", vectors.content_hash(F.col("names")).alias("content_hash"), vectors.tuple_hash(F.array_join("names", "")).alias("tuple_hash"))


# --- lists -------------------------------------------------------------------------------------------------------------

_LISTS = "l AS (SELECT n_regionkey AS k, list(n_name ORDER BY n_nationkey) AS names, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY 1)"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("s"))
    return n.select("k", F.col("s.n_name").alias("names"), F.col("s.n_nationkey").alias("keys"))


@query("""WITH s AS (SELECT [(SELECT count(*) FROM region), (SELECT count(DISTINCT c_mktsegment) FROM customer), (SELECT count(DISTINCT n_regionkey) FROM nation)] AS n)
SELECT i, j, k, row_number() OVER (ORDER BY i + j + k, i, j, k) - 1 AS nth FROM (SELECT unnest(range(n[1])) AS i, n FROM s), LATERAL (SELECT unnest(range(n[2])) AS j), LATERAL (SELECT unnest(range(n[3])) AS k)""")
def combinations_by_rank(spark, sf_dir):
    sizes = [read(spark, sf_dir, t).select(c).distinct().count() for t, c in (("region", "r_regionkey"), ("customer", "c_mktsegment"), ("nation", "n_regionkey"))]
    return spark.createDataFrame([(*at, n) for n, at in enumerate(lists.lazy_combinations(sizes))], "i long, j long, k long, nth long")


@query(f"WITH {_LISTS}, m AS (SELECT k, names, list_filter(range(1, len(keys) + 1), lambda i: keys[i] % 2 = 0) AS pos FROM l) SELECT k, array_to_string(list_slice(names, pos[1], pos[-1]), ',') AS part FROM m WHERE len(pos) > 0")
def between_marks(spark, sf_dir):
    n = _nations(spark, sf_dir)
    return n.select("k", F.array_join(lists.between_marks(F.col("names"), F.transform("keys", lambda x: x % 2 == 0)), ",").alias("part")).where("part IS NOT NULL")


@query(f"WITH {_LISTS} SELECT k, array_to_string(flatten(list_transform(range(1, len(names) + 1), lambda i: [names[i], keys[i]::VARCHAR])), ',') AS mixed, array_to_string(list_filter(range(len(keys)), lambda i: keys[i + 1] = k), ',') AS places FROM l")
def interleaved_lists(spark, sf_dir):
    """Two lists dealt into one, and the places of a value in a list."""
    n = _nations(spark, sf_dir)
    mixed = lists.interleave(F.col("names"), F.col("keys").cast("array<string>"))
    return n.select("k", F.array_join(mixed, ",").alias("mixed"), F.array_join(lists.positions(F.col("keys"), F.col("k")).cast("array<string>"), ",").alias("places"))


@query("SELECT n_regionkey AS k, n_name AS key, n AS value FROM (SELECT n_regionkey, n_name, count(*) AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY count(*) DESC, n_name) AS nth FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) WHERE nth <= 2")
def top_of_maps(spark, sf_dir):
    n = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").count()
    maps = n.groupBy(F.col("n_regionkey").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", "count"))).alias("m"))
    return maps.select("k", F.explode(lists.top_of_map(F.col("m"), 2)).alias("e")).select("k", "e.key", "e.value")


# --- graph and paths ---------------------------------------------------------------------------------------------------


@query(with_sql("SELECT DISTINCT dst FROM edges WHERE src = 'customer'", "edges"))
def table_neighbours(spark, sf_dir):
    return graph.neighbours(_known(spark, sf_dir).edges, "customer")


@query(with_sql("SELECT DISTINCT src, dst FROM edges", "edges"))
def table_adjacency(spark, sf_dir):
    return graph.adjacency(_known(spark, sf_dir).edges)


@query(with_sql("SELECT array_to_string(path, '>') AS path FROM paths WHERE len(path) = 3", "paths"))
def paths_of_three(spark, sf_dir):
    return graph.paths_of(_known(spark, sf_dir).edges, 3).select(_text())


@query(with_sql("SELECT array_to_string(path, '>') AS path, row_number() OVER (ORDER BY md5('11' || chr(31) || array_to_string(path, chr(31)))) AS nth FROM paths", "paths"))
def shuffled_paths(spark, sf_dir):
    """Paths in a seeded order; numbered here to be compared."""
    found = graph.shuffled(_known(spark, sf_dir).paths.select("path"), 11).collect()  # paths of the schema graph
    return spark.createDataFrame([(">".join(r.path), i) for i, r in enumerate(found, 1)], "path string, nth long")


@query(with_sql("SELECT '\"' || src || '\" -- \"' || dst || '\" [label=\"' || src_col || '=' || dst_col || '\"];' AS line FROM edges WHERE nth = 1 AND src < dst", "edges"))
def graph_drawing(spark, sf_dir):
    return graph.dot_text(_known(spark, sf_dir).edges)


_SPAN = "list_filter([list_position(path, 'customer'), list_position(path, 'region')], lambda x: x > 0)"


@query(with_sql(f"SELECT array_to_string(path, '>') AS path, array_to_string(list_slice(path, list_min(pos), list_max(pos)), '>') AS span FROM (SELECT path, {_SPAN} AS pos FROM paths) WHERE len(pos) > 0", "paths"))
def matched_spans(spark, sf_dir):
    span = graph.matched_span(F.col("path"), F.array(F.lit("customer"), F.lit("region")))
    return _known(spark, sf_dir).paths.select("path", F.array_join(span, ">").alias("span")).where("span IS NOT NULL").select(_text(), "span")


@query(with_sql(f"""SELECT array_to_string(path, '>') AS path, m AS matched, row_number() OVER (ORDER BY m DESC, span, contiguity DESC, size DESC, array_to_string(path, '>')) AS nth FROM (
SELECT path, len(pos) AS m, CASE WHEN len(pos) > 0 THEN list_max(pos) - list_min(pos) + 1 ELSE 0 END AS span, CASE WHEN len(pos) > 0 THEN len(pos) / (list_max(pos) - list_min(pos) + 1) ELSE 0 END AS contiguity, len(path) AS size FROM (SELECT path, {_SPAN} AS pos FROM paths))""", "paths"))
def ranked_paths(spark, sf_dir):
    """Paths ranked for two tables; a path's length stands for its cardinality."""
    paths = _known(spark, sf_dir).paths.select("path", F.size("path").alias("cardinality"))
    found = graph.rank_paths(paths, ["customer", "region"]).collect()  # paths of the schema graph
    return spark.createDataFrame([(">".join(r.path), r.matched, i) for i, r in enumerate(found, 1)], "path string, matched int, nth long")


_NTH = "r AS (SELECT path, row_number() OVER (ORDER BY len(path), array_to_string(path, '>')) AS nth FROM paths)"
_NEEDS = [["customer", "region"], ["region", "customer"], ["nation", "supplier"], ["customer"]]
_NEEDS_SQL = f"n AS (SELECT unnest(range({len(_NEEDS)})) AS need_id, unnest({_NEEDS}) AS tables)"


def _numbered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = sorted((len(r.path), ">".join(r.path), r.path) for r in _known(spark, sf_dir).paths.select("path").collect())  # paths of the schema graph
    return spark.createDataFrame([(p, i) for i, (_, _, p) in enumerate(paths, 1)], "path array<string>, nth int")


@query(with_sql(f"|, {_NTH}, {_NEEDS_SQL} SELECT need_id::INT AS need_id, array_to_string(arg_min(path, nth), '>') AS path, min(nth)::INT AS nth FROM n JOIN r ON len(list_intersect(path, tables)) = len(tables) GROUP BY need_id", "paths").replace(" |,", ","))
def first_covering_paths(spark, sf_dir):
    needs = spark.createDataFrame(list(enumerate(_NEEDS)), "need_id int, tables array<string>")
    return index.first_covering(_numbered_paths(spark, sf_dir), needs).select("need_id", _text(), "nth")


@query(with_sql(f"|, {_NTH}, {_NEEDS_SQL}, c AS (SELECT need_id, arg_min(path, nth) AS path FROM n JOIN r ON len(list_intersect(path, tables)) = len(tables) GROUP BY need_id) SELECT array_to_string(path, '>') AS path, min(need_id)::INT AS need_id FROM c GROUP BY 1", "paths").replace(" |,", ","))
def distinct_chosen_paths(spark, sf_dir):
    needs = spark.createDataFrame(list(enumerate(_NEEDS)), "need_id int, tables array<string>")
    return index.distinct_orders(index.first_covering(_numbered_paths(spark, sf_dir), needs)).select(_text(), "need_id")


@query(with_sql("""SELECT array_to_string(path, '>') AS path, string_agg(concat_ws(':', path[hop + 1], dst_col, path[hop], src_col, edge_type), '>' ORDER BY hop DESC) AS join_order
FROM steps JOIN edges ON src = path[hop] AND dst = path[hop + 1] AND nth = 1 WHERE path[1] = 'customer' AND path[-1] = 'region' GROUP BY 1""", "steps", "edges"))
def orders_from_either_end(spark, sf_dir):
    """Join orders from region to customer, though paths are kept from the smaller name on."""
    found = index.orders_between(_known(spark, sf_dir).paths, "region", "customer")
    hop = F.transform("join_order", lambda h: F.concat_ws(":", h["parent"], h["parent_column"], h["child"], h["child_column"], h["join_type"]))
    return found.select(F.array_join(F.reverse("path"), ">").alias("path"), F.array_join(hop, ">").alias("join_order"))


# --- labels, query by example, workload --------------------------------------------------------------------------------


@query(with_sql("SELECT tbl, col, CASE WHEN tbl = 'nation' THEN 'state ' || col ELSE semantic_type END AS semantic_type FROM labels", "labels"))
def given_labels(spark, sf_dir):
    columns = driver_lake(spark, sf_dir).catalog()
    return labels.given_labels(columns, columns.where("tbl = 'nation'").select("tbl", "col", F.concat(F.lit("state "), "col").alias("semantic_type")))


@query(with_sql("SELECT tbl, col, 'about ' || col AS label FROM cols", "cols"))
def repaired_labels(spark, sf_dir):
    """A labeller that garbles ids: each column takes the label of the likest id."""
    out = []
    for t, cols in COLUMNS.items():
        out += [(t, c, x) for c, x in labels.repaired(cols, {c.upper()[:1].lower() + c[1:] + "_": f"about {c}" for c in cols}).items()]
    return spark.createDataFrame(out, "tbl string, col string, label string")


@query("SELECT n_nationkey, n_name AS a, n_regionkey::INT AS b FROM nation")
def lists_in_prose(spark, sf_dir):
    prose = F.concat(F.lit('Sure, here you are:\n[{"a": "'), "n_name", F.lit('", "b": '), F.col("n_regionkey").cast("string"), F.lit("}]\nIs that it?"))
    found = read(spark, sf_dir, "nation").select("n_nationkey", F.explode(vectors.json_list(prose, "array<struct<a:string,b:int>>")).alias("x"))
    return found.select("n_nationkey", "x.a", "x.b")


@query("""WITH f AS (SELECT c_mktsegment, c_nationkey, row_number() OVER (ORDER BY c_custkey) AS i FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5))
SELECT 'customer' AS tbl, count(DISTINCT i) AS matched FROM f JOIN customer USING (c_mktsegment, c_nationkey)""")
def rows_together(spark, sf_dir):
    """How many example rows stand together in a table: what candidates are ranked by again."""
    rows = read(spark, sf_dir, "customer").orderBy("c_custkey").limit(5).collect()
    examples = qbe.examples_of(spark, [{"examples": [r["c_mktsegment"] for r in rows]}, {"examples": [r["c_nationkey"] for r in rows]}])
    columns = [(0, "customer", "c_mktsegment"), (1, "customer", "c_nationkey")]
    return qbe.rows_together(qbe.postings(driver_lake(spark, sf_dir), columns, {(t, c): True for _, t, c in columns}, examples))


@query(f"WITH {_FIVE} SELECT 0 AS q, 'customer' AS tbl, 'c_mktsegment' AS col UNION ALL SELECT 1, 'nation', 'n_name' WHERE (SELECT count(*) FROM f JOIN nation USING (n_name)) = 5")
def full_matches(spark, sf_dir):
    """Columns that hold all examples: the segment and the nation, not the region's name among nations."""
    columns = [(0, "customer", "c_mktsegment"), (1, "nation", "n_name"), (2, "nation", "n_name")]
    found = qbe.postings(driver_lake(spark, sf_dir), columns, {(t, c): True for _, t, c in columns}, qbe.examples_of(spark, example_query(spark, sf_dir)))
    return qbe.full_matches(found, 5)


@query(with_sql("SELECT least(5, 5 * count(*))::BIGINT AS n_queries, 0::BIGINT AS n_wrong FROM links WHERE src < dst", "links"))
def workload_of_queries(spark, sf_dir):
    """Generated queries, and how many hold an example row that the full join along their path doesn't have."""
    d = _known(spark, sf_dir)
    found = workload.workload(d, 5, vertices=2, seed=3)
    wrong = 0
    for q in found:
        tables = execute.project(d.lake, q["join_order"])
        columns = [(c["table"], c["column"]) for c in q["query"]]
        rows = execute.fetch_columns(d.lake, execute.perform_joins(tables, q["join_order"]), columns).select(*dict.fromkeys(f"{t}_{c}" for t, c in columns))
        asked = {tuple(dict(zip((f"{t}_{c}" for t, c in columns), r, strict=True)).items()) for r in zip(*(c["examples"] for c in q["query"]), strict=True)}
        wanted = spark.createDataFrame([dict(a) for a in asked], ", ".join(f"`{c}` string" for c in rows.columns))
        wrong += wanted.exceptAll(rows.distinct()).count()
    return spark.createDataFrame([(len(found), wrong)], "n_queries long, n_wrong long")


@query(f"SELECT tbl, col, count(*) AS n_values, round(sum(size), 6) AS grams FROM (SELECT DISTINCT 'nation' AS tbl, 'n_name' AS col, n_name AS v, list_sum({portable.gram_counts_sql('n_name')}) AS size FROM nation UNION ALL SELECT DISTINCT 'part', 'p_type', p_type, list_sum({portable.gram_counts_sql('p_type')}) FROM part) GROUP BY 1, 2")
def value_embeddings(spark, sf_dir):
    """Vectors of the distinct values of text columns, each value once; summed here to be compared."""
    d = _known(spark, sf_dir)
    found = labels.value_embeddings(d.counts.where("tbl = 'nation' AND col = 'n_name' OR tbl = 'part' AND col = 'p_type'"))
    return found.groupBy("tbl", "col").agg(F.count(F.lit(1)).alias("n_values"), r6(F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x))).alias("grams"))

