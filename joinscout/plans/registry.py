"""The library's queries over the driver's tables, with SQL for each. Rounding is to 6 places in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinscout.functions import portable, vectors
from joinscout.operators import execute, graph, index, labels, lists, metrics, profile, qbe, similarity, sketch
from joinscout.operators.qbe import Discovery
from joinscout.plans.driver_lake import driver_lake, with_sql
from joinscout.sources import lake as lakes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
PAIR = ["tbl1", "col1", "tbl2", "col2"]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: str | F.Column) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- lake and profiles -------------------------------------------------------------------------------------------------


@query(with_sql("SELECT tbl, col, tbl_ord, col_ord FROM cols", "cols"))
def lake_catalog(spark, sf_dir):
    return driver_lake(spark, sf_dir).catalog()


@query(with_sql("SELECT tbl, col, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (WHERE value IS NULL), 0)::BIGINT AS n_nulls, count(value) AS n_distinct FROM vc GROUP BY tbl, col", "vc"))
def cells_null_profile(spark, sf_dir):
    return profile.null_profile(driver_lake(spark, sf_dir).value_counts())


@query(with_sql("SELECT tbl, col, value, n, nth FROM top10", "top10"))
def top_n_values(spark, sf_dir):
    return profile.top_values(driver_lake(spark, sf_dir).value_counts())


@query(with_sql("SELECT * FROM flags", "flags"))
def numeric_flag(spark, sf_dir):
    lake = driver_lake(spark, sf_dir)
    return profile.numeric_flags(lake.value_counts(), lake.catalog())


@query(with_sql("SELECT tbl, col, round(diversity, 6) AS diversity FROM diversity", "diversity"))
def diversity_simpson(spark, sf_dir):
    return profile.simpson(profile.simhash_counts(driver_lake(spark, sf_dir).value_counts())).select("tbl", "col", r6("diversity").alias("diversity"))


_SHARES = "SELECT tbl, col, n / sum(n) OVER (PARTITION BY tbl, col) AS p, count(*) OVER (PARTITION BY tbl, col) AS kinds FROM "


@query(with_sql(f"SELECT tbl, col, CASE WHEN max(kinds) > 1 THEN round(-sum(p * ln(p)) / ln(max(kinds)), 6) ELSE 0 END AS evenness FROM ({_SHARES} species) GROUP BY tbl, col", "species"))
def evenness_shannon(spark, sf_dir):
    return profile.evenness(profile.simhash_counts(driver_lake(spark, sf_dir).value_counts())).select("tbl", "col", r6("evenness").alias("evenness"))


@query(with_sql(f"SELECT tbl, col, abs(round(-sum(p * log2(p)), 6)) AS entropy FROM ({_SHARES} vc) GROUP BY tbl, col", "vc"))
def entropy_bits(spark, sf_dir):
    return profile.entropy(driver_lake(spark, sf_dir).value_counts()).select("tbl", "col", F.abs(r6("entropy")).alias("entropy"))


@query(with_sql("SELECT DISTINCT a.tbl AS tbl1, b.tbl AS tbl2 FROM cols a JOIN cols b ON a.tbl < b.tbl", "cols"))
def table_pairs(spark, sf_dir):
    t = driver_lake(spark, sf_dir).catalog().select("tbl").distinct()
    return t.toDF("tbl1").join(t.toDF("tbl2"), F.col("tbl1") < F.col("tbl2"))


@query(with_sql("SELECT a.tbl AS tbl1, a.col AS col1, b.tbl AS tbl2, b.col AS col2 FROM cols a JOIN cols b ON a.tbl < b.tbl", "cols"))
def column_pairs(spark, sf_dir):
    c = driver_lake(spark, sf_dir).catalog().select("tbl", "col")
    return c.toDF("tbl1", "col1").join(c.toDF("tbl2", "col2"), F.col("tbl1") < F.col("tbl2"))


# --- sketches and overlaps ---------------------------------------------------------------------------------------------

_SETS = """d AS (SELECT DISTINCT tbl, col, value FROM vc WHERE value IS NOT NULL), s AS (SELECT c.tbl, c.col, count(value) AS n FROM cols c LEFT JOIN d USING (tbl, col) GROUP BY c.tbl, c.col),
b AS (SELECT x.tbl AS tbl1, x.col AS col1, y.tbl AS tbl2, y.col AS col2, count(*) AS n_both FROM d x JOIN d y ON x.value = y.value AND x.tbl < y.tbl GROUP BY 1, 2, 3, 4),
g AS (SELECT x.tbl AS tbl1, x.col AS col1, y.tbl AS tbl2, y.col AS col2, x.n AS n1, y.n AS n2, coalesce(n_both, 0) AS n_both FROM s x JOIN s y ON x.tbl < y.tbl
 LEFT JOIN b ON b.tbl1 = x.tbl AND b.col1 = x.col AND b.tbl2 = y.tbl AND b.col2 = y.col)"""


def _sets(select: str) -> str:
    return with_sql("|", "vc", "cols").replace(" |", f", {_SETS} {select}")


@query(_sets("SELECT tbl1, col1, tbl2, col2, n_both, round(CASE WHEN n1 + n2 = n_both THEN 1 ELSE n_both / (n1 + n2 - n_both) END, 6) AS jaccard FROM g"))
def value_jaccard_exact(spark, sf_dir):
    lake = driver_lake(spark, sf_dir)
    return similarity.jaccard(similarity.overlaps(lake.value_counts(), lake.catalog(), "value")).select(*PAIR, "n_both", r6("jaccard").alias("jaccard"))


@query(_sets("SELECT tbl1, col1, tbl2, col2, round(n_both / n1, 6) AS in1, round(n_both / n2, 6) AS in2, round((n_both / n1 + n_both / n2) / 2, 6) AS joinability FROM g"))
def containment_directed(spark, sf_dir):
    lake = driver_lake(spark, sf_dir)
    found = similarity.containment(similarity.overlaps(lake.value_counts(), lake.catalog(), "value"))
    return found.select(*PAIR, *(r6(c).alias(c) for c in ("in1", "in2", "joinability")))


@query(with_sql("SELECT tbl, col, array_to_string(s, ',') AS signature FROM vsig", "vsig"))
def minhash_signature(spark, sf_dir):
    found = sketch.signatures(driver_lake(spark, sf_dir).value_counts(), "value")
    return found.select("tbl", "col", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


@query(with_sql("SELECT tbl1, col1, tbl2, col2, round(jaccard, 6) AS jaccard FROM vj", "vj"))
def minhash_jaccard(spark, sf_dir):
    lake = driver_lake(spark, sf_dir)
    return sketch.estimated_jaccard(sketch.signatures(lake.value_counts(), "value"), lake.catalog()).select(*PAIR, r6("jaccard").alias("jaccard"))


@query(with_sql("SELECT tbl, col, value, simhash FROM sh", "sh"))
def simhash_values(spark, sf_dir):
    return driver_lake(spark, sf_dir).value_counts().select("tbl", "col", "value", portable.simhash(F.col("value")).alias("simhash"))


@query(with_sql("SELECT tbl1, col1, tbl2, col2, round(jaccard, 6) AS jaccard FROM sj", "sj"))
def simhash_minhash_jaccard(spark, sf_dir):
    lake = driver_lake(spark, sf_dir)
    return sketch.estimated_jaccard(sketch.signatures(profile.simhash_counts(lake.value_counts()), "simhash"), lake.catalog()).select(*PAIR, r6("jaccard").alias("jaccard"))


@query(with_sql("SELECT tbl1, col1, tbl2, col2, round(type_similarity, 6) AS type_similarity FROM ts", "ts"))
def type_label_similarity(spark, sf_dir):
    found = similarity.label_similarity(labels.encoded(labels.header_labels(driver_lake(spark, sf_dir).catalog())))
    return found.select(*PAIR, r6("type_similarity").alias("type_similarity"))


@query(with_sql("SELECT tbl, col, semantic_type FROM labels", "labels"))
def header_types(spark, sf_dir):
    return labels.header_labels(driver_lake(spark, sf_dir).catalog())


# --- vectors -----------------------------------------------------------------------------------------------------------

PLANES = [[float(x) for x in row] for row in portable.signs(portable.BITS, 64)]
_V = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_PLANE_BITS = " || ".join(f"CASE WHEN list_inner_product(v, {[float(x) for x in row]}::DOUBLE[]) > 0 THEN '1' ELSE '0' END" for row in PLANES)
_COS, _EUC = "list_cosine_similarity(a.v, b.v)", "list_distance(a.v, b.v)"


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated query set, every vector whose id is divisible by 100, and all vectors."""
    e = read(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id1"), v.alias("v1")), e.select(F.col("vec_id").alias("id2"), v.alias("v2"))


@query(f"WITH {_V} SELECT id AS vec_id, {_PLANE_BITS} AS simhash FROM e")
def embedding_simhash(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", vectors.hyperplane_hash(F.col("embedding"), PLANES).alias("simhash"))


@query("SELECT vec_id, array_to_string(list_transform(embedding[1:18], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS signs FROM embeddings")
def embedding_sign_hash(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", vectors.sign_hash(F.col("embedding"), portable.BITS).alias("signs"))


@query(f"""WITH {_V}, s AS (SELECT a.id AS id1, b.id AS id2, {_COS} AS x FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id)
SELECT id1, id2, round(x, 6) AS score, nth FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY x DESC, id2) AS nth FROM s) WHERE nth <= 10""")
def cosine_topk(spark, sf_dir):
    a, b = _asked(spark, sf_dir)
    return similarity.top_k(a, b, 10, "cosine", skip_same=True).select("id1", "id2", r6("score").alias("score"), "nth")


@query(f"""WITH {_V}, s AS (SELECT a.id AS id1, b.id AS id2, {_EUC} AS x FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id)
SELECT id1, id2, round(x, 6) AS score, nth FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY x, id2) AS nth FROM s) WHERE nth <= 10""")
def euclid_topk(spark, sf_dir):
    a, b = _asked(spark, sf_dir)
    return similarity.top_k(a, b, 10, skip_same=True).select("id1", "id2", r6("score").alias("score"), "nth")


@query(f"WITH {_V} SELECT a.id AS id1, b.id AS id2, round({_COS}, 6) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id WHERE {_COS} >= 0.3")
def cosine_pairs_ge(spark, sf_dir):
    a, b = _asked(spark, sf_dir)
    return similarity.within(a, b, "cosine_ge", 0.3).where("id1 <> id2").select("id1", "id2", r6("score").alias("score"))


@query(f"WITH {_V} SELECT a.id AS id1, b.id AS id2, round({_EUC}, 6) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id WHERE {_EUC} <= 1.25")
def euclid_pairs_le(spark, sf_dir):
    a, b = _asked(spark, sf_dir)
    return similarity.within(a, b, "euclid_le", 1.25).where("id1 <> id2").select("id1", "id2", r6("score").alias("score"))


@query(f"WITH {_V} SELECT id AS vec_id FROM e a WHERE id % 100 = 0 AND EXISTS (SELECT 1 FROM e b WHERE b.id % 100 <> 0 AND {_COS} > 0.3)")
def semantic_semi_join(spark, sf_dir):
    a, b = _asked(spark, sf_dir)
    return similarity.semi_join(a, b.where("id2 % 100 <> 0"), 0.3).select(F.col("id1").alias("vec_id"))


@query(f"""WITH {_V}, x AS (SELECT * FROM e WHERE id % 100 = 0), y AS (SELECT * FROM e WHERE id % 100 <> 0),
s AS (SELECT (SELECT count(*) FROM x a WHERE EXISTS (SELECT 1 FROM y b WHERE {_COS} > 0.3)) / (SELECT count(*) FROM x) AS in1,
             (SELECT count(*) FROM y a WHERE EXISTS (SELECT 1 FROM x b WHERE {_COS} > 0.3)) / (SELECT count(*) FROM y) AS in2)
SELECT round(in1, 6) AS in1, round(in2, 6) AS in2, round((in1 + in2) / 2, 6) AS joinability FROM s""")
def semantic_joinability(spark, sf_dir):
    a, b = _asked(spark, sf_dir)
    return similarity.semantic_joinability(a, b.where("id2 % 100 <> 0"), 0.3).select(*(r6(c).alias(c) for c in ("in1", "in2", "joinability")))


@query(f"WITH {_V} SELECT a.id AS id1, b.id AS id2, round(1 - sqrt(greatest(2 - 2 * {_COS}, 0)) / 2, 5) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id")
def normalized_euclid(spark, sf_dir):
    a, b = _asked(spark, sf_dir)
    return similarity.normalized_euclid(a, b, 5)


@query(f"""WITH {_V}, s AS (SELECT a.id AS id1, b.id AS id2, {_COS} AS x FROM e a JOIN e b ON a.id % 100 = 0 AND b.id % 100 <> 0),
t AS (SELECT id1, avg(x) AS m FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY x DESC, id2) AS nth FROM s) WHERE nth <= 10 GROUP BY id1) SELECT round(avg(m), 6) AS mean_score FROM t""")
def topk_mean_cosine(spark, sf_dir):
    a, b = _asked(spark, sf_dir)
    return similarity.top_k_mean(a, b.where("id2 % 100 <> 0"), 10).select(r6("mean_score").alias("mean_score"))


WORDS = ["STANDARD BRASS", "blue part", "machinery"]


@query(f"""WITH a AS (SELECT w, {portable.gram_counts_sql('w')} AS v FROM (SELECT unnest({WORDS}) AS w)), b AS (SELECT w, {portable.gram_counts_sql('w')} AS v FROM (SELECT DISTINCT p_type AS w FROM part))
SELECT b.w AS value, round(max({_COS}), 6) AS best FROM b, a GROUP BY b.w HAVING max({_COS}) > 0.4""")
def string_filter_cosine(spark, sf_dir):
    a = spark.createDataFrame([(w,) for w in WORDS], "id1 string").withColumn("v1", portable.gram_counts(F.col("id1")))
    b = read(spark, sf_dir, "part").select(F.col("p_type").alias("id2")).distinct().withColumn("v2", portable.gram_counts(F.col("id2")))
    return similarity.close_strings(a, b, 0.4).select(F.col("id2").alias("value"), r6("best").alias("best"))


@query(f"""WITH a AS (SELECT w, {portable.gram_counts_sql('w')} AS v FROM (SELECT DISTINCT n_name AS w FROM nation)), b AS (SELECT w, {portable.gram_counts_sql('w')} AS v FROM (SELECT DISTINCT r_name AS w FROM region))
SELECT a.w AS value1, b.w AS value2, round({_EUC}, 6) AS score FROM a, b WHERE a.w <> b.w ORDER BY {_EUC}, a.w, b.w LIMIT 10""")
def closest_value_pairs(spark, sf_dir):
    a = read(spark, sf_dir, "nation").select(F.col("n_name").alias("value1")).withColumn("v1", portable.gram_counts(F.col("value1")))
    b = read(spark, sf_dir, "region").select(F.col("r_name").alias("value2")).withColumn("v2", portable.gram_counts(F.col("value2")))
    return similarity.closest_value_pairs(a, b, 10, skip_equal=True).select("value1", "value2", r6("score").alias("score"))


_HASHED = f"""x AS (SELECT s_suppkey AS rid, s_name AS value, {portable.buckets_sql('s_name')} AS b FROM supplier), y AS (SELECT c_custkey AS rid, c_name AS value, {portable.buckets_sql('c_name')} AS b FROM customer),
a AS (SELECT rid, value, {portable.simhash_sql('b')} AS h FROM x), c AS (SELECT rid, value, {portable.simhash_sql('b')} AS h FROM y)"""


def _hashed(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [read(spark, sf_dir, t).select(F.col(k).alias("rid"), F.col(v).alias("value"), portable.simhash(F.col(v)).alias("simhash")) for t, k, v in (("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"))]


@query(f"WITH {_HASHED} SELECT a.value AS value1, c.value AS value2, a.rid AS rid1, c.rid AS rid2 FROM a JOIN c USING (h)")
def semantic_match_pairs(spark, sf_dir):
    return similarity.simhash_matches(*_hashed(spark, sf_dir))


@query(f"WITH {_HASHED} SELECT a.value AS value1, c.value AS value2, min(a.rid) AS rid1, min(c.rid) AS rid2 FROM a JOIN c USING (h) WHERE a.value <> c.value GROUP BY 1, 2")
def matches_without_exact(spark, sf_dir):
    return similarity.without_exact(similarity.simhash_matches(*_hashed(spark, sf_dir)))


# --- graph -------------------------------------------------------------------------------------------------------------


_indexes: dict[tuple[str, str], Discovery] = {}


def _known(spark: SparkSession, sf_dir: str) -> Discovery:
    """One index of each folder for an application: what a query needs of it is made by the first that does, and stored for all."""
    at = spark.sparkContext.applicationId, sf_dir
    if at not in _indexes:
        _indexes[at] = Discovery(driver_lake(spark, sf_dir))
    return _indexes[at]


def _text(path: str = "path") -> F.Column:
    return F.concat_ws(">", path).alias("path")


@query(with_sql("SELECT src, dst, src_col, dst_col, edge_type, round(quality, 6) AS quality, round(diversity, 6) AS diversity, round(type_similarity, 6) AS type_similarity, nth FROM edges", "edges"))
def join_edges(spark, sf_dir):
    return _known(spark, sf_dir).edges.select("src", "dst", "src_col", "dst_col", "edge_type", r6("quality").alias("quality"), r6("diversity").alias("diversity"), r6("type_similarity").alias("type_similarity"), "nth")


@query(with_sql("SELECT src, dst, src_col, dst_col, edge_type, abs(round(-log2(quality), 6)) AS weight FROM edges WHERE nth = 1", "edges"))
def best_edges(spark, sf_dir):
    return graph.best_edges(_known(spark, sf_dir).edges).select("src", "dst", "src_col", "dst_col", "edge_type", F.abs(r6("weight")).alias("weight"))


@query(with_sql("SELECT array_to_string(path, '>') AS path FROM paths", "paths"))
def simple_paths(spark, sf_dir):
    d = _known(spark, sf_dir)
    return graph.simple_paths(d.edges, d.longest, d.kept).select(_text())


@query(with_sql("SELECT len(path)::INT AS vertices, count(*) AS n FROM paths GROUP BY 1", "paths"))
def paths_by_length(spark, sf_dir):
    d = _known(spark, sf_dir)
    return graph.simple_paths(d.edges, d.longest, d.kept).groupBy(F.size("path").alias("vertices")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("""SELECT array_to_string(path, '>') AS path FROM paths WHERE len(path) = 4
AND NOT EXISTS (SELECT 1 FROM links WHERE list_position(path, src) > 0 AND list_position(path, dst) > list_position(path, src) + 1)""", "paths"))
def induced_paths_k(spark, sf_dir):
    d = _known(spark, sf_dir)
    return graph.induced_paths(d.edges, 4, d.kept).select(_text())


@query(with_sql("SELECT array_to_string(path, '>') AS path, join_order FROM orders", "orders"))
def join_orders(spark, sf_dir):
    hop = F.transform("join_order", lambda h: F.concat_ws(":", h["parent"], h["parent_column"], h["child"], h["child_column"], h["join_type"]))
    return _known(spark, sf_dir).paths.select(_text(), F.array_join(hop, ">").alias("join_order"))


@query(with_sql("SELECT array_to_string(path, '>') AS path, unnest(path) AS tbl FROM paths", "paths"))
def path_table_index(spark, sf_dir):
    return index.path_tables(_known(spark, sf_dir).paths).select(_text(), "tbl")


@query(with_sql("SELECT array_to_string(path, '>') AS path FROM paths WHERE list_contains(path, 'customer') AND list_contains(path, 'region')", "paths"))
def covering_paths(spark, sf_dir):
    need = spark.createDataFrame([(0, ["customer", "region"])], "need_id int, tables array<string>")
    return index.covering(_known(spark, sf_dir).paths, need).select(_text())


@query(with_sql("SELECT DISTINCT tbl FROM cols WHERE tbl NOT IN (SELECT unnest(path) FROM paths)", "cols", "paths"))
def tables_without_paths(spark, sf_dir):
    d = _known(spark, sf_dir)
    return index.tables_without_paths(d.columns, d.paths)


# --- execution ---------------------------------------------------------------------------------------------------------


def chain(*hops: str) -> list[dict]:
    """A join order of natural joins: "lineitem.l_orderkey=orders.o_orderkey", ..."""
    out = []
    for h in hops:
        (p, pc), (c, cc) = (x.split(".") for x in h.split("="))
        out.append({"parent": p, "child": c, "parent_column": pc, "child_column": cc, "join_type": graph.NATURAL})
    return out


CHAIN = chain("lineitem.l_orderkey=orders.o_orderkey", "orders.o_custkey=customer.c_custkey", "customer.c_nationkey=nation.n_nationkey", "nation.n_regionkey=region.r_regionkey")
_CHAIN = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
SHORT = CHAIN[2:]
_SHORT = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT count(*) AS cardinality FROM {_CHAIN}")
def path_cardinality(spark, sf_dir):
    lake = driver_lake(spark, sf_dir)
    return execute.cardinality(execute.project(lake, CHAIN), CHAIN).select(F.col("cardinality").cast("long").alias("cardinality"))


@query(f"""SELECT 'customer>nation>region' AS path, count(*) AS cardinality FROM {_SHORT} UNION ALL
SELECT 'lineitem>orders>customer>nation>region', count(*) FROM {_CHAIN} UNION ALL SELECT 'supplier>nation>customer', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey""")
def path_cardinalities(spark, sf_dir):
    orders = [CHAIN, SHORT, chain("supplier.s_nationkey=nation.n_nationkey", "nation.n_nationkey=customer.c_nationkey")]
    return execute.path_cardinalities(driver_lake(spark, sf_dir), [{"join_order": o} for o in orders]).select("path", F.col("cardinality").cast("long").alias("cardinality"))


@query("SELECT s_suppkey AS supplier_rid, c_custkey AS customer_rid FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def natural_join(spark, sf_dir):
    order = chain("supplier.s_nationkey=customer.c_nationkey")
    out = execute.perform_joins(execute.project(driver_lake(spark, sf_dir), order), order)
    return out.select(F.col("Index_supplier").alias("supplier_rid"), F.col("Index_customer").alias("customer_rid"))


@query(f"SELECT l_orderkey * 8 + l_linenumber AS lineitem_rid, o_orderkey AS orders_rid, c_custkey AS customer_rid, n_nationkey::BIGINT AS nation_rid, r_regionkey::BIGINT AS region_rid FROM {_CHAIN}")
def natural_join_chain(spark, sf_dir):
    out = execute.perform_joins(execute.project(driver_lake(spark, sf_dir), CHAIN), CHAIN)
    return out.select(*(F.col(f"Index_{t}").alias(f"{t}_rid") for t in ("lineitem", "orders", "customer", "nation", "region")))


@query(f"WITH {_HASHED} SELECT a.rid AS supplier_rid, c.rid AS customer_rid FROM a JOIN c USING (h)")
def semantic_join_hop(spark, sf_dir):
    order = [chain("supplier.s_name=customer.c_name")[0] | {"join_type": graph.SEMANTIC_HASH}]
    out = execute.perform_joins(execute.project(driver_lake(spark, sf_dir), order), order)
    return out.select(F.col("Index_supplier").alias("supplier_rid"), F.col("Index_customer").alias("customer_rid"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS customer_c_custkey, CAST(c_nationkey AS VARCHAR) AS customer_c_nationkey, c_custkey AS \"Index_customer\" FROM customer WHERE c_custkey IS NOT NULL AND c_nationkey IS NOT NULL")
def join_projection_nulls(spark, sf_dir):
    return execute.project(driver_lake(spark, sf_dir), CHAIN)["customer"].select("customer_c_custkey", "customer_c_nationkey", "Index_customer")


@query(f"SELECT c_mktsegment AS \"customer_c_mktsegment\", r_name AS \"region_r_name\", c_custkey AS \"Index_customer\", r_regionkey::BIGINT AS \"Index_region\" FROM {_SHORT}")
def late_projection(spark, sf_dir):
    lake = driver_lake(spark, sf_dir)
    joined = execute.perform_joins(execute.project(lake, SHORT), SHORT)
    out = execute.fetch_columns(lake, joined, [("customer", "c_mktsegment"), ("region", "r_name")])
    return out.select("customer_c_mktsegment", "region_r_name", "Index_customer", "Index_region")


@query("SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def conjunctive_count(spark, sf_dir):
    return lakes.conjunctive_count(driver_lake(spark, sf_dir).tables["customer"], {"c_mktsegment": "BUILDING", "c_nationkey": "7"})


@query("SELECT c_mktsegment, c_nationkey::VARCHAR AS c_nationkey, min(c_custkey) AS rid FROM customer GROUP BY 1, 2")
def dedupe_subset(spark, sf_dir):
    found = lakes.first_rows(driver_lake(spark, sf_dir).tables["customer"], ["c_mktsegment", "c_nationkey"], [lakes.RID])
    return found.select("c_mktsegment", "c_nationkey", F.col(lakes.RID).alias("rid"))


# --- query by example --------------------------------------------------------------------------------------------------

#: Example rows of a known join, by customer: the first of each market segment. Plain text in both engines.
_EXAMPLES = f"SELECT c_mktsegment, n_name, r_name, c_custkey FROM {_SHORT}"
_FIVE = f"f AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM ({_EXAMPLES} ORDER BY c_custkey LIMIT 5))"
TYPES = ["mktsegment", "name", "name"]


def example_query(spark: SparkSession, sf_dir: str) -> list[dict]:
    """A query table of the five customers of least key with their nation and region; five rows by definition."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).orderBy("c_custkey").limit(5).select("c_mktsegment", "n_name", "r_name").collect()
    return [{"semantic_type": t, "examples": [row[i] for row in rows]} for i, t in enumerate(TYPES)]


_CANDIDATES = [(0, "customer", "c_mktsegment"), (1, "nation", "n_name"), (2, "region", "r_name")]


@query(f"""WITH {_FIVE} SELECT 0 AS q, 'customer' AS tbl, i::INT AS example_row, c.c_custkey AS rid FROM f JOIN customer c USING (c_mktsegment) UNION ALL
SELECT 1, 'nation', i::INT, n_nationkey FROM f JOIN nation USING (n_name) UNION ALL SELECT 2, 'region', i::INT, r_regionkey FROM f JOIN region USING (r_name)""")
def posting_lookup(spark, sf_dir):
    lake = driver_lake(spark, sf_dir)
    numeric = {(t, c): True for _, t, c in _CANDIDATES}  # by value
    return qbe.postings(lake, _CANDIDATES, numeric, qbe.examples_of(spark, example_query(spark, sf_dir))).select("q", "tbl", "example_row", "rid")


@query("""WITH f AS (SELECT c_mktsegment, c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5))
SELECT 'customer' AS tbl, i::INT AS example_row, c_custkey AS rid FROM f JOIN customer USING (c_mktsegment, c_nationkey)""")
def row_intersection(spark, sf_dir):
    lake = driver_lake(spark, sf_dir)
    rows = read(spark, sf_dir, "customer").orderBy("c_custkey").limit(5).collect()
    examples = qbe.examples_of(spark, [{"examples": [r["c_mktsegment"] for r in rows]}, {"examples": [r["c_nationkey"] for r in rows]}])
    columns = [(0, "customer", "c_mktsegment"), (1, "customer", "c_nationkey")]
    return qbe.common_rows(qbe.postings(lake, columns, {(t, c): True for _, t, c in columns}, examples))


@query("WITH f AS (SELECT DISTINCT c_mktsegment FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)) SELECT CAST(c_nationkey AS VARCHAR) AS customer_c_nationkey, c_custkey AS \"Index_customer\" FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM f)")
def semi_reduce(spark, sf_dir):
    lake = driver_lake(spark, sf_dir)
    examples = qbe.examples_of(spark, example_query(spark, sf_dir))
    found = qbe.postings(lake, _CANDIDATES[:1], {("customer", "c_mktsegment"): True}, examples)
    return execute.semi_reduce(execute.project(lake, SHORT)["customer"], found.select("rid").distinct(), "customer")


_UNIT_FAR = "sqrt(greatest(2 - 2 * list_cosine_similarity(a.v, vecs.v), 0))"


@query(with_sql(f"""SELECT q, tbl, col, nth FROM (SELECT q, tbl, col, row_number() OVER (PARTITION BY q ORDER BY round({_UNIT_FAR}, 6), tbl, col) AS nth FROM vecs,
(SELECT unnest([0, 1, 2]) AS q, unnest({[portable.gram_counts_sql(repr(t)) for t in TYPES]}) AS v) a) WHERE nth <= 10""".replace('["', "[").replace('"]', "]").replace('", "', ", "), "vecs"))
def nearest_labels(spark, sf_dir):
    known = labels.encoded(labels.header_labels(driver_lake(spark, sf_dir).catalog()))
    return qbe.nearest_columns(known, spark.createDataFrame(list(enumerate(TYPES)), "q int, semantic_type string"), 10)


@query("""WITH a AS (SELECT unnest(['x1', 'x2', 'x3']) AS item1, unnest([0, 1, 2]) AS r1), b AS (SELECT unnest(['y1', 'y2']) AS item2, unnest([0, 1]) AS r2)
SELECT item1, r1, item2, r2, r1 + r2 AS rank_sum FROM a, b""")
def candidate_combos(spark, sf_dir):
    a = spark.createDataFrame([("x1", 0), ("x2", 1), ("x3", 2)], "item string, r int")
    return lists.ranked_combinations([a, spark.createDataFrame([("y1", 0), ("y2", 1)], "item string, r int")])


@query(f"WITH {_FIVE} SELECT c.c_mktsegment, n.n_name, r.r_name, count(*) AS n FROM customer c JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey WHERE (c.c_mktsegment, n.n_name, r.r_name) IN (SELECT c_mktsegment, n_name, r_name FROM f) GROUP BY 1, 2, 3")
def verify_examples(spark, sf_dir):
    """The flagship: five example rows, answered by discovery alone; the rows of the answer that are examples, with their number."""
    asked = example_query(spark, sf_dir)
    found = qbe.answers(_known(spark, sf_dir), asked)
    best = next((a for a in found if a.rows_found >= 5), None)
    if best is None:
        raise ValueError("no path holds the examples")
    name = {q: f"{t}_{c}" for q, t, c in best.detected}
    rows = best.table.select(F.col(name[0]).alias("c_mktsegment"), F.col(name[1]).alias("n_name"), F.col(name[2]).alias("r_name"))
    wanted = spark.createDataFrame(sorted(set(zip(*(c["examples"] for c in asked), strict=True))), "c_mktsegment string, n_name string, r_name string")
    return rows.join(F.broadcast(wanted), ["c_mktsegment", "n_name", "r_name"], "left_semi").groupBy("c_mktsegment", "n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT c_custkey AS id, c_custkey % 7 AS path_nth, count(o_orderkey) AS rows_found FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
e AS (SELECT id // 3 AS query_id, max((rows_found >= 10)::INT) AS hit FROM r GROUP BY 1) SELECT count(*) AS n_queries, round(avg(hit), 6) AS precision FROM e""")
def precision_at_k(spark, sf_dir):
    """Customers stand for paths, their orders for rows found, three customers for a query: some queries hit, others fail."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    n = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("rows_found"))
    rows = n.select(F.expr("c_custkey div 3").alias("query_id"), (F.col("c_custkey") % 7).alias("path_nth"), "rows_found", F.lit(10).alias("rows_asked"))
    return metrics.precision_at_k(rows).select("n_queries", r6("precision").alias("precision"))


@query("""WITH t AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), f AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
s AS (SELECT count(*) FILTER (WHERE t.doc_id IS NOT NULL AND f.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE t.doc_id IS NULL) AS fp, count(*) FILTER (WHERE f.doc_id IS NULL) AS fn FROM t FULL JOIN f ON t.doc_id = f.doc_id)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp + fn), 6) AS accuracy, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s""")
def set_metrics(spark, sf_dir):
    doc = read(spark, sf_dir, "labels")
    found = metrics.set_metrics(doc.where("toxic = 1"), doc.where("quality = 0"), "doc_id")
    return found.select("tp", "fp", "fn", *(r6(c).alias(c) for c in ("precision", "recall", "accuracy", "f1")))
