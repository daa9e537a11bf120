"""The driver's tables as a lake, and the same relations in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from joinscout.functions import portable
from joinscout.sources.lake import Lake

#: All columns of the relational tables.
COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "region": ["r_regionkey", "r_name"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
}
#: Floating-point numbers and times print differently from engine to engine, so these columns are written in one way.
AMOUNTS = ["c_acctbal", "value", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice", "p_retailprice", "s_acctbal"]
TIMES = ["ts", "l_shipdate", "o_orderdate"]
TEXTS = {c: f"CAST(CAST({c} AS DECIMAL(18, 2)) AS STRING)" for c in AMOUNTS} | {c: f"date_format({c}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')" for c in TIMES}
_SQL_TEXTS = {c: f"CAST(CAST({c} AS DECIMAL(18, 2)) AS VARCHAR)" for c in AMOUNTS} | {c: f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')" for c in TIMES}
#: Row ids from keys, so that they are stable however a table is read.
RIDS = {"customer": "c_custkey", "events": "event_id", "lineitem": "l_orderkey * 8 + l_linenumber", "nation": "n_nationkey", "orders": "o_orderkey", "part": "p_partkey", "region": "r_regionkey", "supplier": "s_suppkey"}


def driver_lake(spark: SparkSession, sf_dir: str) -> Lake:
    return Lake.from_parquet(spark, sf_dir, COLUMNS, RIDS, TEXTS)


def counts_sql() -> str:
    each = [f"SELECT '{t}' AS tbl, '{c}' AS col, {_SQL_TEXTS.get(c, f'CAST({c} AS VARCHAR)')} AS value, count(*) AS n FROM {t} GROUP BY 3" for t, cols in COLUMNS.items() for c in cols]
    return " UNION ALL ".join(each)


def columns_sql() -> str:
    rows = ", ".join(f"('{t}', '{c}', {i}, {j})" for i, (t, cols) in enumerate(COLUMNS.items()) for j, c in enumerate(cols))
    return f"SELECT * FROM (VALUES {rows}) AS c(tbl, col, tbl_ord, col_ord)"


def _pairs(signature: str) -> str:
    same = "list_sum(list_transform(range(1, len(a.s) + 1), lambda i: CASE WHEN a.s[i] = b.s[i] THEN 1 ELSE 0 END))"
    return f"""SELECT a.tbl AS tbl1, a.col AS col1, b.tbl AS tbl2, b.col AS col2, coalesce({same}, 0) / {portable.PERMUTATIONS} AS jaccard
FROM {signature} a JOIN {signature} b ON a.tbl < b.tbl"""


LABEL = "lower(trim(regexp_replace(regexp_replace(regexp_replace(col, '^[a-z]{1,2}_', ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\s]+', ' ', 'g')))"

#: Relations by name, each over those before it.
RELATIONS: dict[str, str] = {
    "vc": counts_sql(),
    "cols": columns_sql(),
    "top10": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tbl, col ORDER BY n DESC, value) AS nth FROM vc WHERE value IS NOT NULL) WHERE nth <= 10",
    "flags": "SELECT c.tbl, c.col, coalesce(2 * sum(length(regexp_replace(value, '[^0-9]', '', 'g'))) > sum(length(value)), false) AS is_numeric FROM cols c LEFT JOIN top10 t USING (tbl, col) GROUP BY c.tbl, c.col",
    "grams": f"SELECT *, {portable.buckets_sql('value')} AS b FROM vc",
    "sh": f"SELECT tbl, col, value, n, {portable.simhash_sql('b')} AS simhash FROM grams",
    "species": "SELECT tbl, col, simhash, sum(n)::DOUBLE AS n FROM sh GROUP BY tbl, col, simhash",
    "diversity": "SELECT tbl, col, CASE WHEN sum(n) > 1 THEN 1 - sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) ELSE 0 END AS diversity FROM species GROUP BY tbl, col",
    "vsig": f"SELECT tbl, col, {portable.minhash_sql('value')} AS s FROM vc WHERE value IS NOT NULL GROUP BY tbl, col",
    "ssig": f"SELECT tbl, col, {portable.minhash_sql('simhash')} AS s FROM sh WHERE simhash IS NOT NULL GROUP BY tbl, col",
    "vj": _pairs("vsig"),
    "sj": _pairs("ssig"),
    "labels": f"SELECT tbl, col, {LABEL} AS semantic_type FROM cols",
    "vecs": f"SELECT tbl, col, semantic_type, {portable.gram_counts_sql('semantic_type')} AS v FROM labels",
    "ts": "SELECT a.tbl AS tbl1, a.col AS col1, b.tbl AS tbl2, b.col AS col2, list_cosine_similarity(a.v, b.v) AS type_similarity FROM vecs a JOIN vecs b ON a.tbl < b.tbl",
    "one_way": """SELECT *, row_number() OVER (PARTITION BY tbl1, tbl2 ORDER BY quality DESC, ord1, ord2) AS nth FROM (
SELECT tbl1, col1, tbl2, col2, c1.col_ord AS ord1, c2.col_ord AS ord2, d1.diversity * d2.diversity AS diversity, type_similarity,
 CASE WHEN f1.is_numeric AND f2.is_numeric THEN vj.jaccard WHEN NOT f1.is_numeric AND NOT f2.is_numeric THEN sj.jaccard END AS quality,
 CASE WHEN f1.is_numeric THEN 'natural' ELSE 'semantichash' END AS edge_type
FROM ts JOIN vj USING (tbl1, col1, tbl2, col2) JOIN sj USING (tbl1, col1, tbl2, col2)
JOIN cols c1 ON c1.tbl = tbl1 AND c1.col = col1 JOIN cols c2 ON c2.tbl = tbl2 AND c2.col = col2
JOIN flags f1 ON f1.tbl = tbl1 AND f1.col = col1 JOIN flags f2 ON f2.tbl = tbl2 AND f2.col = col2
JOIN diversity d1 ON d1.tbl = tbl1 AND d1.col = col1 JOIN diversity d2 ON d2.tbl = tbl2 AND d2.col = col2
WHERE type_similarity >= 0.9) WHERE quality >= 0.5""",
    "edges": """SELECT tbl1 AS src, tbl2 AS dst, col1 AS src_col, col2 AS dst_col, quality, edge_type, diversity, type_similarity, nth FROM one_way
UNION ALL SELECT tbl2, tbl1, col2, col1, quality, edge_type, diversity, type_similarity, nth FROM one_way""",
    "links": "SELECT DISTINCT src, dst FROM edges",
    "walk": """SELECT [src, dst] AS path FROM links UNION ALL SELECT list_append(path, dst) FROM walk JOIN links ON path[-1] = src
WHERE len(path) < 5 AND NOT list_contains(path, dst)""",
    "paths": "SELECT path FROM walk WHERE path[1] < path[-1]",
    "steps": "SELECT path, unnest(range(1, len(path))) AS hop FROM paths",
    "orders": """SELECT path, string_agg(concat_ws(':', path[hop], src_col, path[hop + 1], dst_col, edge_type), '>' ORDER BY hop) AS join_order
FROM steps JOIN edges ON src = path[hop] AND dst = path[hop + 1] AND nth = 1 GROUP BY path""",
}
_NEEDS = {
    "top10": ["vc"], "flags": ["cols", "top10"], "grams": ["vc"], "sh": ["grams"], "species": ["sh"], "diversity": ["species"], "vsig": ["vc"], "ssig": ["sh"], "vj": ["vsig"], "sj": ["ssig"],
    "labels": ["cols"], "vecs": ["labels"], "ts": ["vecs"], "one_way": ["ts", "vj", "sj", "cols", "flags", "diversity"], "edges": ["one_way"], "links": ["edges"], "walk": ["links"], "paths": ["walk"],
    "steps": ["paths"], "orders": ["steps", "edges"],
}


def with_sql(select: str, *relations: str) -> str:
    """A query over named relations, with all that they need."""
    want: set[str] = set()

    def add(name: str) -> None:
        if name not in want:
            want.add(name)
            for n in _NEEDS.get(name, ()):
                add(n)

    for r in relations:
        add(r)
    ctes = ", ".join(f"{name}{'(path)' if name == 'walk' else ''} AS {'MATERIALIZED ' if name in ('sh', 'vc', 'edges', 'grams') else ''}({sql})" for name, sql in RELATIONS.items() if name in want)
    return f"WITH RECURSIVE {ctes} {select}"
