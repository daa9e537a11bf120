import importlib
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Every query of the library itself; those of the optional subpackage have tests of their own.
CHECKED = sorted(name for module in map(importlib.import_module, entry.REGISTRIES) for name in module.ORACLE_SQL)
#: Queries for which the smallest tables hold nothing.
MAY_BE_EMPTY = {"semantic_semi_join"}

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = rows(entry.queries()[name](spark, SF).toPandas())
    assert got == rows(con.execute(entry.oracle_sql()[name]).df())
    assert got or name in MAY_BE_EMPTY


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["c_mktsegment", "n_name", "r_name", "n"] and found.count() == 5


def test_library_does_not_import_llm():
    code = "import sys, joinscout.plans.registry as r; assert not any(m.startswith('joinscout.llm') for m in sys.modules); assert r.QUERIES"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.fullmatch(r"\w+", k) for k in entry.queries())
