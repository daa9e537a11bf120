"""Graphs of blocks (op10) against brute force, and what they shuffle."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from joinscout.llm import blocks, neighbours


def _table(spark, base, kind="float", parts=4):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], f"vec_id long, embedding array<{kind}>").repartition(parts)


def _recall(got, base, k=10):
    exact, hits, n = base.astype(float), 0, 0
    for q, own in got.groupby("query_id"):
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, k + 1)) and q not in set(own.vec_id)
        assert np.allclose(own.score, d[own.vec_id], rtol=1e-12) and list(zip(own.score, own.vec_id, strict=True)) == sorted(zip(own.score, own.vec_id, strict=True))
        d[q] = np.inf
        hits, n = hits + len(set(np.argsort(d)[:k]) & set(own.vec_id)), n + k
    return hits / n


def _shuffled(spark) -> int:
    """Bytes that the application has written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(seen.apply(i).totalShuffleWrite() for i in range(seen.size()))


def test_vectors_are_shuffled_a_few_times_only(spark):
    base = np.random.default_rng(3).normal(size=(3000, 48)).astype(np.float32)
    table = _table(spark, base).cache()
    assert table.count() == 3000
    before = _shuffled(spark)
    got = neighbours.nearest(table, F.col("vec_id") % 100 == 0).toPandas()
    assert _shuffled(spark) - before < 6 * base.nbytes  # a graph joined by Spark shuffles 65 vectors a node in each round
    assert len(got) == 300 and _recall(got, base) >= 0.9


@pytest.mark.parametrize("kind", ["float", "double"])
def test_many_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(blocks, "SPREAD", 8)  # about 7 blocks
    base = np.random.default_rng(4).normal(size=(3000, 32)).astype(np.float32)
    base[1000:1200] = base[100] + np.random.default_rng(5).normal(size=(200, 32)).astype(np.float32) * 1e-3
    base[2000:2300] = base[7]
    base *= np.float32(1e18) if kind == "float" else 1
    got = neighbours.nearest(_table(spark, base, kind), F.col("vec_id") % 100 == 0).toPandas()
    assert got.query_id.nunique() == 30
    assert _recall(got[~got.query_id.between(2000, 2299)], base) >= 0.9
    assert got[got.query_id == 2100].sort_values("rank").vec_id.tolist() == [7, *range(2000, 2009)]


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SPREAD", 4)
    base = np.concatenate((np.eye(300, dtype=np.float32), np.eye(300, dtype=np.float32)[:50]))  # all are equally far, but for 50 copies
    got = neighbours.nearest(_table(spark, base), F.col("vec_id") == 200).toPandas().sort_values("rank")
    assert got.vec_id.tolist() == list(range(10))


def test_far_clusters_are_reached(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SPREAD", 16)
    rng = np.random.default_rng(6)
    base = (rng.normal(size=(20, 16)) * 100)[np.repeat(np.arange(20), 150)] + rng.normal(size=(3000, 16))
    got = neighbours.nearest(_table(spark, base.astype(np.float32)), F.col("vec_id") % 50 == 0).toPandas()
    assert len(got) == 600 and _recall(got, base.astype(np.float32)) >= 0.9


def test_one_graph(spark):
    base = np.random.default_rng(8).normal(size=(600, 12)).astype(np.float32)
    got = neighbours.nearest(_table(spark, base), F.col("vec_id") % 100 == 0, one_graph=True).toPandas()
    assert _recall(got, base) >= 0.9


def test_descent_finds_near_all_lists(monkeypatch):
    monkeypatch.setattr(blocks, "LEAF", 300)
    monkeypatch.setattr(blocks, "HELD", 20_000)
    base = np.random.default_rng(1).normal(size=(2500, 24)).astype(np.float32)
    links = blocks.graph(base, 0.07)
    assert links.shape == (2500, blocks.DEGREE + blocks.LINKS_BACK)
    hits = 0
    for i in range(0, 2500, 50):
        d = ((base - base[i]) ** 2).sum(1)
        d[i] = np.inf
        own = links[i, : blocks.DEGREE]
        assert len(set(own)) == blocks.DEGREE and i not in own
        hits += len(set(np.argsort(d)[: blocks.DEGREE]) & set(own.tolist()))
    assert hits / (50 * blocks.DEGREE) >= 0.9
    for row in range(0, 2500, 100):  # links back are of nodes whose lists hold the node
        assert all(row in links[x, : blocks.DEGREE] for x in links[row, blocks.DEGREE :] if x >= 0)
    assert np.array_equal(links, blocks.graph(base, 0.07))  # a task that is run again gives the same


def test_walks_measure_few_and_a_wide_one_all():
    base = np.random.default_rng(2).normal(size=(4000, 16)).astype(np.float32)
    links = blocks.graph(base, 0.07)
    asked, own = base[:5] + np.float32(0.01), np.array([0, 1, -1, -1, 4])
    (some, few), (every, all_of_them) = blocks.walk(base, links, asked, own, [24, 1000])
    assert (few < 2000).all() and (all_of_them == 4000).all()
    for i in range(5):
        order = np.argsort(((base - asked[i]) ** 2).sum(1), kind="stable")
        assert every[i].tolist() == order[:1000].tolist()
        assert len(set(some[i, :10].tolist()) & set(order[:10].tolist())) >= 9
    (alone, _), = blocks.walk(base[:1], blocks.graph(base[:1], 0.07), asked, np.full(5, -1), [24])
    assert alone.tolist() == [[0]] * 5


def test_first_rows_of_each_vector():
    rows = [(b"a", 5), (b"b", 1), (b"a", 3), (b"a", 5), (b"a", 4), (b"b", 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["vec", "vec_id"])
    none = batch.slice(0, 0)
    got = [tuple(r.values()) for b in neighbours._firsts(2)(iter([batch, none])) for r in b.to_pylist()]
    assert sorted(got) == [(b"a", 3), (b"a", 4), (b"b", 0), (b"b", 1)]
