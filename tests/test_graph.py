import itertools

import pytest
from pyspark.sql import functions as F

from joinscout.functions import portable
from joinscout.operators import execute, graph, index, qbe, similarity, workload
from joinscout.sources.lake import Lake

LINKS = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "e")]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(x, y, "k", "k", 0.5 if (x, y) == ("b", "c") else 1.0, "natural", 1) for x, y in LINKS]
    rows += [(y, x, *r[2:]) for (x, y), r in zip(LINKS, rows, strict=True)]
    return spark.createDataFrame(rows, "src string, dst string, src_col string, dst_col string, quality double, edge_type string, nth int")


def by_search(induced=None, longest=5):
    near = {frozenset(x) for x in LINKS}
    out = set()
    for n in range(2, longest + 1):
        for p in itertools.permutations("abcde", n):
            if p[0] < p[-1] and all(frozenset(x) in near for x in itertools.pairwise(p)):
                chord = any(frozenset((p[i], p[j])) in near for i in range(n) for j in range(i + 2, n))
                if not induced or (n == induced and not chord):
                    out.add(p)
    return out


def test_simple_and_induced_paths_match_search(edges):
    assert {tuple(r["path"]) for r in graph.simple_paths(edges).collect()} == by_search()
    assert {tuple(r["path"]) for r in graph.paths_of(edges, 3).collect()} == {p for p in by_search() if len(p) == 3}
    for k in (3, 4):
        assert {tuple(r["path"]) for r in graph.induced_paths(edges, k).collect()} == by_search(k)
    assert graph.shuffled(graph.simple_paths(edges), 1).collect() == graph.shuffled(graph.simple_paths(edges), 1).collect()


def test_weights_neighbours_and_dot(edges):
    w = {(r["src"], r["dst"]): r["weight"] for r in graph.best_edges(edges).collect()}
    assert w["b", "c"] == 1.0 and w["a", "b"] == 0.0
    assert {r["dst"] for r in graph.neighbours(edges, "c").collect()} == {"a", "b", "d"}
    assert graph.dot_text(edges).count() == len(LINKS)


def test_index_and_covering(spark, edges):
    paths = graph.simple_paths(edges)
    need = spark.createDataFrame([(0, ["a", "d", "a"]), (1, ["e"])], "need_id int, tables array<string>")
    got = {(r["need_id"], tuple(r["path"])) for r in index.covering(paths, need).collect()}
    assert got == {(0, p) for p in by_search() if {"a", "d"} <= set(p)} | {(1, p) for p in by_search() if "e" in p}
    from pyspark.sql import Window

    ranked = paths.withColumn("nth", F.row_number().over(Window.orderBy(F.size("path"), F.concat_ws(">", "path"))))
    first = {r["need_id"]: r["path"] for r in index.first_covering(ranked, need).collect()}
    assert first == {0: ["a", "c", "d"], 1: ["d", "e"]}
    cols = spark.createDataFrame([("a", "k"), ("z", "k")], "tbl string, col string")
    assert [r["tbl"] for r in index.tables_without_paths(cols, paths).collect()] == ["z"]
    top = graph.rank_paths(paths.withColumn("cardinality", F.lit(1)), ["a", "d"]).first()
    assert top["path"] == ["a", "c", "d"]


@pytest.fixture(scope="module")
def lake(spark):
    frames = {
        "people": spark.createDataFrame([("1", "p1", "7"), ("2", "p2", "7"), ("3", None, "8"), ("4", "p4", None)], "pid string, name string, city string"),
        "cities": spark.createDataFrame([("7", "Oslo", "1"), ("8", "Rome", "2"), ("7", "Oslo b", "1")], "cid string, cname string, country string"),
        "countries": spark.createDataFrame([("1", "Norway"), ("2", "Italy"), ("2", "Italia")], "kid string, kname string"),
    }
    return Lake.of(spark, frames)


ORDER = [
    {"parent": "people", "child": "cities", "parent_column": "city", "child_column": "cid", "join_type": "natural"},
    {"parent": "cities", "child": "countries", "parent_column": "country", "child_column": "kid", "join_type": "natural"},
]


def test_cardinality_equals_real_join(spark, lake):
    for order in (ORDER, ORDER[:1], [h | {"join_type": "semantichash"} for h in ORDER]):
        tables = execute.project(lake, order)
        n = execute.perform_joins(tables, order).count()
        assert int(execute.cardinality(tables, order).first()["cardinality"]) == n > 0
        assert int(execute.path_cardinalities(lake, [{"join_order": order}]).first()["cardinality"]) == n
    assert execute.perform_joins(execute.project(lake, ORDER), ORDER, sample=2).count() == 2


def test_rows_with_a_null_key_are_dropped_before_joins(lake):
    assert execute.project(lake, ORDER)["people"].count() == 3


def test_seen_tables_are_skipped_or_joined_again(lake):
    back = [*ORDER[:1], {"parent": "cities", "child": "people", "parent_column": "cid", "child_column": "city", "join_type": "natural"}]
    tables = execute.project(lake, back)
    once, twice = execute.perform_joins(tables, back), execute.perform_joins(tables, back, self_join=True)
    assert once.count() == 5 and twice.count() == 9 and "Index_people__2" in twice.columns


def test_late_projection_keeps_rows(lake):
    joined = execute.perform_joins(execute.project(lake, ORDER), ORDER)
    full = execute.fetch_columns(lake, joined, [("people", "name"), ("countries", "kname")])
    assert full.count() == joined.count() and {"people_name", "countries_kname"} <= set(full.columns)
    hashed = execute.fetch_columns(lake, joined, [("people", "name")], hashed=True).select("people_name").distinct().collect()
    assert all(r[0] is None or set(r[0]) <= set("01") for r in hashed)


def test_matches_need_equal_hashes_and_skip_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "rid long, value string").withColumn("simhash", portable.simhash(F.col("value")))
    b = spark.createDataFrame([(5, "X"), (6, "x"), (7, None)], "rid long, value string").withColumn("simhash", portable.simhash(F.col("value")))
    got = similarity.simhash_matches(a, b)
    assert {(r["value1"], r["value2"], r["rid1"], r["rid2"]) for r in got.collect()} == {("x", "X", 1, 5), ("x", "x", 1, 6)}
    assert [tuple(r) for r in similarity.without_exact(got).collect()] == [("x", "X", 1, 5)]


def test_gates(spark):
    pair = spark.createDataFrame([("a", "x", "b", "y", 0.5)], "tbl1 string, col1 string, tbl2 string, col2 string, jaccard double")
    types = pair.withColumnRenamed("jaccard", "type_similarity").withColumn("type_similarity", F.lit(0.9))

    def found(num1, num2, **rules):
        p = spark.createDataFrame([("a", "x", 0, 0, num1, 0.5), ("b", "y", 1, 0, num2, 0.5)], "tbl string, col string, tbl_ord int, col_ord int, is_numeric boolean, diversity double")
        return sorted((r["src"], r["edge_type"]) for r in graph.join_edges(pair, pair, types, p, graph.EdgeRules(**rules)).collect())

    assert found(True, True) == [("a", "natural"), ("b", "natural")]
    assert found(False, False) == [("a", "semantichash"), ("b", "semantichash")]
    assert found(True, False) == [] and found(True, True, join_edge_threshold=0.51) == []
    assert found(True, True, semantic_type_similarity_threshold=0.91) == []
    assert found(True, True, diversity_enabled=True, diversity_multiplier_threshold=0.25) != []
    assert found(True, True, diversity_enabled=True, diversity_multiplier_threshold=0.26) == []
    assert found(True, True, natural_join_enabled=False) == []


@pytest.fixture(scope="module")
def known(spark, tmp_path_factory):
    people = [(str(i), f"person {i}", str(i % 6)) for i in range(60)]
    frames = {
        "people": spark.createDataFrame(people, "person_id string, person_name string, city_id string"),
        "cities": spark.createDataFrame([(str(i), f"town {'abcdef'[i]}", str(i % 3)) for i in range(6)], "city_id string, town string, country_id string"),
        "countries": spark.createDataFrame([(str(i), f"land {'xyz'[i]}") for i in range(3)], "country_id string, land string"),
    }
    return qbe.Discovery(Lake.of(spark, frames, rids={"people": "person_id", "cities": "city_id", "countries": "country_id"}), folder=str(tmp_path_factory.mktemp("lake")))


def test_query_by_example_recovers_rows(known):
    query = [{"semantic_type": "person name", "examples": ["person 1", "person 8"]}, {"semantic_type": "land", "examples": ["land y", "land z"]}]
    found = qbe.answers(known, query)
    assert found[-1].rows_found == 2 and found[-1].path in (["cities", "people"], ["countries", "cities", "people"], ["people", "cities", "countries"])
    missing = [{"semantic_type": "person name", "examples": ["nobody"]}]
    assert qbe.answers(known, missing) == []


def test_workload_queries_are_answered(known):
    queries = workload.workload(known, 2, 3, seed=3)
    assert len(queries) == 2
    whole = 0
    for q in queries:
        n = len(q["query"][0]["examples"])
        assert 1 <= n <= 5 and len(q["path"]) >= 2
        whole += any(a.rows_found == n for a in qbe.answers(known, q["query"]))
    assert whole >= 1
    truth = workload.ground_truth_edges(known, 0.8).collect()
    assert ("cities", "country_id", "countries", "country_id") in {tuple(r)[:4] for r in truth}


def test_a_stored_index_is_read_by_another_discovery(known):
    known.build()
    again = qbe.Discovery(known.lake, folder=known.folder)
    paths = {tuple(r.path) for r in known.ranked.select("path").collect()}
    assert paths and {tuple(r.path) for r in again.ranked.select("path").collect()} == paths
    query = [{"semantic_type": "person name", "examples": ["person 1", "person 8"]}, {"semantic_type": "land", "examples": ["land y", "land z"]}]
    assert [a.path for a in qbe.answers(again, query)] == [a.path for a in qbe.answers(known, query)]


def test_combinations_come_by_rank_sum():
    import itertools

    from joinscout.operators import lists

    for sizes in ([], [0, 2], [1], [3, 1, 4], [2, 2, 2, 3]):
        want = sorted(itertools.product(*map(range, sizes)), key=lambda t: (sum(t), t)) if sizes and min(sizes) else []
        assert list(lists.lazy_combinations(sizes)) == want


def test_top_k_finds_copies_of_the_query(spark):
    from joinscout.operators import similarity

    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 0.0])], "id long, v array<double>")
    for measure in ("euclid", "cosine"):
        found = similarity.top_k(rows.where("id = 100").toDF("id1", "v1"), rows.toDF("id2", "v2"), 2, measure, skip_same=True).collect()
        assert [(r.id2, r.nth) for r in sorted(found, key=lambda r: r.nth)] == [(0, 1), (1, 2)]


def test_csv_lakes_keep_their_row_ids(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,x\n2,"y, z"\n3,q,\n4,p,,7\n5\n')
    lake = Lake.from_csv(spark, f"file://{tmp_path}")
    rows = lake.tables["t"].collect()
    assert sorted((r.a, r.b) for r in rows) == [("1", "x"), ("2", "y, z"), ("5", None)]
    assert {(r.a, r["__rid"]) for r in rows} == {(r.a, r["__rid"]) for r in lake.tables["t"].repartition(3).collect()} and len({r["__rid"] for r in rows}) == 3


def test_example_rows_are_found_without_joining(known):
    """A path of more rows than any bound is answered whole, and its example rows are counted as in the join itself."""
    query = [{"semantic_type": "person name", "examples": ["person 1", "person 8"]}, {"semantic_type": "land", "examples": ["land y", "land z"]}]
    for at in qbe.answers(known, query):
        rows = {tuple(r[f"{t}_{c}"] for _, t, c in at.detected) for r in at.table.collect()}
        assert at.rows_found == len({e for e in zip(*(q["examples"] for q in query), strict=True)} & rows) == 2 and at.cardinality == at.table.count()
    wrong = [query[0], query[1] | {"examples": ["land z", "land y"]}]
    assert all(a.rows_found == 0 for a in qbe.answers(known, wrong))


def test_no_join_is_too_large_for_an_answer(spark, monkeypatch):
    rows = [(str(i), "x", str(i)) for i in range(40)]
    frames = {"a": spark.createDataFrame(rows, "a_id string, kind string, name_one string"), "b": spark.createDataFrame(rows, "b_id string, kind string, name_two string")}
    monkeypatch.setattr(qbe, "MOST_ROWS", 100)
    d = qbe.Discovery(Lake.of(spark, frames, rids={"a": "a_id", "b": "b_id"}), rules=graph.EdgeRules(semantic_type_similarity_threshold=0.99))
    order = [{"parent": "a", "child": "b", "parent_column": "kind", "child_column": "kind", "join_type": "natural"}]
    detected = [(0, "a", "name_one"), (1, "b", "name_two")]
    examples = qbe.examples_of(spark, [{"examples": [str(i) for i in range(20)]}, {"examples": [str(i) for i in range(20)]}])
    found = qbe.postings(d.lake, detected, {(t, c): True for _, t, c in detected}, examples)
    answer = qbe.run_path(d, ["a", "b"], order, detected, found)
    assert answer.cardinality == 400 and answer.rows_found == 20


def test_answers_ask_for_the_paths_they_need_only(known, monkeypatch):
    asked = []
    count = execute.cardinality
    monkeypatch.setattr(execute, "path_cardinalities", lambda *_: pytest.fail("all paths were counted"))
    monkeypatch.setattr(execute, "cardinality", lambda tables, order, *more: asked.append(len(order)) or count(tables, order, *more))
    again = qbe.Discovery(known.lake)
    found = qbe.answers(again, [{"semantic_type": "person name", "examples": ["person 1"]}, {"semantic_type": "town", "examples": ["town b"]}])
    assert found and found[-1].rows_found == 1 and max(asked) == 1


def test_blocks_of_vectors_score_like_columns(spark, monkeypatch):
    """Copies tie by id, odd vectors take part, and slices and batches leave no pair out."""
    import random

    from joinscout.functions import vectors

    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(60 + i, rows[i][1]) for i in range(20)] + [(90, [0.0] * 4), (91, None), (92, [1.0, None, 2.0, 3.0]), (93, [1.0, 2.0]), (94, [float("nan")] * 4)]
    every = spark.createDataFrame(rows, "id long, v array<double>")
    a, b = every.where("id % 7 = 0 OR id > 88").toDF("id1", "v1"), every.toDF("id2", "v2")
    monkeypatch.setattr(similarity, "SLICE_BYTES", 4 * 8 * 5)
    monkeypatch.setattr(similarity, "PAIRS", 30)

    def exact(frame):
        return sorted(repr(tuple(r)) for r in frame.collect())

    each = a.join(b, F.col("id1") != F.col("id2"))
    assert exact(similarity.normalized_euclid(a, b, 5)) == exact(each.select("id1", "id2", F.round(vectors.normalized_euclid_similarity(F.col("v1"), F.col("v2")), 5).alias("score")))
    for measure, score, by in (("euclid", vectors.euclid, F.asc), ("cosine", vectors.cosine, F.desc)):
        from pyspark.sql import Window

        nth = F.row_number().over(Window.partitionBy("id1").orderBy(by("score"), "id2"))
        want = each.select("id1", "id2", score(F.col("v1"), F.col("v2")).alias("score")).withColumn("nth", nth).where("nth <= 7")
        assert exact(similarity.top_k(a, b, 7, measure, skip_same=True)) == exact(want)


def test_a_workload_counts_each_path_once(known, monkeypatch):
    asked = []
    count = execute.cardinality
    monkeypatch.setattr(execute, "cardinality", lambda tables, order, *more: asked.append(str(order)) or count(tables, order, *more))
    monkeypatch.setattr(workload.query_from_path, "__defaults__", (0, 1, None))  # every path is too large
    assert workload.workload(known, 2, 2, most_failures=40) == []
    assert len(asked) == len(set(asked)) > 0
