import math

import pytest
from pyspark.sql import functions as F

from joinscout.functions import portable, vectors
from joinscout.operators import lists, metrics, profile, similarity, sketch
from joinscout.operators.labels import fuzzy_best, header_label, repaired
from joinscout.sources import lake as lakes
from joinscout.sources.lake import Lake


def species(spark, counts):
    return spark.createDataFrame([("t", "c", str(i), n) for i, n in enumerate(counts)], "tbl string, col string, simhash string, n long")


@pytest.mark.parametrize(("counts", "simpson", "even"), [([2, 2], 2 / 3, 1), ([1, 1, 1, 1], 1, 1), ([10] * 4, 10 / 13, 1), ([10] * 5, 40 / 49, 1), ([1], 0, 0), ([1, 1, 1, 10], 11 / 26, None)])
def test_diversity_worked_examples(spark, counts, simpson, even):
    s = species(spark, counts)
    assert profile.simpson(s).first()["diversity"] == pytest.approx(simpson)
    got = profile.evenness(s).first()["evenness"]
    assert got == pytest.approx(even) if even is not None else got < 1


def test_entropy(spark):
    s = species(spark, [1, 1, 2])
    assert profile.entropy(s).first()["entropy"] == pytest.approx(1.5)
    one = spark.createDataFrame([(["a", "b", "b", "b"],), ([],)], "x array<string>")
    assert [r[0] for r in one.select(profile.entropy_of_list(F.col("x"))).collect()] == [pytest.approx(0.25 * 2 + 0.75 * -math.log2(0.75)), 0.0]


def test_numeric_flag_is_strict_and_empty_is_text(spark):
    frames = {"t": spark.createDataFrame([("Ab12", "G01AX05", None), ("Cd34", "2020-01-01", None)], "half string, code string, empty string")}
    lake = Lake.of(spark, frames)
    flags = {r["col"]: r["is_numeric"] for r in profile.numeric_flags(lake.value_counts(), lake.catalog()).collect()}
    assert flags == {"half": False, "code": True, "empty": False}


def test_null_is_a_species_but_no_sketch_value(spark):
    lake = Lake.of(spark, {"t": spark.createDataFrame([("a",), (None,), (None,)], "c string")})
    counts = lake.value_counts()
    assert profile.simpson(profile.simhash_counts(counts)).first()["diversity"] == pytest.approx(1 - 2 / 6)
    with_null = sketch.signatures(counts, "value").first()["signature"]
    without = sketch.signatures(counts.where("value IS NOT NULL"), "value").first()["signature"]
    assert with_null == without


def test_minhash_estimates_jaccard(spark):
    a, b = range(0, 400), range(200, 600)
    lake = Lake.of(spark, {"a": spark.createDataFrame([(str(x),) for x in a], "x string"), "b": spark.createDataFrame([(str(x),) for x in b], "y string")})
    counts = lake.value_counts()
    true = len(set(a) & set(b)) / len(set(a) | set(b))
    got = sketch.estimated_jaccard(sketch.signatures(counts, "value"), lake.catalog()).first()["jaccard"]
    assert abs(got - true) <= 3 * math.sqrt(true * (1 - true) / portable.PERMUTATIONS)
    exact = similarity.jaccard(similarity.overlaps(counts, lake.catalog(), "value")).first()
    assert exact["jaccard"] == pytest.approx(true) and exact["n_both"] == 200


def test_simhash_of_equal_strings_and_nulls(spark):
    rows = spark.createDataFrame([("Abc",), ("abc",), (None,), ("",), ("日本語",)], "v string").select(portable.simhash(F.col("v"))).collect()
    assert rows[0] == rows[1] and rows[2][0] is None and all(len(rows[i][0]) == portable.BITS for i in (0, 3, 4))


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = d.select(vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z")), vectors.euclid(F.col("a"), F.col("b")), vectors.normalized_euclid_similarity(F.col("a"), F.col("a")), vectors.sign_hash(F.col("a"), 2)).first()
    assert list(r) == [pytest.approx(0.96), 0.0, pytest.approx(math.sqrt(2)), pytest.approx(1.0), "11"]
    sets = spark.createDataFrame([([], []), (["a", "b", None], ["b", "c"])], "x array<string>, y array<string>").select(vectors.jaccard_of_arrays(F.col("x"), F.col("y"))).collect()
    assert [x[0] for x in sets] == [1.0, pytest.approx(1 / 3)]
    assert spark.createDataFrame([(["a", "b"],)], "x array<string>").select(vectors.content_hash(F.col("x"))).first()[0] == __import__("hashlib").md5(b'["a", "b"]').hexdigest()
    assert spark.createDataFrame([('so: [{"id": "a"}] done',), ("none",)], "x string").select(vectors.json_list(F.col("x"), "array<struct<id:string>>")).collect()[0][0][0]["id"] == "a"


def test_containment_of_empty_is_zero(spark):
    lake = Lake.of(spark, {"a": spark.createDataFrame([(None,)], "x string"), "b": spark.createDataFrame([("1",)], "y string")})
    r = similarity.containment(similarity.overlaps(lake.value_counts(), lake.catalog(), "value")).first()
    assert (r["in1"], r["in2"], r["joinability"]) == (0, 0, 0)


def test_count_min_never_underestimates(spark):
    first = spark.createDataFrame([(str(i), i % 7 + 1) for i in range(50)], "key string, n long")
    hop = spark.createDataFrame([(str(i), str(i % 9), 2) for i in range(50)], "kin string, kout string, n long")
    last = spark.createDataFrame([(str(i), 3) for i in range(9)], "key string, n long")
    exact = sum((i % 7 + 1) * 2 * 3 for i in range(50))
    assert sketch.count_min_cardinality(first, [hop], last).first()["cardinality"] >= exact
    assert sketch.count_min_cardinality(first, [hop], last, width=16).first()["cardinality"] >= exact


def test_labels_and_fuzzy(spark):
    got = [r[0] for r in spark.createDataFrame([("c_nationKey",), ("plain_name",)], "c string").select(header_label(F.col("c"))).collect()]
    assert got == ["nation key", "plain name"]
    assert fuzzy_best("custkey", ["orderkey", "cust_key"]) == "cust_key" and fuzzy_best("abc", ["xyz"]) is None
    assert repaired(["custkey", "qqq"], {"cust_key": "customer"}) == {"custkey": "customer", "qqq": None}


def test_combinations_agree_with_heap(spark):
    a = [spark.createDataFrame([(f"{k}{i}", i) for i in range(n)], "item string, r int") for k, n in (("a", 3), ("b", 2), ("c", 2))]
    got = [(r["r1"], r["r2"], r["r3"]) for r in lists.ranked_combinations(a).collect()]
    assert got == list(lists.lazy_combinations([3, 2, 2]))
    assert list(lists.lazy_combinations([2, 0])) == []


def test_list_algebra(spark):
    d = spark.createDataFrame([([1, 2, 3, 4], [False, True, False, True], [9], {"a": 1, "b": 3, "c": 3})], "x array<int>, m array<boolean>, y array<int>, h map<string,int>")
    r = d.select(lists.between_marks(F.col("x"), F.col("m")), lists.interleave(F.col("x"), F.col("y")), lists.positions(F.col("x"), F.lit(3)), lists.top_of_map(F.col("h"), 2)).first()
    assert r[0] == [2, 3, 4] and r[1] == [1, 9, 2, 3, 4] and r[2] == [2] and [tuple(x) for x in r[3]] == [("b", 3), ("c", 3)]
    rows = spark.range(1000)
    assert lists.sampled(rows, "id", count=10).count() == 10 and lists.sampled(rows, "id", count=10).collect() == lists.sampled(rows, "id", count=10).collect()
    assert 50 < lists.sampled(rows, "id", fraction=0.1).count() < 150


def test_set_metrics(spark):
    t, f = spark.createDataFrame([("a",), ("b",)], "i string"), spark.createDataFrame([("b",), ("c",), ("b",)], "i string")
    r = metrics.set_metrics(t, f, "i").first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"]) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert metrics.set_metrics(t.limit(0), f.limit(0), "i").first()["f1"] == 0.0
    runs = spark.createDataFrame([("q", 0, 2, 5), ("q", 1, 5, 5), ("p", 0, 1, 5)], "query_id string, path_nth int, rows_found int, rows_asked int")
    assert metrics.precision_at_k(runs).first()["precision"] == 0.5


def test_csv_lake(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a,b:c,empty\n1,NaN,\n2,"q ""z""",\n3,y,,extra\n4\n')
    f = lakes.read_csv(spark, str(p))
    assert f.columns == ["a", "b__c", "empty"]
    assert [tuple(r) for r in f.orderBy("a").collect()] == [("1", None, None), ("2", 'q "z"', None), ("4", None, None)]
    lake = Lake.from_csv(spark, {"x": str(p)})
    assert lake.columns_of("x") == ["a", "b__c"]
    lakes.write_csv(f, str(tmp_path / "out"))
    assert lakes.read_csv(spark, str(tmp_path / "out")).count() == 3


def test_cleaning(spark, tmp_path):
    assert lakes.clean_header(' a/b"c ') == "a__b__c"
    names = lakes.short_names(["x" * 60, "x" * 50 + "y", "short"])
    assert len(set(names.values())) == 3 and names["short"] == "short" and all(len(v) <= 53 for v in names.values())
    d = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a", "b", "a")
    kept = lakes.keep_last_columns(d)
    assert kept.columns == ["b", "a"] and tuple(kept.first()) == (2, 3)
    assert lakes.cap_rows(spark.range(100), 7).collect() == lakes.cap_rows(spark.range(100), 7).collect()
    (tmp_path / "bad.txt").write_bytes(b"ok\xff!\nnext")
    assert [r["line"] for r in lakes.repair_utf8(spark, str(tmp_path / "bad.txt")).collect()] == ["ok!", "next"]
    grid = {"columns": ["a", "b"], "data": {"1": ["x", None], "0": [1, 2]}}
    back = lakes.to_grid(lakes.from_grid(spark, grid)).collect()
    assert [r["row"] for r in back] == ['{"a":"1","b":"2"}', '{"a":"x","b":"nan"}']


def test_simhash_of_any_characters_matches_a_plain_count(spark):
    import hashlib

    texts = ["", "^", "Customer#000000001", "ÄÖÜ ß", "日本語のテキスト", "\U0001f600\U0001f601", "a" * 3000, "é" * 3000, None]

    def by_hand(text):
        padded = f"^^{text.lower()}$$"
        found = [int(hashlib.md5(padded[i : i + 3].encode()).hexdigest()[:7], 16) % portable.BUCKETS for i in range(len(padded) - 2)]
        return "".join("1" if sum(row[b] for b in found) > 0 else "0" for row in portable.signs()), [float(found.count(b)) for b in range(portable.BUCKETS)]

    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", portable.simhash(F.col("v")), portable.gram_counts(F.col("v"))).collect()
    for v, bits, vector in rows:
        assert (bits, vector) == (by_hand(v) if v is not None else (None, None))


def test_typed_columns_count_as_their_texts(spark):
    """Numbers and times are counted before they are texts; those that differ as numbers only, or as texts only, come right."""
    typed = spark.sql("""SELECT * FROM VALUES (0.0D, 1.001D, 1, TIMESTAMP'2024-01-01 10:00:00'), (-0.0D, 1.002D, 1, TIMESTAMP'2024-01-01 11:00:00'),
    (double('NaN'), 2D, 2, NULL), (NULL, NULL, NULL, TIMESTAMP'2024-01-02 10:00:00') AS t(d, a, i, ts)""")
    texts = {"a": "CAST(CAST(a AS DECIMAL(18, 2)) AS STRING)", "ts": "date_format(ts, 'yyyy-MM-dd')"}
    lake = Lake.of(spark, {"t": typed}, texts=texts)
    got = {(r.col, r.value): r.n for r in lake.value_counts().collect()}
    assert got == {(r.col, r.value): r.n for r in lake.cells().groupBy("col", "value").agg(F.count("*").alias("n")).collect()}
    assert got["d", "0.0"] == got["d", "-0.0"] == 1 and got["a", "1.00"] == 2 and got["ts", "2024-01-01"] == 2
