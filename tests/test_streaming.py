from joinscout.operators.sketch import signatures
from joinscout.streaming import sketches


def test_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(str(x), x % 5) for x in range(20 * i, 20 * i + 30)], "a string, b int").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    rows = spark.readStream.schema("a string, b int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = sketches.maintain(rows, "t", ["a", "b"], str(tmp_path / "out"), str(tmp_path / "check"), 16)
    query.awaitTermination()
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name[1:]))
    whole = spark.read.option("recursiveFileLookup", True).schema("a string, b int").parquet(str(tmp_path / "in"))
    want = signatures(sketches.stream_cells(whole, "t", ["a", "b"]), "value", 16)
    assert sorted(map(str, spark.read.parquet(str(last)).collect())) == sorted(map(str, want.collect()))
