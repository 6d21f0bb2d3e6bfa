"""Rules over streams."""

from emberline.engine import create_engine
from emberline.streaming import incremental


def test_batches_as_one(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(float(i), "x"), (float(i % 2), "x")], "k double, v string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k double, v string").option("maxFilesPerTrigger", 1).parquet(source)
    engine, seen = create_engine(spark, "ev(K, V) \\ ev(K, V) <=> true;", max_rule_firings=None), []
    q = incremental.asserted(engine, stream, "ev", str(tmp_path / "cp"), lambda e, n: seen.append(n))
    q.awaitTermination()
    assert len(seen) == 3 and sorted(r.a0 for r in engine.facts("ev", 2).collect()) == [0.0, 1.0, 2.0]


def test_stateless(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1.0,), (7.0,)], "k double").write.parquet(source)
    stream = spark.readStream.schema("k double").parquet(source)
    engine = create_engine(spark, "big @ ev(K) ==> K > 5 | big(K * 2);")
    out = incremental.stateless(engine, stream, "ev")["big", 1]
    q = out.writeStream.format("memory").queryName("big_out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.a0 for r in spark.sql("select * from big_out").collect()] == [14.0]


def test_restart_knows_all_facts(spark, tmp_path):
    """A new engine over an old checkpoint asserts the earlier batches first, so joins across the restart are complete."""
    source, schema = str(tmp_path / "in"), "k double, v string"
    feed = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
    found = []
    for rows in ([(1.0, "a"), (2.0, "b")], [(1.0, "c")]):
        feed(*rows)
        engine, seen = create_engine(spark, "ev(K, V), ev(K, W) ==> V !== W | both(K);", max_rule_firings=None), []
        incremental.asserted(engine, spark.readStream.schema(schema).parquet(source), "ev", str(tmp_path / "cp"), lambda e, n: seen.append(n)).awaitTermination()
        found.append((len(seen), engine.facts("ev", 2).count(), [r.a0 for r in engine.facts("both", 1).collect()]))
    assert found == [(1, 2, []), (1, 3, [1.0])]
