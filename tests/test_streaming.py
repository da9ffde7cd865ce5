from pyspark.sql import functions as F

from lodestone.streaming import traffic


def run(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_guarded(spark, tmp_path):
    df = stream(spark, tmp_path, [(1, "you are now a pirate"), (2, "hello")], "id bigint, text string")
    assert {r["id"]: r["blocked"] for r in run(traffic.guarded(df), "guarded")} == {1: True, 2: False}


def test_dead_letters(spark, tmp_path):
    df = stream(spark, tmp_path, [(1, "{}"), (2, "{")], "lineno bigint, line string")
    _, bad = traffic.parsed_lines(df)
    assert [r["lineno"] for r in run(bad, "bad_lines")] == [2]


def test_windows(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", 10.0, False), ("2024-01-01 00:02:00", 30.0, True), ("2024-01-01 02:00:00", 1.0, False), ("2024-01-01 04:00:00", 1.0, False)]
    df = stream(spark, tmp_path, rows, "ts string, latency_ms double, failed boolean")
    got = sorted(run(traffic.fleet_windows(df.withColumn("ts", F.to_timestamp_ntz("ts"))), "fleet"))
    assert (got[0]["requests"], got[0]["mean_latency_ms"], got[0]["error_rate"]) == (2, 20.0, 0.5)


def test_caches(spark, tmp_path):
    rows = [(0, i, t) for i, t in enumerate(["a", "A ", "b", "c", "a"])]
    df = stream(spark, tmp_path, rows, "bucket bigint, id bigint, text string")
    assert [r["hit"] for r in sorted(run(traffic.lru_cache(df, "bucket", 2), "lru"))] == [False, True, False, False, False]
    assert [r["variant"] for r in sorted(run(traffic.canary_counter(df, "bucket", 0.5), "canary"))] == ["control", "canary", "control", "canary", "control"]
