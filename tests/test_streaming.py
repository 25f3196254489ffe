import time

from pyspark.sql import functions as F

from loomgrid.streaming import events as E


def run(stream, name, path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/c-{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    time.sleep(0.1)


def events(spark, path):
    rows = [(i % 40, f"2024-01-{1 + i % 20:02d} 10:{i % 40:02d}:00", i % 4, "abc"[i % 3]) for i in range(80)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, status string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    df.repartition(3).write.parquet(f"{path}/in")
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_events_once(spark, tmp_path):
    df, stream = events(spark, str(tmp_path))
    run(E.once(stream, late="60 days"), "once", str(tmp_path))
    assert spark.table("once").count() == 40 == E.once(df).count()


def test_quota_stream_counts_allowed_uses_only(spark, tmp_path):
    df, stream = events(spark, str(tmp_path))
    one = stream.dropDuplicates(["event_id"])
    run(E.quota_stream(one, "user_id", "ts", "event_id", 2, 24 * 365), "quota", str(tmp_path))
    got = spark.table("quota").groupBy("user_id").agg(F.count_if("allowed").alias("n"), F.count("*").alias("all")).collect()
    assert all(r.n == 2 and r.all == 10 for r in got) and len(got) == 4


def test_history_stream_ignores_old_and_repeated_snapshots(spark, tmp_path):
    df, stream = events(spark, str(tmp_path))
    run(E.history_stream(stream, "user_id", "ts", ["status"]), "history", str(tmp_path))
    got = spark.table("history").collect()
    last = {}
    for r in sorted(got, key=lambda r: (r.user_id, r.ts)):
        assert r.before == last.get(r.user_id)
        assert r.after != r.before
        last[r.user_id] = r.after
    assert set(last) == {0, 1, 2, 3}


def test_notices_are_sent_once_in_order(spark):
    rows = [("a", "2024-01-01", None, False, []), ("b", "2024-01-09", None, False, ["failed"]), ("c", "2024-01-05", None, True, []), ("d", "2024-01-01", "2024-01-05", False, ["failed"]), ("e", "2024-01-01", "2024-01-05", False, []), ("f", "2024-01-06", None, None, ["failed"]), ("g", "2024-02-01", None, False, None)]
    df = spark.createDataFrame(rows, "account string, failed_at string, recovered_at string, cancelling boolean, sent array<string>")
    got = {r.account: r.slot for r in E.notices(df, "2024-01-10 00:00:00").collect()}
    assert got == {"a": "last", "d": "recovered", "f": "reminder"}


def test_quota_gives_back_and_forgets(spark, tmp_path):
    def step(rows, n):
        spark.createDataFrame(rows, "user_id long, event_id long, t string, undo boolean").withColumn("ts", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    step([(1, 1, "2024-01-01 10:00:00", False), (1, 2, "2024-01-01 10:05:00", False), (1, 3, "2024-01-01 10:06:00", False), (1, 2, "2024-01-01 10:07:00", True), (1, 4, "2024-01-01 10:08:00", False), (2, 9, "2024-01-01 10:00:00", False)], "a")
    step([(1, 5, "2024-01-01 10:30:00", False), (3, 1, "2024-01-20 00:00:00", False)], "b")
    step([(1, 6, "2024-01-20 00:00:00", False), (3, 2, "2024-01-20 00:10:00", False)], "c")
    stream = spark.readStream.schema("user_id long, event_id long, undo boolean, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run(E.quota_stream(stream, "user_id", "ts", "event_id", 2, 1, back="undo", late="1 hour"), "returned", str(tmp_path))
    got = {(r.user_id, r.event_id, r.ts.hour, r.ts.minute): r.allowed for r in spark.table("returned").collect()}
    assert got == {(1, 1, 10, 0): True, (1, 2, 10, 5): True, (1, 3, 10, 6): False, (1, 2, 10, 7): None, (1, 4, 10, 8): True, (2, 9, 10, 0): True, (1, 5, 10, 30): False, (3, 1, 0, 0): True, (1, 6, 0, 0): True, (3, 2, 0, 10): True}


def test_history_forgets_keys_that_nothing_comes_from(spark, tmp_path):
    for n, rows in enumerate(([(1, "2024-01-01", "a"), (2, "2024-01-01", "x")], [(2, "2024-03-01", "x")], [(2, "2024-03-02", "y")], [(1, "2024-03-03", "b")])):
        spark.createDataFrame(rows, "user_id long, t string, status string").withColumn("ts", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        time.sleep(0.02)
    stream = spark.readStream.schema("user_id long, status string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run(E.history_stream(stream, "user_id", "ts", ["status"], keep_days=20), "forgotten", str(tmp_path))
    got = sorted((r.user_id, str(r.ts.date()), r.before, r.after) for r in spark.table("forgotten").collect())
    assert got == [(1, "2024-01-01", None, "a"), (1, "2024-03-03", None, "b"), (2, "2024-01-01", None, "x"), (2, "2024-03-02", "x", "y")]
