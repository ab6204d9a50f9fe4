import datetime as dt

from noticeflow.streaming import feeds

T0 = dt.datetime(2026, 1, 1)


def test_days_are_ingested_once(spark, tmp_path):
    src, target, schema = str(tmp_path / "in"), str(tmp_path / "out"), "day string, id int, v string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cut"))

    def run():
        feeds.ingest_days(feeds.parquet_feed(spark, src, schema), target, str(tmp_path / "check"), "day", ["id"]).awaitTermination()
        return sorted((r.day, r.id, r.v) for r in spark.read.schema("id int, v string, day string").parquet(target).collect())

    write([("a", 1, "first"), ("a", 1, "first"), ("b", 1, "x")])  # the id on two days
    assert run() == [("a", 1, "first"), ("b", 1, "x")]
    write([("a", 2, "y"), ("a", 1, "late")])
    assert run() == [("a", 1, "first"), ("a", 2, "y"), ("b", 1, "x")]
    assert run() == [("a", 1, "first"), ("a", 2, "y"), ("b", 1, "x")]


def test_sessions_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(u, T0 + dt.timedelta(minutes=m)) for u in (1, 2) for m in (0, 10, 29, 100, 129, 160)]
    spark.createDataFrame([*rows, (9, T0 + dt.timedelta(days=30))], "user_id int, ts timestamp").coalesce(1).write.parquet(src)
    table = spark.read.parquet(src)
    want = {tuple(r) for r in feeds.activity(table, "user_id", "ts").collect() if r.user_id != 9}
    assert len(want) == 6
    out = feeds.activity(feeds.parquet_feed(spark, src, table.schema), "user_id", "ts", late="1 hour")
    q = out.writeStream.format("memory").queryName("sessions_seen").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("sessions_seen").collect()} == want  # the last user's is still open
