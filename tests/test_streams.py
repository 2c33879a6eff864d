"""Sessions, joins of streams, throttled progress, and writers that write once."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from docweave.operators import records
from docweave.sinks import exactly_once
from docweave.streaming import sessions as S

DATA = "/root/testdata/sf0.001"
T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def drained(df, spark, name, tmp_path, mode="append", **options):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").options(**options).trigger(availableNow=True).start()
    query.awaitTermination()
    return query, spark.table(name)


def as_stream(spark, df, folder, parts=4):
    """A stream whose files come in order of time, and a last event that moves the watermark past all others."""
    n = df.count()
    ordered = df.orderBy("ts").coalesce(1).withColumn("__i", F.monotonically_increasing_id())
    for p in range(parts):
        ordered.where((F.col("__i") * parts / n).cast("int") == p).drop("__i").write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_sessions(spark):
    rows = [(1, at(0)), (1, at(29)), (1, at(60)), (1, at(61)), (2, at(5)), (None, at(1)), (None, at(2)), (3, None), (1, at(0))]
    got = {(r["user_id"], r["start"], r["stop"], r["n"]) for r in S.sessions(spark.createDataFrame(rows, "user_id long, ts timestamp")).collect()}
    half = datetime.timedelta(minutes=30)
    assert got == {(1, at(0), at(29) + half, 3), (1, at(60), at(61) + half, 2), (2, at(5), at(5) + half, 1), (None, at(1), at(2) + half, 2)}


def test_sessions_of_a_stream_leave_no_state(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "ts")
    end = events.agg(F.max("ts") + F.expr("INTERVAL 2 DAYS")).first()[0]
    marks = spark.createDataFrame([(-1, end + datetime.timedelta(days=d)) for d in (0, 2, 4)], "user_id long, ts timestamp").select("user_id", F.col("ts").cast(dict(events.dtypes)["ts"]).alias("ts"))
    stream = as_stream(spark, events.union(marks), f"{tmp_path}/in", 8)
    query, out = drained(S.sessions(stream, late="10 minutes"), spark, "sessions_out", tmp_path)
    keyed = lambda df: sorted(map(tuple, df.where("user_id >= 0").collect()))
    assert keyed(out) == keyed(S.sessions(events))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2  # the marks alone


def test_followed_on_table_and_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    first, then = events.where("event_type = 'click'"), events.where("event_type = 'purchase'")
    within = "36 HOURS"
    batch = S.followed(first, then, within=within)
    want = {(a["event_id"], b["event_id"]) for a in first.collect() for b in then.collect() if a["user_id"] == b["user_id"] and a["ts"] <= b["ts"] <= a["ts"] + datetime.timedelta(hours=36)}
    pairs = lambda df: sorted((r["first_event_id"], r["then_event_id"]) for r in df.collect())
    assert pairs(batch) == sorted(want) and want
    stream = as_stream(spark, events, f"{tmp_path}/in")
    _, out = drained(S.followed(stream.where("event_type = 'click'"), stream.where("event_type = 'purchase'"), within=within), spark, "followed_out", tmp_path)
    assert pairs(out) == sorted(want)


def test_throttled(spark):
    rows = [("a", 0, "1", False), ("a", 799, "2", False), ("a", 800, "3", None), ("a", 900, "4", True), ("a", 950, "5", False), ("b", 10, "x", False), ("b", 20, "y", False), (None, 1, "z", False), ("b", None, "z", True)]
    rows += [("c", i, f"{i:05d}", i == 9999) for i in range(0, 10000, 7)] + [("c", 9999, "end", True)]
    got = [tuple(r) for r in S.throttled(spark.createDataFrame(rows, "task string, at_ms long, message string, final boolean")).collect()]
    want = [("a", 0, "1", False), ("a", 800, "3", False), ("a", 900, "4", True), ("a", 950, "5", False), ("b", 10, "x", False)]
    assert sorted(g for g in got if g[0] != "c") == want
    times = [g[1] for g in sorted(got) if g[0] == "c"]
    assert times[0] == 0 and times[-1] == 9999 and all(800 <= b - a < 807 for a, b in zip(times[:-2], times[1:-1], strict=True))


def test_throttled_stream(spark, tmp_path):
    rows = [(f"t{i % 3}", 10**6 + i * 130, f"{i:04d}", i in (50, 51)) for i in range(200)]
    df = spark.createDataFrame(rows, "task string, at_ms long, message string, final boolean").withColumn("at", F.timestamp_millis("at_ms")).withColumn("ts", F.col("at"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query, out = drained(S.throttled_stream(as_stream(spark, df, f"{tmp_path}/in"), keep_ms=10**7), spark, "throttled_out", tmp_path)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, S.throttled(df).collect()))
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] > 0
        late = spark.createDataFrame([("t9", 10**9, "later", False)], "task string, at_ms long, message string, final boolean").withColumn("at", F.timestamp_millis("at_ms")).withColumn("ts", F.col("at"))
        query, _ = drained(S.throttled_stream(as_stream(spark, df.union(late), f"{tmp_path}/in2", 12), keep_ms=1000, late="1 second"), spark, "throttled_gone", tmp_path)
        assert {r["task"] for r in spark.table("throttled_gone").collect()} == {"t0", "t1", "t2", "t9"}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_a_batch_counts_once(spark, tmp_path):
    log = exactly_once.AppendLog(spark, f"file://{tmp_path}/log")
    one, two = spark.range(3).toDF("id"), spark.range(10, 12).select("id", F.lit("x").alias("more"))
    with pytest.raises(ValueError):
        log.rows()
    assert log.append(one, 0) and not log.append(one, 0) and log.append(two, 1) and log.append(one.limit(0), 2)
    assert sorted((r["id"], r["more"]) for r in log.rows().collect()) == [(0, None), (1, None), (2, None), (10, "x"), (11, "x")]
    one.write.parquet(f"file://{tmp_path}/log/data/3-crashed")  # rows without an entry
    assert log.rows().count() == 5 and log.append(one, 3) and log.rows().count() == 8 and log.batches() == ["0", "1", "2", "3"]


def test_a_replayed_stream_adds_nothing(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    stream = as_stream(spark, events, f"{tmp_path}/in")
    log = exactly_once.AppendLog(spark, f"file://{tmp_path}/log")
    for checkpoint in ("a", "a", "lost"):  # started, started again, and from nothing
        stream.writeStream.foreachBatch(log.sink(lambda df: df.select("event_id"))).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r[0] for r in log.rows().collect()) == sorted(r[0] for r in events.select("event_id").collect())
    assert len(log.batches()) >= 4


def test_swaps_are_atomic(spark, tmp_path):
    table = exactly_once.VersionedTable(spark, f"file://{tmp_path}/status")
    assert table.version() == 0 and table.swap(spark.createDataFrame([("a", 0)], "task string, n int"), 0) == 1
    with pytest.raises(exactly_once.Taken):
        table.swap(spark.createDataFrame([("lost", 0)], "task string, n int"), 0)
    assert [tuple(r) for r in table.rows().collect()] == [("a", 0)]

    def add(task):
        row = spark.createDataFrame([(task, 1)], "task string, n int")
        table.change(lambda rows: records.latest(row if rows is None else rows.union(row), "task", "n"))

    writers = [threading.Thread(target=add, args=(t,)) for t in ("a", "b", "c")]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(map(tuple, table.rows().collect())) == [("a", 1), ("b", 1), ("c", 1)] and table.version() == 4
    assert table.vacuum(1) == 3 and table.rows().count() == 3
