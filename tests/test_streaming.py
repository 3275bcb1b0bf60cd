import tempfile

from pyspark.sql import functions as F

from folioscan.registry.streams import LIMIT, WINDOW_MS, requests, steps
from folioscan.registry.audits import turn_metrics
from folioscan.streaming import limits, turns

SF = "/root/testdata/sf0.001"


def stream(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)


def drain(df, name, mode="append"):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    return df.sparkSession.table(name)


def test_rate_limit_stream_equals_batch(spark):
    batch = limits.rate_limit(requests(spark.read.parquet(f"{SF}/events.parquet")), WINDOW_MS, LIMIT)
    live = drain(limits.stream_rate_limit(requests(stream(spark)), WINDOW_MS, LIMIT), "limited")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def test_streams_order_a_key_over_all_frames(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    one = requests(events).withColumn("key", F.lit("all"))
    batch = limits.rate_limit(one, WINDOW_MS, LIMIT)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        live = drain(limits.stream_rate_limit(requests(stream(spark)).withColumn("key", F.lit("all")), WINDOW_MS, LIMIT), "framed")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def test_tool_loop_stream_equals_batch(spark):
    batch = turns.tool_loop(steps(spark.read.parquet(f"{SF}/events.parquet"))).where("stop_reason <> 'open'")
    live = drain(turns.stream_tool_loop(steps(stream(spark))), "loops")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def test_sessions(spark):
    rows = [("a", 0, 1, "create"), ("a", 5, 2, "begin"), ("a", 6, 3, "begin"), ("a", 60, 4, "save"), ("a", 61, 5, "end"), ("a", 90, 6, "touch"), ("b", 1, 7, "touch")]
    folder = tempfile.mkdtemp(prefix="spark-")
    df = spark.createDataFrame(rows, "key string, s int, seq bigint, kind string").select("key", F.timestamp_seconds(F.col("s") + 1000).alias("ts"), "seq", "kind")
    df.coalesce(1).write.mode("overwrite").parquet(folder)
    live = limits.stream_sessions(spark.readStream.schema(df.schema).parquet(folder), 20_000)
    rows_out = drain(live, "sessions").collect()
    got = {r.seq: (r.outcome, r.version) for r in rows_out}
    assert got == {1: ("ok", 0), 2: ("ok", 0), 3: ("busy", 0), 4: ("ok", 1), 5: ("ok", 1), 6: ("not_found", None), 7: ("not_found", None)}


def test_metric_windows_stream(spark):

    live = turns.metric_windows(records(stream(spark)), "1 day", watermark="1 hour")
    batch = turns.metric_windows(turn_metrics(spark, SF), "1 day").select("started", "metric", "count")
    got = drain(live, "windows").select("started", "metric", "count")
    late = batch.agg(F.max("started")).first()[0]
    closed = batch.where(F.col("started") < F.lit(late))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.collect()))


def records(events):
    return events.select(
        F.struct(F.col("value").alias("total"), (F.col("value") / 10).alias("routing"), F.when(F.col("event_type") != "error", F.col("value") / 2).alias("retrieval")).alias("phases_seconds"),
        F.create_map(F.lit("historyTokens"), (F.get_json_object("props", "$.k").cast("bigint") * 10).cast("string"),
                     F.lit("plannerTaskCount"), F.when(F.get_json_object("props", "$.k").cast("bigint") > 70, (F.get_json_object("props", "$.k").cast("bigint") % 6).cast("string")).otherwise("none")).alias("context"),
        F.struct((F.get_json_object("props", "$.k").cast("bigint") * 7).alias("promptTokens")).alias("usage"),
        (F.get_json_object("props", "$.k").cast("bigint") % 4).cast("int").alias("search_count"),
        F.when(F.col("event_type") == "error", (F.get_json_object("props", "$.k").cast("bigint") % 2).cast("int")).alias("dropped_messages"),
        "ts",
    )
