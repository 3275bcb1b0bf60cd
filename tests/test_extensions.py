"""Extractors, publishing, span sweeps, percentiles, and streams that keep event-time order."""

import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscan.functions.text import match_starts
from folioscan.operators import quantiles, structure
from folioscan.operators.extractors import Extractor, ExtractorRegistry, run_extractors
from folioscan.operators.understanding import detect_other_library
from folioscan.registry.answers import RULES as STATE_RULES
from folioscan.registry.audits import turn_metrics
from folioscan.registry.turns import messages
from folioscan.sources import library
from folioscan.streaming import limits, ordered, turns
from test_streaming import drain, records, stream

SF = "/root/testdata/sf0.001"


# --- extractors --------------------------------------------------------------------------------


def test_a_raising_extractor_fails_its_ledger_only(spark):
    def names(goal, evidence):
        return pd.DataFrame({"kind": "name", "subject": evidence["title"], "label": evidence["label"], "status": "known"})

    def broken(goal, evidence):
        raise ZeroDivisionError

    registry = ExtractorRegistry([Extractor("names", 1, (("a", "s", "1"),), names), Extractor("broken", 1, (("b", "s", "1"),), broken)])
    ledgers = spark.createDataFrame([(1, "a", "s", "1", "g"), (2, "b", "s", "1", "g"), (3, "c", "s", "1", "g"), (4, "a", " s", "1 ", "g"), (5, "a", "s", "1", "g")], "ledger_id long, library_id string, system string, edition string, goal string")
    rows = [(1, "D1", "one", "", "x", "a"), (1, "D2", "two", "", "y", "a"), (2, "D1", "one", "", "x", "b"), (4, "D1", "one", "", "x", "a"), (4, "D1", "again", "", "y", "a")]
    evidence = spark.createDataFrame(rows, "ledger_id long, label string, title string, content string, document_id string, document_library string")
    facts, statuses = run_extractors(ledgers, evidence, registry)
    assert {r.ledger_id: (r.status, r.records) for r in statuses.collect()} == {1: ("matched", 2), 2: ("build_failed", 0), 3: ("unregistered", 0), 4: ("build_failed", 0), 5: ("no_facts", 0)}
    assert sorted((r.ledger_id, r.subject, r.label) for r in facts.collect()) == [(1, "one", "D1"), (1, "two", "D2")]


@pytest.mark.parametrize("bad", [Extractor(" ", 1, (("a", "b", "c"),), None), Extractor("x", 0, (("a", "b", "c"),), None), Extractor("x", 1, (), None), Extractor("x", 1, (("a ", "b", "c"),), None), Extractor("x", 1, (("k", "k", "k"),), None)])
def test_bad_registrations_are_refused(bad):
    registry = ExtractorRegistry([Extractor("held", 1, (("k", "k", "k"),), None)])
    with pytest.raises(ValueError):
        registry.register(bad)


# --- publishing --------------------------------------------------------------------------------

MANIFEST = {"id": "lib", "name": "n", "system": "s", "edition": "e", "aliases": [" x ", "x"]}


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{k}", "lib", t) for k, t in enumerate(texts)], "id string, ruleset_id string, content string")


def test_an_aborted_revision_changes_no_reader(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="spark-")
    library.stage_revision(docs(spark, "one", "two"), MANIFEST, root, "r1", {"libraryId": "lib"})
    library.publish_revision(spark, root, "lib", "r1", "2024-01-01 00:00:00")
    before = sorted(r.content for r in library.published_documents(spark, root).collect())
    with monkeypatch.context() as broken:
        broken.setattr(library.json, "dumps", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            library.stage_revision(docs(spark, "three"), MANIFEST, root, "r2", {"libraryId": "lib"})
    with pytest.raises(ValueError, match="not staged"):
        library.publish_revision(spark, root, "lib", "r2")
    assert sorted(r.content for r in library.published_documents(spark, root).collect()) == before == ["one", "two"]
    library.stage_revision(docs(spark, "three"), MANIFEST, root, "r2", {"libraryId": "lib"})  # replaces what the aborted run left
    assert sorted(r.content for r in library.published_documents(spark, root).collect()) == before
    library.publish_revision(spark, root, "lib", "r2")
    assert [r.content for r in library.published_documents(spark, root).collect()] == ["three"]
    library.publish_revision(spark, root, "lib", "r1")  # back again: one more row
    assert library.published_documents(spark, root).count() == 2
    with pytest.raises(ValueError, match="import report"):
        library.stage_revision(docs(spark, "four"), MANIFEST, root, None, {"libraryId": "other"})


def test_a_vector_build_resumes_and_refuses_another_manifest(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    chunks = spark.createDataFrame([(f"c{k}", "lib") for k in range(6)], "chunk_id string, ruleset_id string")
    vectors = spark.createDataFrame([(f"c{k}", [float(k)]) for k in range(6)], "chunk_id string, embedding array<double>")
    manifest = {"ruleset_id": "lib", "source_digest": "a", "model": "m", "chunk_size": 500, "chunk_overlap": 50}
    assert library.vector_index_status(chunks, path) == {"chunks": 6, "records": 0, "complete": False}
    assert library.upsert_chunk_vectors(chunks, vectors.where("chunk_id < 'c2'"), path, manifest) == 2
    assert library.vector_index_status(chunks, path)["complete"] is False
    with pytest.raises(ValueError, match="another source"):
        library.upsert_chunk_vectors(chunks, vectors, path, manifest | {"chunk_size": 400})
    assert library.upsert_chunk_vectors(chunks, vectors, path, manifest) == 4
    assert library.upsert_chunk_vectors(chunks, vectors, path, manifest) == 0
    assert library.vector_index_status(chunks, path) == {"chunks": 6, "records": 6, "complete": True}


# --- spans, percentiles, patterns ----------------------------------------------------------------


def test_blocks_meet_their_spans_in_one_sweep(spark):
    """A page of 100,000 blocks with nested headings and crossing paragraph spans, against the plain range test in SQL."""
    n = 100_000
    blocks = spark.range(n).select(F.lit("p").alias("doc_id"), F.col("id").cast("int").alias("pos"))
    spans = [("p", 1, s, min(s + 1000, n)) for s in range(0, n, 1000)] + [("p", 2, s, min(s + 90, n)) for s in range(10, n, 100)] + [("p", 7, s, min(s + 250, n)) for s in range(70, n, 250)]
    df = spark.createDataFrame(spans, "doc_id string, lane int, start int, end int")
    held = structure.blocks_in_spans(blocks, df, structure.LANES)
    got = {(r.lane, r.start): (r.n, r.low, r.high) for r in held.groupBy("lane", "start").agg(F.count("*").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high")).collect()}
    assert got == {(lane, s): (e - s, s, e - 1) for _, lane, s, e in spans}
    assert "CartesianProduct" not in held._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in held._jdf.queryExecution().toString()


@pytest.mark.parametrize("fits", [1, 7, 100_000])
def test_percentiles_by_descent(spark, fits):
    rows = [("a", float(k % 97) ** 3) for k in range(3000)] + [("b", 5.0)] * 500 + [("b", 1e18), ("b", -1e18)] + [("c", None)] + [("d", 2.5)]
    got = quantiles.exact_percentiles(spark.createDataFrame(rows, "key string, v double"), ["key"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, fits)
    want = {}
    for key in "abd":
        values = sorted(v for k, v in rows if k == key and v is not None)
        want[key] = tuple(values[max(1, -(-len(values) * p // 100)) - 1] for p in (0, 50, 95, 100))
    assert {r.key: (r.p0, r.p50, r.p95, r.p100) for r in got.collect()} == want


def test_many_matches_and_long_messages(spark):
    text = "ab xx " * 5000
    got = spark.createDataFrame([(text,)], "t string").select(match_starts(F.col("t"), F.lit("ab|xx")).alias("s")).first().s
    assert got == [k for k in range(1, len(text) + 1, 3)]
    catalog = spark.createDataFrame([("l1", 1, "Glass Harbour", "s", ["harbourlight"]), ("l2", 2, "Iron Moor", "s", None)], "id string, ord long, name string, system string, aliases array<string>")
    long = "word " * 3999 + "iron moor at the end"
    msgs = spark.createDataFrame([(1, "l1", long), (2, "l1", "nothing"), (3, None, "at harbourlight, and the Iron Moor"), (4, "l2", "iron moor"), (5, None, None)], "message_id long, current_library string, content string")
    assert {r.message_id: r.library_id for r in detect_other_library(msgs, catalog).collect()} == {1: "l2", 3: "l1"}


# --- streams ------------------------------------------------------------------------------------


def in_batches(spark, frames):
    """A stream of one micro-batch per frame."""
    folder = tempfile.mkdtemp(prefix="spark-")
    for k, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def drain_expiring(df, name, seconds=40):
    """Expiry by processing time keeps a query running batches without data, so it is stopped after a while."""
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).start()
    query.awaitTermination(seconds)
    query.stop()
    return df.sparkSession.table(name)


def test_late_rows_of_earlier_batches_give_the_batch_result(spark):
    rows = [("k", s, n) for n, s in enumerate([0, 30, 5, 8, 3, 60, 41, 44, 90, 200, 95, 99, 400, 300, 1000])] + [("m", s, 100 + s) for s in (2, 1, 0, 50, 49)]
    def frame(part):
        return spark.createDataFrame(part, "key string, s long, seq long").select("key", F.timestamp_seconds(F.col("s") + 100_000).alias("ts"), "seq")

    source = in_batches(spark, [frame(rows[:4] + rows[15:18]), frame(rows[4:9] + rows[18:]), frame(rows[9:13]), frame(rows[13:15]), frame([("end", 5000, 0)]), frame([("end", 9000, 1)])])
    live = drain(ordered.stream_rate_limit_in_order(source, 40_000, 2, "300 seconds"), "ordered")
    batch = limits.rate_limit(frame(rows).select("key", F.unix_millis("ts").alias("ms"), "seq"), 40_000, 2)
    assert sorted(tuple(r) for r in live.where("key <> 'end'").collect()) == sorted(map(tuple, batch.collect()))


def test_ordered_limits_leave_no_state(spark):
    frames = [spark.createDataFrame([(k, s, 1)], "key string, s long, seq long").select("key", F.timestamp_seconds("s").alias("ts"), "seq") for k, s in (("a", 10), ("b", 1000), ("b", 2000), ("b", 3000))]
    df = ordered.stream_rate_limit_in_order(in_batches(spark, frames), 40_000, 2, "1 second")
    folder = tempfile.mkdtemp(prefix="spark-")
    query = df.writeStream.format("noop").option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination(180)
    state = spark.read.format("statestore").option("path", folder).option("stateVarName", "window").load()
    assert {r.key.key for r in state.collect()} <= {"b"}  # the key that went idle is forgotten


def test_conversation_state_stream_equals_the_fold(spark):
    said = messages(spark, SF).where("conv_id < 12")
    parts = [said.where(F.pmod(F.xxhash64("turn", "conv_id"), F.lit(3)) == k) for k in (2, 0, 1)]
    live = drain_expiring(ordered.stream_conversation_state(in_batches(spark, parts), ["conv_id"], STATE_RULES), "snapshots")
    got = ordered.newest_snapshots(live, ["conv_id"]).select("conv_id", "kind", "key", "value", "turn")
    want = turns.current_state(turns.state_values(said, ["conv_id"], STATE_RULES), ["conv_id"]).select("conv_id", "kind", F.coalesce("key", F.lit("")).alias("key"), "value", "turn")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_newer_composition_replaces_the_whole(spark):
    schema = "conv_id long, kind string, key string, turn long, pos long, value string"
    observed = [(1, "class", "a", 5, 0, "3"), (1, "class", "b", 5, 1, "2"), (1, "class", "c", 2, 0, "9"), (1, "fact", "x", 1, 0, "old"), (1, "fact", "x", 4, 0, "new"), (1, "class", "d", 7, 0, "6"), (1, "fact", "x", 3, 0, "late")]
    frames = [spark.createDataFrame(observed[k : k + 2], schema) for k in range(0, 7, 2)]
    stateful = in_batches(spark, frames).groupBy("conv_id").transformWithStateInPandas(
        ordered.ConversationState(["conv_id"], ordered.CONVERSATION_TTL_MS), "conv_id long, " + ordered.SNAPSHOT, "Append", "ProcessingTime"
    )
    got = ordered.newest_snapshots(drain_expiring(stateful, "compositions"), ["conv_id"])
    assert sorted((r.kind, r.key, r.value, r.turn) for r in got.collect()) == [("class", "d", "6", 7), ("fact", "x", "new", 4)]


def test_window_percentiles_of_streams(spark):
    exact = {(r.started, r.metric): r for r in turns.metric_windows(turn_metrics(spark, SF), "1 day").collect()}
    live = drain(turns.metric_windows(records(stream(spark)), "1 day", watermark="1 hour"), "sketched").collect()
    assert live
    values = {}
    for r in live:
        e = exact[r.started, r.metric]
        assert (r["count"], r.max) == (e["count"], e.max)
        assert e.p50 <= e.max and r.p50 <= r.max
        values[r.started, r.metric] = (r.p50, e.p50)
    assert sum(a == b for a, b in values.values()) >= 0.9 * len(values)  # small windows fit the sketch whole
    written = []
    query = turns.settle_windows(records(stream(spark)), lambda: turn_metrics(spark, SF), lambda df: written.extend(df.collect()), "1 day").option(
        "checkpointLocation", tempfile.mkdtemp(prefix="spark-")
    ).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert {(r.started, r.metric, r.p50, r.p95) for r in written} == {(s, m, exact[s, m].p50, exact[s, m].p95) for s, m in values}


def plain_limit(moments, window_ms, most):
    """The rule itself, row by row."""
    start, count, out = None, 0, []
    for ms in moments:
        if start is None or ms - start >= window_ms:
            start, count = ms, 1
            out.append(True)
        else:
            out.append(count < most)
            count += count < most
    return out


@pytest.mark.parametrize("block_windows", [1, 3, 64])
def test_rate_limits_by_block(spark, block_windows):
    import random

    draw = random.Random(block_windows)
    rows = []
    for key, gap in (("dense", 30), ("sparse", 4000), ("mixed", 700), ("ties", 1)):
        at = draw.randrange(10_000)
        for n in range(400):
            at += draw.randrange(gap * 2) if key != "ties" else (n % 5 == 0) * draw.randrange(90)
            rows.append((key, at, n))
    df = spark.createDataFrame(rows, "key string, ms long, seq long").repartition(3)
    got = {(r.key, r.seq): r.allowed for r in limits.rate_limit(df, 1000, 4, block_windows).collect()}
    for key in ("dense", "sparse", "mixed", "ties"):
        mine = [(ms, n) for k, ms, n in rows if k == key]
        assert [got[key, n] for _, n in mine] == plain_limit([ms for ms, _ in mine], 1000, 4)


def test_one_busy_key_is_many_tasks(spark):
    n = 1_000_000
    busy = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * 7).alias("ms"), F.col("id").alias("seq"))
    found = limits.rate_limit(busy, 1000, 50)
    counts = found.groupBy("allowed").count().collect()
    # windows start at 0, 1001, 2002, ...: 143 requests each, 50 allowed
    windows = -(-n // 143)
    assert {r.allowed: r["count"] for r in counts}[True] == (windows - 1) * 50 + min(50, n - (windows - 1) * 143)


def test_rate_limit_takes_many_blocks_at_once(spark):
    """One call of Python per block of a key cost more than the block; only whole sorted blocks count, however batches cut them."""
    rows = [(f"k{n % 7}", n * 37 % 9000, n) for n in range(900)]
    df = spark.createDataFrame(rows, "key string, ms long, seq long").repartition(3)
    want, held = {}, {}
    for key, ms, seq in sorted(rows):
        start, count = held.get(key, (None, 0))
        if start is None or ms - start >= 300:
            start, count = ms, 0
        want[key, seq] = count < 3
        held[key] = (start, count + want[key, seq])
    try:
        for size in ("3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            limited = limits.rate_limit(df, 300, 3, 2)
            assert {(r.key, r.seq): r.allowed for r in limited.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    frame = pd.DataFrame({"key": ["a", "a", "b"], "block": [0, 1, 0], "ms": [0, 10, 5]})
    assert limits._entries(frame, 5, 10)["free"].tolist() == [5, 15, 10]
