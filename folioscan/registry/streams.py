"""Batch forms of the streaming jobs over `events` and `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.registry.answers import RULES as STATE_RULES
from folioscan.registry.answers import STATE, folded
from folioscan.registry.asking import norm_sql
from folioscan.registry.audits import LONG, turn_metrics
from folioscan.registry.common import query, table
from folioscan.registry.turns import messages
from folioscan.streaming import limits, turns


@query(
    "metric_windows",
    f"""WITH {LONG} SELECT date_trunc('hour', e.ts) AS started, metric, count(v) AS count, round(avg(v), 9) AS mean, max(v) AS max,
      list_sort(list(v))[greatest(1, ceil(0.5 * count(v)))::INT] AS p50, list_sort(list(v))[greatest(1, ceil(0.95 * count(v)))::INT] AS p95
    FROM long JOIN events e USING (event_id) WHERE v IS NOT NULL GROUP BY ALL""",
)
def _windows(spark, sf):
    return turns.metric_windows(turn_metrics(spark, sf)).withColumn("mean", F.round("mean", 9))


WINDOW_MS, LIMIT = 6 * 3600 * 1000, 3


def requests(events):
    return events.select(
        F.concat(F.lit("u"), "user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("seq")
    )


@query(
    "rate_limit",
    f"""WITH RECURSIVE r AS (SELECT 'u' || user_id AS key, (epoch_us(ts) // 1000) AS ms, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events),
    w AS (SELECT key, ms, seq, n, ms AS start, 1 AS c, true AS allowed FROM r WHERE n = 1
      UNION ALL SELECT r.key, r.ms, r.seq, r.n, CASE WHEN r.ms - w.start >= {WINDOW_MS} THEN r.ms ELSE w.start END,
        CASE WHEN r.ms - w.start >= {WINDOW_MS} THEN 1 WHEN c >= {LIMIT} THEN c ELSE c + 1 END, r.ms - w.start >= {WINDOW_MS} OR c < {LIMIT}
      FROM w JOIN r ON r.key = w.key AND r.n = w.n + 1)
    SELECT key, ms, seq, allowed FROM w""",
)
def _limit(spark, sf):
    return limits.rate_limit(requests(table(spark, sf, "events")), WINDOW_MS, LIMIT)


@query(
    "idle_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 4 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM e)
    SELECT 'u' || user_id AS key, min(ts) AS started, max(ts) + INTERVAL 4 HOUR AS expires, count(*) AS accesses FROM s GROUP BY user_id, n""",
)
def _sessions(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("key"), "ts")
    return limits.idle_sessions(e, 4 * 3600)


@query("streamed_state", f"WITH {STATE} SELECT conv_id, kind, key, value, turn FROM folded")
def _state(spark, sf):
    return folded(turns.current_state(turns.state_values(messages(spark, sf), ["conv_id"], STATE_RULES), ["conv_id"]))


@query(
    "private_metrics",
    f"""WITH c AS (SELECT conv_id, turn, role, replace(text, 'the', '[REDACTED]') AS t FROM conversations)
    SELECT conv_id, turn, role, CASE WHEN {norm_sql('t')} = '' THEN 'empty' ELSE substring(sha256({norm_sql('t')}), 1, 12) END AS query_hash, length(t) AS characters FROM c""",
)
def _private(spark, sf):
    return turns.private_metrics(messages(spark, sf), ["the"])


def steps(events):
    """A user's day is a turn: views search, clicks read, errors are invalid calls."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "view", "search").when(F.col("event_type").isin("click", "purchase"), "read").otherwise("other")
    ids = F.when(k % 9 > 0, F.array((k % 23).cast("string"), (k % 7).cast("string"))).otherwise(F.array().cast("array<string>"))
    return events.select(
        F.concat_ws("-", (F.col("user_id") % 20).cast("string"), F.date_format("ts", "yyyyMMdd")).alias("turn_id"),
        F.col("event_id").alias("seq"), kind.alias("type"),
        F.when(k % 10 > 0, (k % 17).cast("string")).otherwise("").alias("query"), ids.alias("result_ids"),
    )


_S = "w.stop = ''"
_REFUSED = "CASE WHEN s.q = '' THEN 'empty_query' WHEN list_contains(w.qs, s.q) THEN 'repeated_query' WHEN w.unread >= 2 THEN 'searches_without_read' WHEN w.searches >= 6 THEN 'search_budget' END"
_FRESH = "list_filter(s.ids, lambda x: NOT list_contains(w.rs, x))"
_NEW = "list_filter(list_distinct(s.ids[1:greatest(8 - len(w.ds), 0)]), lambda x: NOT list_contains(w.ds, x))"


@query(
    "tool_loop",
    f"""WITH RECURSIVE st AS (
      SELECT (user_id % 20) || '-' || strftime(ts, '%Y%m%d') AS turn_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'read' ELSE 'other' END AS type,
        CASE WHEN k % 10 > 0 THEN CAST(k % 17 AS VARCHAR) ELSE '' END AS q, CASE WHEN k % 9 > 0 THEN [CAST(k % 23 AS VARCHAR), CAST(k % 7 AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS ids
      FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k FROM events)),
    s AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY seq) AS n FROM st),
    w AS (SELECT DISTINCT turn_id, CAST(0 AS BIGINT) AS n, '' AS stop, 0 AS searches, 0 AS unread, 0 AS invalid, CAST([] AS VARCHAR[]) AS qs, CAST([] AS VARCHAR[]) AS rs, CAST([] AS VARCHAR[]) AS ds FROM s
      UNION ALL
      SELECT turn_id, n, coalesce(CASE type WHEN 'search' THEN coalesce(refused, CASE WHEN len(ids) = 0 THEN 'no_results' WHEN len(fresh) = 0 THEN 'repeated_results' WHEN len(ds) > 0 AND searches + 1 >= 3 THEN 'evidence_saturation' END)
            WHEN 'read' THEN read_stop ELSE CASE WHEN invalid + 1 >= 2 THEN 'invalid_tool_calls' END END, ''),
        CASE WHEN ok_search THEN searches + 1 ELSE searches END, CASE WHEN ok_search THEN unread + 1 WHEN ok_read THEN 0 ELSE unread END,
        CASE WHEN type = 'other' THEN invalid + 1 WHEN ok_search OR ok_read THEN 0 ELSE invalid END,
        CASE WHEN ok_search THEN list_append(qs, q) ELSE qs END, CASE WHEN ok_search THEN list_concat(rs, fresh) ELSE rs END, CASE WHEN ok_read THEN list_concat(ds, fresh_docs) ELSE ds END
      FROM (SELECT *, type = 'search' AND refused IS NULL AS ok_search, type = 'read' AND read_stop IS NULL AS ok_read FROM (
        SELECT s.turn_id, s.n, s.type, s.q, s.ids, w.searches, w.unread, w.invalid, w.qs, w.rs, w.ds, {_REFUSED} AS refused, {_FRESH} AS fresh, {_NEW} AS fresh_docs,
          CASE WHEN len(w.ds) >= 8 THEN 'answer_document_limit' WHEN len({_NEW}) = 0 THEN 'repeated_documents' END AS read_stop
        FROM w JOIN s ON s.turn_id = w.turn_id AND s.n = w.n + 1 WHERE {_S} AND s.n <= 10))),
    l AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY n DESC) AS r FROM w)
    SELECT turn_id, CASE WHEN stop <> '' THEN stop WHEN n >= 10 THEN 'decision_limit' ELSE 'open' END AS stop_reason, n AS decisions, CAST(searches AS BIGINT) AS searches, len(ds) AS documents FROM l WHERE r = 1""",
)
def _loop(spark, sf):
    return turns.tool_loop(steps(table(spark, sf, "events")))
