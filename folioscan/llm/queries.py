"""The corpus operators over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.bpe import decode_documents, encode_documents
from folioscan.llm.common import table
from folioscan.llm.embeddings import near_vectors
from folioscan.llm.fill_middle import fim_digests
from folioscan.llm.filter_audit import filter_audit
from folioscan.llm.language_model import score_documents as score_language
from folioscan.llm.packing import pack_online
from folioscan.llm.pii import replace_personal_data
from folioscan.llm.quality import fit_quality, score_documents
from folioscan.llm.secrets import ACCESS, ALLOWED_BEFORE, ALLOWED_PLAIN, ALLOWED_RUNS, ASSIGN, ASSIGN_VALUE, CLASSES, HEX, find_secrets, listed_spans
from folioscan.llm.simhash import simhash_groups
from folioscan.llm.syncmers import compare_edited
from folioscan.llm.token_output import packed_rows
from folioscan.llm.va_file import top_k_exact

#: The key of the surrogates is a secret of whoever runs the job; this one is for the driver's invented tables.
PII_KEY = b"folioscan example key"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


ORACLES["op1_near_vectors"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.a = lowest.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM lowest
"""


@query
def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_personal_data(docs, PII_KEY)


@query
def op3_packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(table(spark, sf_dir, "documents"))


@query
def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_documents(encode_documents(table(spark, sf_dir, "documents"))).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "n_entropy",
        F.sha2(listed_spans(F.col("base_spans")), 256).alias("base_sha256"),
        listed_spans(F.col("all_spans")).alias("spans"),
    )


@query
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language(table(spark, sf_dir, "documents"))


def _secrets_sql() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    forms = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), *((c.kind, c.run) for c in CLASSES)]
    hits = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS number, '{kind}' AS kind, regexp_extract_all(body, {quoted(form)}) AS hits, string_split_regex(body, {quoted(form)}) AS gaps FROM docs"
        for n, (kind, form) in enumerate(forms)
    )
    hot = " UNION ALL ".join(
        f"""SELECT doc_id, number, kind, start + list_min(places) AS start, start + list_max(places) + {c.window} AS stop FROM (
          SELECT *, list_filter(range(length(hit) - {c.window - 1}), lambda i: list_aggregate(string_split(substring(hit, i + 1, {c.window}), ''), 'entropy') >= {c.bits - 1e-9}) AS places
          FROM placed WHERE kind = '{c.kind}' AND regexp_matches(hit, {quoted(c.needs)}) {f"AND NOT regexp_matches(hit, {quoted(c.never)})" if c.never else ""}
            AND NOT regexp_matches(hit, {quoted(ALLOWED_PLAIN)}) AND NOT regexp_matches(hit, {quoted(ALLOWED_RUNS)}) AND NOT regexp_matches(before, {quoted(ALLOWED_BEFORE)})
        ) WHERE len(places) > 0"""
        for c in CLASSES
    )
    listed = lambda rows: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) {rows}, '')"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
found AS ({hits}),
each AS (SELECT doc_id, number, kind, hits, gaps, unnest(generate_series(1, len(hits))) AS k FROM found WHERE len(hits) > 0),
placed AS (
  SELECT doc_id, number, kind, hits[k] AS hit, right(gaps[k], 24) AS before,
    list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS start
  FROM each
),
spans AS (
  SELECT doc_id, number, kind, start::BIGINT AS start, (start + length(hit))::BIGINT AS stop FROM placed
  WHERE kind IN ('access', 'hex') OR kind = 'assign' AND length(regexp_extract(hit, {quoted("^(?:" + ASSIGN + ")$")}, 2)) >= {ASSIGN_VALUE}
  UNION ALL SELECT doc_id, number, kind, start::BIGINT, stop::BIGINT FROM ({hot})
)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  count(*) FILTER (number > 2) AS n_entropy, sha256({listed("FILTER (number <= 2)")}) AS base_sha256, {listed("")} AS spans
FROM docs d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""


ORACLES["op5_secrets"] = _secrets_sql()


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_online(table(spark, sf_dir, "documents"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


@query
def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


@query
def op10_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(table(spark, sf_dir, "documents"))


ORACLES["op11_fill_in_middle"] = """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2,
    CASE WHEN n = 0 OR regexp_matches(body, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
),
cut AS (
  SELECT *, least(c1, c2) AS low, greatest(c1, c2) AS high,
    left(body, least(c1, c2)) AS prefix, substr(body, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS middle, substr(body, greatest(c1, c2) + 1) AS suffix
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM cut
"""


@query
def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_exact(table(spark, sf_dir, "embeddings"))


ORACLES["op12_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@query
def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_interactions"] = r"""
WITH body AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
label AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN min(doc_id) OVER (PARTITION BY body) < doc_id THEN 'E' ELSE '' END) AS failed
  FROM body LEFT JOIN label USING (doc_id)
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
steps AS (SELECT filter_order, step::INTEGER AS step, filter_order[step:step] AS letter, left(filter_order, step - 1) AS before FROM orders, range(1, 6) t(step)),
counted AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
audited AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, contains(failed, letter) AS hit, len(list_intersect(string_split(failed, ''), string_split(before, ''))) > 0 AND failed <> '' AND before <> '' AS gone FROM counted, steps)
  GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM audited
"""
