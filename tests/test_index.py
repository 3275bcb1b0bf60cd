"""The stored lexical index against full scoring, and the inverted file of vectors against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.functions.rules import MarkerRules
from folioscan.operators import ivf, lexical, scan, stored_index, vectors
from folioscan.plans import search
from folioscan.schemas import DOCUMENT_COLUMNS, conform

RULES = MarkerRules(multiclass=("blend",), favored=("main",), reference=("index",), reference_types=())
SCHEMA = ", ".join(f"{c} {t}" for c, t in DOCUMENT_COLUMNS.items())


def corpus(spark, n=120):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)] + ["the", "of", "and"] * 60 + ["blend", "main"]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words, size=int(rng.integers(0, 400))))
        rows.append((f"d{k}", "one" if k % 3 else "two", f"s{k % 4}", "S", f"w{k} title", "a > b", text, "v", int(k % 5) * 40))
    rows += [("tie1", "one", "s1", "S", "same", "p", "w1 w2 w3", "v", 0), ("tie0", "one", "s1", "S", "same", "p", "w1 w2 w3", "v", 0), ("blank", "one", "s0", "S", "index", "p", " ", "v", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def asked(spark):
    rows = [(1, "one", "w5 w6 the of"), (2, "two", "w9"), (3, "one", "the"), (4, "one", "w7 title"), (5, "one", "nothing here at all zzz"), (6, "one", "blend main w1"), (7, "none", "w1"), (8, "one", "w1 w2 w3 w3 w3")]
    return spark.createDataFrame(rows, "query_id long, ruleset_id string, query string")


def listed(found):
    return sorted((r.query_id, r["rank"], r.doc_id, r.chunk_index, round(r.match_score, 7), round(r.score, 7)) for r in found.collect())


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    docs = corpus(spark).cache()
    path = f"{tmp_path_factory.mktemp('index')}/ix"
    return docs, path, stored_index.write_index(docs, path, size=200, overlap=20, rules=RULES, block_docs=6)


@pytest.mark.parametrize("limit, sources", [(3, None), (50, None), (5, ["s1", "s2"])])
def test_search_equals_full_scoring(spark, written, limit, sources):
    docs, _, index = written
    plain = lexical.build_index(docs, 200, 20, persist=False)
    got = stored_index.search_index(asked(spark), index, limit, sources, RULES, first_blocks=1 + limit % 2)
    assert listed(got) == listed(search.lexical_search(asked(spark), docs, plain, limit, sources, RULES))


def scored(found, value):
    return sorted((r.query_id, r.doc_id, r.chunk_index, round(r[value], 7)) for r in found.collect())


@pytest.mark.parametrize("sources", [None, ["s1", "s2"]])
def test_scan_equals_joins(spark, written, sources, monkeypatch):
    docs = written[0]
    plain, read = lexical.build_index(docs, 200, 20, persist=False), scan.ScannedLibrary(docs, 200, 20)
    pairs = lexical.bm25_chunk_scores(asked(spark), plain, sources)
    monkeypatch.setattr(scan, "CHUNK_TILE", 16)
    monkeypatch.setattr(scan, "QUESTION_TILE", 3)
    assert scored(scan.chunk_scores(asked(spark), read, sources), "score") == scored(pairs, "score")
    assert scored(scan.max_child(asked(spark), read, sources), "match_score") == scored(lexical.max_child(pairs), "match_score")


@pytest.mark.parametrize("limit, sources, ship", [(3, None, True), (50, None, True), (5, ["s1", "s2"], True), (5, None, False)])
def test_scanned_search_equals_full_scoring(spark, written, limit, sources, ship, monkeypatch):
    docs = written[0]
    monkeypatch.setattr(scan, "CHUNK_TILE", 16)
    monkeypatch.setattr(scan, "BROADCAST_BYTES", scan.BROADCAST_BYTES if ship else 0)
    plain, read = lexical.build_index(docs, 200, 20, persist=False), scan.ScannedLibrary(docs, 200, 20)
    got = search.lexical_search(asked(spark), docs, read, limit, sources, RULES)
    assert listed(got) == listed(search.lexical_search(asked(spark), docs, plain, limit, sources, RULES))
    best = scan.max_child(asked(spark), read, sources, limit)
    order = [F.col("match_score").desc(), F.col("doc_id").asc()]
    assert scored(lexical.top_k(best, limit, order), "match_score") == scored(
        lexical.top_k(lexical.max_child(lexical.bm25_chunk_scores(asked(spark), plain, sources)), limit, order), "match_score"
    )


def test_names_as_question_ids(spark, written):
    docs, _, index = written
    named = asked(spark).withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    plain = lexical.build_index(docs, 200, 20, persist=False)
    assert listed(search.lexical_search(named, docs, index, 4, rules=RULES)) == listed(search.lexical_search(named, docs, plain, 4, rules=RULES))


def test_long_document_spans_chunk_tiles(spark, tmp_path, monkeypatch):
    docs = corpus(spark, 8).unionByName(corpus(spark, 1).where("id = 'd0'").withColumns({"id": F.lit("long"), "ruleset_id": F.lit("one"), "content": F.repeat(F.lit("w5 w6 filler the "), 400)}))
    plain = lexical.build_index(docs, 60, 10, persist=False)
    index = stored_index.write_index(docs, f"{tmp_path}/ix", 60, 10, RULES, block_docs=4)
    monkeypatch.setattr(stored_index, "CHUNK_TILE", 7)
    monkeypatch.setattr(stored_index, "QUESTION_TILE", 2)
    assert listed(stored_index.search_index(asked(spark), index, 3, None, RULES)) == listed(search.lexical_search(asked(spark), docs, plain, 3, None, RULES))


def test_bounds_hold(spark, written):
    """No chunk contributes more than its block's summary says."""
    _, _, index = written
    rows = index.postings.join(index.stats, "ruleset_id")
    flat = rows.select("term", stored_index._largest_impact().alias("bound"), "average_length", F.explode("counts").alias("c"))
    assert flat.where(stored_index.impact(F.shiftright("c", 16), F.col("c").bitwiseAND(0xFFFF)) > F.col("bound") + 1e-12).count() == 0


def test_other_input_is_refused(spark, written):
    docs, path, _ = written
    digest = stored_index.input_digest(docs)
    assert stored_index.read_index(spark, path, docs, digest, RULES).manifest["digest"] == digest
    with pytest.raises(ValueError):
        stored_index.read_index(spark, path, docs, stored_index.input_digest(docs.limit(5)))
    with pytest.raises(ValueError):
        stored_index.read_index(spark, path, docs, digest, MarkerRules())


def test_aborted_build_cannot_be_opened(spark, tmp_path, monkeypatch):
    docs = corpus(spark, 3)
    monkeypatch.setattr(stored_index.markers, "document_flags", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        stored_index.write_index(docs, f"{tmp_path}/ix", rules=RULES)
    with pytest.raises(Exception, match="manifest"):
        stored_index.read_index(spark, f"{tmp_path}/ix", docs)


def test_empty_library(spark, tmp_path):
    none = conform(spark.createDataFrame([], SCHEMA))
    index = stored_index.write_index(none, f"{tmp_path}/ix", rules=RULES)
    assert stored_index.search_index(asked(spark), index, 5, None, RULES).count() == 0


def test_empty_query_fails_everywhere(spark, written):
    docs, _, index = written
    blank = asked(spark).withColumn("query", F.lit("  "))
    with pytest.raises(Exception, match="query must not be empty"):
        search.lexical_search(blank, docs, index, 3, rules=RULES).count()


def test_own_ranker_under_the_coordinator(spark, written):
    docs, _, index = written

    def first_documents(queries, docs, index, limit, sources, rules):
        rows = queries.crossJoin(docs.where("id in ('d1', 'd2')")).select("query_id", F.col("id").alias("doc_id"))
        return rows.withColumns({"chunk_index": F.lit(0), "score": F.lit(1.0), "match_score": F.lit(1.0), "rank": F.when(F.col("doc_id") == "d1", 1).otherwise(2)})

    found = search.coordinated_search(asked(spark).limit(1), docs, index, 900, first_documents, marker_rules=RULES)
    assert {r.doc_id for r in found.collect()} <= {"d1", "d2"} and found.count() > 0


def clustered(spark, n=600):
    rng = np.random.default_rng(9)
    hubs = rng.normal(size=(12, 16))
    rows = [(k, f"s{k % 3}", (hubs[k % 12 if k % 3 else 0] + 0.1 * rng.normal(size=16)).tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, source_id string, embedding array<double>")


def test_vector_lists(spark, tmp_path):
    stored = clustered(spark).cache()
    index = ivf.write_lists(stored, f"{tmp_path}/v", lists=12, part_rows=50)
    assert index.vectors.count() == 600 and index.parts.agg(F.max("parts")).first()[0] > 1
    assert index.probes < 12  # the groups are found, so few lists hold nearly all neighbours
    asked = stored.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    exact = vectors.nearest_children(asked, stored, 20)
    found = ivf.nearest_children_approx(asked, index, 20)
    assert ivf.recall_at_k(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    everything = ivf.nearest_children_approx(asked, index, 20, probes=12)
    assert sorted(map(tuple, everything.select("query_id", "chunk_id", "rank").collect())) == sorted(map(tuple, exact.select("query_id", "chunk_id", "rank").collect()))


def test_short_lists_are_searched_exactly(spark, tmp_path):
    stored = clustered(spark, 90).cache()
    index = ivf.write_lists(stored, f"{tmp_path}/v", lists=9)
    asked = stored.limit(4).select(F.col("chunk_id").alias("query_id"), "embedding")
    exact = vectors.nearest_children(asked, stored.where("source_id = 's1'"), 25)
    found = ivf.nearest_children_approx(asked, index, 25, probes=1, sources=["s1"])
    columns = ["query_id", "chunk_id", "rank"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, exact.select(*columns).collect()))


def test_no_vectors(spark, tmp_path):
    none = clustered(spark, 5).limit(0)
    index = ivf.write_lists(none, f"{tmp_path}/v")
    asked = clustered(spark, 5).select(F.col("chunk_id").alias("query_id"), "embedding")
    assert ivf.nearest_children_approx(asked, index, 3).count() == 0
