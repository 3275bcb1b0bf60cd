"""Inputs that once lost, joined or exposed data, as tests of the operators that did."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import embeddings, pii, simhash, syncmers, token_output
from folioscan.llm.components import components
from test_operators import KEY


@pytest.mark.parametrize("ids", [[2**60 + 3 * k for k in range(300)], [-(2**62) + k for k in range(300)], [7] * 300])
def test_next_texts_of_any_ids(spark, ids):
    rows = [(i, f"text {k:04d}") for k, i in enumerate(ids)]
    got = sorted(tuple(r) for r in syncmers.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), share_rows=11).collect())
    ordered = sorted(rows)
    assert got == sorted((*a, b[1]) for a, b in zip(ordered, ordered[1:] + ordered[:1]))


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    copy, unique = "the same words stand in both of these texts", "nothing like the other text at all, really"
    rows = [(1, copy, "a"), (5, copy, "b"), (5, unique, "c"), (5, unique, "c"), (9, unique, "d"), (None, copy, "e"), (None, copy, "e"), (8, None, "f"), (8, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("text_hash", F.lit("mine"))
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "", r.text_hash) for r in kept.collect())
    assert got == sorted([(1, copy, "mine"), (5, unique, "mine"), (0, copy, "mine"), (0, copy, "mine"), (8, "", "mine")])


def test_further_mentions_of_a_name_are_replaced(spark):
    text = "Mr. Smith spoke. Smith then left, and John Doe said that John knew Doe. SMITH was gone; Smithson stayed, and doe came."
    new, spans = pii.replace_entities(text, KEY, {})
    for word in ("Smith ", "SMITH", "John", "Doe"):
        assert word not in new
    assert "Smithson" in new and "doe came" in new
    of = {text[a:b]: s for _, a, b, s in spans}
    assert of["SMITH"] == of["Smith"].upper() and of["John Doe"] == f"{of['John']} {of['Doe']}"
    out, at = [], 0
    for _, a, b, s in spans:
        out += [text[at:a], s]
        at = b
    assert "".join(out) + text[at:] == new


def test_columns_of_any_name_stay(spark, monkeypatch):
    rows = [(k, "Mr. Smith wrote to jane@x.com", k, "t", "n", "h") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, entities long, text_hash string, _new string, body string")
    for exceptions in ([], [("name", "Smith", 1)]):
        monkeypatch.setattr(pii, "surrogate_exceptions", lambda *_: spark.createDataFrame(exceptions, "kind string, entity string, attempt int"))
        done = pii.replace_personal_data(docs, KEY, spans_column=None)
        assert done.columns == docs.columns
        for r in done.collect():
            assert (r.entities, r.text_hash, r._new, r.body) == (r.doc_id, "t", "n", "h") and "Smith" not in r.text
        spans = pii.replace_personal_data(docs, KEY).collect()
        assert all(len(r.entities) == 2 for r in spans)


def test_repeated_and_null_ids_unpack_apart(spark):
    rows = [(1, "one text of some words"), (1, "another text"), (None, "no id"), (None, "no id either"), (1, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    encoder = token_output.Encoder(token_output.VOCABULARY, token_output.RANKS)
    import pyarrow as pa

    want = sorted((i or 0, [*map(int, encoder.batch(pa.array([t]))[0]), 50256]) for i, t in rows)
    got = sorted((r.doc_id or 0, r.ids) for r in token_output.unpacked(token_output.packed_rows(docs, size=16), 16).collect())
    assert got == want
    with pytest.raises(Exception, match="16 bits"):
        token_output.packed_rows(docs, end_id=70_000).count()


@pytest.mark.parametrize("kind, labels", [("double", [1.2, 1.7]), ("string", ["a", "b"]), ("int", [1, 2])])
def test_labels_of_any_type_keep_vectors_apart(spark, kind, labels):
    v = np.arange(1, 9).astype(float).tolist()
    rows = [(1, v, labels[0]), (2, v, labels[1]), (3, v, labels[0]), (4, v, None)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4)}


def test_units_of_fingerprints_stay_whole_between_crowded_and_small_ones(spark):
    """With crowded units but none that had to be dealt into chunks, the exchange by unit was dropped and units fell apart."""
    rng = np.random.default_rng(6)
    seeds = rng.integers(-(2**63), 2**63, 1500, dtype=np.int64)
    seeds[:40] = (seeds[:40] & ~0xFFFF) | 0x1234  # one crowded block
    seeds = np.unique(seeds)
    near = seeds ^ (np.int64(1) << rng.integers(0, 62, len(seeds)))
    values = np.unique(np.concatenate([seeds, near]))
    at = {v: k for k, v in enumerate(values.tolist())}
    prints = spark.createDataFrame([(k, v) for v, k in at.items()], "node long, fp long").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many tasks as large tables have
    try:
        links = simhash.near_links(prints, 3, trie_rows=32)
        group = {r.node: r.component for r in components(links).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    torn = [(a, b) for a, b in zip(seeds.tolist(), near.tolist()) if group.get(at[a], at[a]) != group.get(at[b], at[b])]
    assert torn == []
