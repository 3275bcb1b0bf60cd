"""The corpus pipeline against its stages' own brute force, one stage at a time."""

import re

import corpus_pipeline
from folioscan.llm import pii, quality
from folioscan.llm.common import table
from test_operators import fingerprint, groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF)
    model = quality.fit_quality(docs, table(spark, SF, "labels"))
    left = {i for i, r in before.items() if model.scores(quality.matrix([r.text]))[0] >= 0.7}
    assert {r.doc_id for r in good.collect()} == left and good.columns == docs.columns
    single = stages["near_copies"](spark, good, SF)
    prints = {i: fingerprint(before[i].text) for i in left}
    group = groups(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    left = {i for i in left if group[i] == i}
    assert {r.doc_id for r in single.collect()} == left and single.columns == docs.columns
    hidden = {r.doc_id: r for r in stages["personal_data"](spark, single, SF).collect()}
    assert set(hidden) == left
    for i, r in hidden.items():
        assert r.text == pii.replace_entities(before[i].text, corpus_pipeline.PII_KEY, {})[0] and r.n_chars == len(r.text) and r.lang == before[i].lang
    assert not any(re.search(r"\+1 \(\d{3}\) 555-\d{4}", r.text) for r in hidden.values())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == left
