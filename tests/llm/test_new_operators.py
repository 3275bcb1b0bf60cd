"""Fill-in-the-middle, exact top-k and the filter audit against brute force, and their results for odd input."""

import hashlib
import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from folioscan.llm import fill_middle, filter_audit, va_file
from folioscan.llm.common import table

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k % 977}" for k in range(20_000))
TEXTS = [
    "A text that comes twice, with $ and a few WORDS.", "A text that comes twice, with $ and a few WORDS.", None, "", "", " \n\t ", "x",
    LONG, LONG + " end", "one <P> mark", "almost <P a mark< <", "日本語 テキスト, привет мир, 😀 ok", "<" * 50, "S>M>P>" * 9,
]


def edge(spark, texts=TEXTS):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, i) for i, t in enumerate(texts)] + [(None, "a text without an id", "", 0), (1, texts[1], "s1", 1), (1, "other text of id 1", "s1", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row long").withColumn("mask", docs_mask())


def docs_mask():
    from pyspark.sql import functions as F

    return F.lit("a column of the user")


def fim(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h[3] % 100 < 20:
        return n, "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("unit", [1 << 14, 7, 1])
def test_fill_in_middle(spark, unit):
    docs = edge(spark, TEXTS if unit > 1 else [t for t in TEXTS if t is None or len(t) < 1000])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(str((i, *fim(i, t)[:4], sha(fim(i, t)[4]), sha(t))) for i, t in rows)
    got = [tuple(r) for r in fill_middle.fim_digests(docs, unit).collect()]
    assert sorted(map(str, got)) == want
    texts = [tuple(r) for r in fill_middle.fim_texts(docs, unit).collect()]
    assert sorted(map(str, texts)) == sorted(str((i, *fim(i, t))) for i, t in rows)
    assert len({r[2] for r in got}) == 3 or unit == 1


def test_fill_in_middle_of_no_rows(spark):
    none = edge(spark).limit(0)
    assert fill_middle.fim_digests(none).count() == 0 and fill_middle.fim_texts(none).count() == 0


def test_restorer_needs_its_marks():
    restorer = fill_middle.Restorer("psm")
    list(restorer.feed("<P>abc<S>d"))
    with pytest.raises(ValueError):
        list(restorer.close())


def brute_top(rows, k, every):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in good), default=0)
    good = [(i, v + [0] * (dims - len(v))) for i, v in good]
    out = []
    for at, (q, a) in enumerate(good):
        if q is None or q % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for other, (i, b) in enumerate(good) if other != at)
        out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"cells": 4, "block": 16, "shard_blocks": 2, "query_block": 3}, {"cells": 2}])
def test_exact_top_k(spark, sizes):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=12).astype(np.float32).tolist()) for k in range(300)]
    same = rng.normal(size=12).astype(np.float32).tolist()
    rows += [(1000 + k, same) for k in range(150)]  # a third of all rows, queries among them
    rows += [(2000 + k, (np.array(same) + rng.normal(size=12) * 1e-3).tolist()) for k in range(60)]
    rows += [(None, same), (50, rows[50][1]), (50, rows[51][1]), (5000, None), (5050, [1.0, None]), (5100, [float("nan")] * 12), (5150, [float("inf")] + [0.0] * 11), (5200, []), (5250, [1.0, -1.0]), (5300, [0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS node", "1 AS v", "2 AS score").repartition(5)
    plain = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted((tuple(r) for r in va_file.top_k_exact(df, 5, 50, **sizes).collect()), key=str)
    assert got == brute_top(plain, 5, 50)


def test_exact_top_k_of_few_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert va_file.top_k_exact(spark.createDataFrame([], schema)).count() == 0
    assert va_file.top_k_exact(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
    assert va_file.top_k_exact(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    two = [tuple(r) for r in va_file.top_k_exact(spark.createDataFrame([(0, [1.0]), (7, [-0.001])], schema)).collect()]
    assert two == [(0, 1, 7, -256)]


def test_exact_top_k_reads_few_vectors(spark):
    """The approximation does its work: the bounds leave a small part of all pairs for exact reading."""
    rng = np.random.default_rng(1)
    vectors = rng.integers(-90, 90, size=(2000, 64))
    starts, floor, ceiling = va_file.cell_borders(vectors, vectors.min(axis=0), vectors.max(axis=0), va_file.CELLS)
    codes = np.stack([np.searchsorted(s, vectors[:, j], side="right") for j, s in enumerate(starts)], axis=1)
    low, high = va_file.bounds(vectors[:20], floor[np.arange(64), codes], ceiling[np.arange(64), codes])
    exact = 2 * (vectors[:20] @ vectors.T)
    assert (low <= exact).all() and (exact <= high).all()
    assert (high >= np.sort(low, axis=1)[:, -6:-5]).mean() < 0.01


def brute_audit(docs, labels):
    """Straight from the definition: every order, document by document."""
    space = re.compile("[^\x20\x09-\x0d]+")
    by_id = {}
    for i, quality, toxic in labels:
        good, bad = by_id.get(i, (0, 0))
        by_id[i] = (max(good, int(quality == 1)), max(bad, int(toxic == 1)))
    texts = [(i, t or "", s or "") for i, t, s in docs]
    rows = []
    for i, t, s in texts:
        w = space.findall(t)
        failed = set()
        failed |= {"A"} if len(w) < 50 else set()
        failed |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        failed |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        failed |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        failed |= {"E"} if i is not None and any(j is not None and j < i and u == t for j, u, _ in texts) else set()
        rows.append((s, failed, *(by_id.get(i, (0, 0)) if i is not None else (0, 0))))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                before = len([r for r in mine if letter in r[1]]) - len(gone)
                left = [r for r in left if letter not in r[1]]
                shapley[part, letter] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), before, sum(r[1] == {letter} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark):
    docs = edge(spark)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(12)] + [(3, None, None), (4, 1, 1), (None, 1, 1)]
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == COLUMNS
    want = brute_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], labels)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len(want) == 600 * len({r[0] for r in want})


def test_filter_audit_of_the_table(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    want = brute_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert sorted(tuple(r) for r in filter_audit.filter_audit(docs, labels).collect()) == want


def test_filter_audit_of_nothing(spark):
    docs = edge(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    assert {(r.good_lost, r.toxic_lost) for r in filter_audit.filter_audit(docs, labels).collect()} == {(0, 0)}


def test_copies_in_a_large_group(spark):
    """A third of all rows share one text; every one but the smallest id is a later copy, whatever part it is in."""
    rows = [(k, "the same text" if k % 3 == 0 else f"text {k}", str(k % 4)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, body string, part string").repartition(7)
    found = {r.doc_id for r in filter_audit.later_copies(docs).collect()}
    assert found == {k for k in range(3, 3000, 3)}


def test_registered_queries(spark):
    """The three queries against SQL and their own definition."""
    from folioscan.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in QUERIES["op11_fill_in_middle"](spark, SF).collect():
        n, form, prefix, middle, output = fim(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == sha(output) and r.restored_sha256 == sha(docs[r.doc_id])
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_exact_top_k"](spark, SF).collect()), key=str) == brute_top(rows, 5, 50)
    assert QUERIES["op13_filter_interactions"](spark, SF).columns == COLUMNS
