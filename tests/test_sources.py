import json
import tempfile
from pathlib import Path

import pytest

from folioscan.sources import documents, library

ROW = {"id": "a", "rulesetId": "r", "sourceId": "s", "sourceTitle": "S", "title": "标题", "fullPath": "P", "content": "old", "version": "1"}


def folder(name, *lines):
    path = Path(tempfile.mkdtemp(prefix="spark-")) / name
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def test_documents_last_line_wins_in_first_place(spark):
    lines = [json.dumps(ROW), "", json.dumps({**ROW, "id": "b"}), json.dumps({**ROW, "content": "new", "priority": 7})]
    got = documents.read_documents(spark, folder("d.jsonl", *lines)).orderBy("ord").collect()
    assert [(r.id, r.content, r.priority) for r in got] == [("a", "new", 7), ("b", "old", 0)]


def test_lines_are_numbered_by_file_and_offset(spark):
    out = Path(tempfile.mkdtemp(prefix="spark-"))
    for name, first, n in (("a", 0, 3), ("b", 3, 400), ("c", 403, 5)):
        rows = [json.dumps({**ROW, "id": f"i{first + k}", "content": "x" * (300 if name == "b" else 9000)}) for k in range(n)]
        (out / f"{name}.jsonl").write_text("\n".join(rows), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = documents.read_documents(spark, str(out)).orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.ord, r.id) for r in got] == [(k, f"i{k}") for k in range(408)]


def test_bad_document_line_fails_or_is_skipped(spark):
    path = folder("d.jsonl", json.dumps(ROW), "{broken")
    with pytest.raises(Exception, match="invalid document"):
        documents.read_documents(spark, path).collect()
    assert documents.read_documents(spark, path, strict=False).count() == 1


def test_documents_round_trip(spark):
    docs = documents.read_documents(spark, folder("d.jsonl", json.dumps(ROW)))
    out = tempfile.mkdtemp(prefix="spark-")
    documents.write_documents(docs, out)
    again = documents.read_documents(spark, out).first()
    assert (again.id, again.title, again.content) == ("a", "标题", "old")


def test_cases_are_checked(spark):
    good = json.dumps({"id": "c", "query": "q", "relevantIds": ["a"]})
    assert documents.read_cases(spark, folder("c.jsonl", good), "retrieval").first().relevantIds == ["a"]
    with pytest.raises(Exception, match="invalid retrieval case"):
        documents.read_cases(spark, folder("c.jsonl", json.dumps({"id": "c", "query": "q"})), "retrieval").collect()


def test_revision_gate(spark):
    docs = documents.read_documents(spark, folder("d.jsonl", json.dumps(ROW), json.dumps({**ROW, "id": "b"}))).select(
        "id", "ruleset_id", "content"
    )
    manifest = {"id": "r", "name": "n", "system": "s", "edition": "e", "aliases": [" x ", "x"]}
    with pytest.raises(ValueError, match="exact duplicate"):
        library.stage_revision(docs, manifest, tempfile.mkdtemp(prefix="spark-"), "20240101T000000Z")
    one = docs.where("id = 'a'")
    row = library.stage_revision(one, manifest, tempfile.mkdtemp(prefix="spark-"), "20240101T000000Z").first()
    assert row.aliases == ["x"] and row.document_count == 1
