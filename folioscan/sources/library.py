"""Table-of-contents assembly, library re-keying, paged sources, revisions and chunk vectors."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.scale import settle
from folioscan.functions.text import collapse_spaces

# --- Fixed values: source codes and priorities by top-level label -----------------------------
SOURCE_CODES = ("CRB", "APG", "ACG", "ARG", "UM", "UC", "OA", "UI", "FAQ")
CORE_WORDS, CORE_PRIORITY = ("CRB", "核心规则"), 100
FAQ_WORDS, FAQ_PRIORITY = ("FAQ", "常用速查"), 90
LOOSE_WORDS, LOOSE_PRIORITY = ("未整理", "出处未明"), 20
OTHER_PRIORITY = 60
# --- End of fixed values ------------------------------------------------------------------------


def choose_toc_entries(entries: DataFrame) -> DataFrame:
    """One row per lower-cased file: the deepest path, the first on ties. Columns ord, name, local, path."""
    best = F.max_by(F.struct("ord", "name", "local", "path"), F.struct(F.size("path"), -F.col("ord")))
    return entries.groupBy(F.lower("local").alias("key")).agg(best.alias("e")).select("key", "e.*")


def source_code(title: Column) -> Column:
    chain = F
    for code in SOURCE_CODES:
        chain = chain.when(F.contains(F.upper(title), F.lit(code)), F.lit(code.lower()))
    return chain.otherwise(F.concat(F.lit("source-"), F.substring(F.sha1(title), 1, 8)))


def source_priority(title: Column) -> Column:
    def named(words: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.upper(title), F.lit(w))
        return hit

    return (
        F.when(named(CORE_WORDS), CORE_PRIORITY)
        .when(named(FAQ_WORDS), FAQ_PRIORITY)
        .when(named(LOOSE_WORDS), LOOSE_PRIORITY)
        .otherwise(OTHER_PRIORITY)
    )


def assemble_documents(chosen: DataFrame, pages: DataFrame, ruleset_id: str, version: str) -> DataFrame:
    """Parent documents with a `status`: imported, missing or empty.

    `pages` has local, html_title, text, encoding. The title is the entry name,
    else the page title, else the file stem.
    """
    parts = F.filter("path", lambda p: p != "")
    stem = F.regexp_replace(F.regexp_extract("local", "([^/]+)$", 1), r"\.[^.]*$", "")
    title = F.coalesce(F.nullif("name", F.lit("")), F.nullif("html_title", F.lit("")), stem)
    top = F.when(F.size(parts) > 0, parts[0]).otherwise(title)
    html = F.regexp_like("local", F.lit(r"(?i)\.html?$"))
    joined = chosen.join(pages.withColumn("key", F.lower("local")).drop("local"), "key", "left")
    status = (
        F.when(F.col("text").isNull() | ~html, "missing").when(F.col("text") == "", "empty").otherwise("imported")
    )
    return joined.select(
        F.concat_ws("-", F.lit(ruleset_id), F.substring(F.sha1("key"), 1, 12)).alias("id"),
        F.lit(ruleset_id).alias("ruleset_id"),
        source_code(top).alias("source_id"),
        top.alias("source_title"),
        title.alias("title"),
        F.when(F.size(parts) > 0, F.array_join(parts, " > ")).otherwise(title).alias("full_path"),
        F.col("text").alias("content"),
        F.lit(version).alias("version"),
        source_priority(top).alias("priority"),
        F.col("local").alias("source_file"),
        "encoding",
        status.alias("status"),
    )


def import_report(assembled: DataFrame) -> DataFrame:
    """Counts by status and encoding; the reference list of missing files is a plain filter."""
    return assembled.groupBy("status", F.coalesce("encoding", F.lit("-")).alias("encoding")).agg(
        F.count("*").alias("files")
    )


def remap_library(docs: DataFrame, library_id: str, edition: str) -> DataFrame:
    """Re-key imported documents to one library."""
    return docs.withColumns(
        {
            "id": F.concat(F.lit(f"{library_id}:chm:"), F.substring(F.sha2(F.lower("source_file"), 256), 1, 16)),
            "ruleset_id": F.lit(library_id),
            "source_id": F.concat(F.lit("source-"), F.substring(F.sha2("source_title", 256), 1, 12)),
            "version": F.lit(edition),
            "priority": F.lit(0),
            "format": F.lit("chm"),
        }
    )


def table_text(rows: Column) -> Column:
    """Markdown of array<array<string>> cells: blanks collapsed, pipes escaped, short rows padded."""
    cells = F.transform(
        rows,
        lambda r: F.transform(
            r, lambda c: collapse_spaces(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")))
        ),
    )
    kept = F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))

    def render(table: Column) -> Column:
        width = F.array_max(F.transform(table, lambda r: F.size(r)))
        padded = F.transform(
            table, lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0))))
        )
        head = F.when(F.exists(padded[0], lambda c: c != ""), padded[0]).otherwise(
            F.transform(F.sequence(F.lit(1), width), lambda n: F.concat(F.lit("列 "), n))
        )

        def line(r: Column) -> Column:
            return F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))

        body = F.transform(F.slice(padded, 2, F.greatest(F.size(padded) - 1, F.lit(1))), line)
        return F.array_join(
            F.concat(F.array(line(head), line(F.array_repeat(F.lit("---"), width))), body), "\n"
        )

    return F.when(F.size(kept) > 0, F.transform(F.array(kept), render)[0]).otherwise(F.lit(""))


def table_reliable(rows: Column) -> Column:
    kept = F.filter(rows, lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    widths = F.transform(kept, lambda r: F.size(r))
    return F.coalesce((F.array_max(widths) > 1) & (F.array_max(widths) == F.array_min(widths)), F.lit(False))


def layout_text(raw: Column) -> Column:
    """Page text with blanks collapsed per line and runs of empty lines as one."""
    lines = F.transform(F.split(raw, "\n"), collapse_spaces)
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def paged_documents(pages: DataFrame, library_id: str, edition: str) -> DataFrame:
    """One document per (file, page): text, then each table under its number; empty pages drop out.

    `pages` has file, source_title, page, raw_text, tables. The text is cut at the headings of its
    layout into structural blocks, and headings hold from page to page.
    """
    from folioscan.operators.structure import cut_pages, with_labels

    rendered = F.filter(
        F.transform(
            F.coalesce("tables", F.array().cast("array<array<array<string>>>")),
            lambda t, i: F.struct(table_text(t).alias("text"), (i + 1).alias("n")),
        ),
        lambda t: t["text"] != "",
    )
    parts = F.filter(
        F.concat(
            F.array(layout_text(F.col("raw_text"))),
            F.transform("_tables", lambda t: F.concat(F.lit("### 表格 "), t["n"], F.lit("\n\n"), t["text"])),
        ),
        lambda p: p != "",
    )
    rows = pages.withColumn("_tables", rendered).withColumn("content", F.array_join(parts, "\n\n"))
    page_label = F.concat(F.lit("第 "), F.col("page"), F.lit(" 页"))
    full = settle(rows.where(F.col("content") != "").select("file", "page", "source_title", "raw_text", "content", F.size("_tables").alias("_tables")))
    cut = cut_pages(with_labels(full).drop("raw_text"))
    return cut.select(
        F.concat(
            F.lit(f"{library_id}:pdf:"),
            F.substring(F.sha2(F.concat_ws(":", "file", F.col("page").cast("string")), 256), 1, 16),
        ).alias("id"),
        F.lit(library_id).alias("ruleset_id"),
        F.concat(F.lit("source-"), F.substring(F.sha2("source_title", 256), 1, 12)).alias("source_id"),
        "source_title",
        F.concat(F.col("source_title"), F.lit(" · "), page_label).alias("title"),
        F.concat(F.array_join("heading_path", " > "), F.lit(" > "), page_label).alias("full_path"),
        "content",
        F.lit(edition).alias("version"),
        F.lit(0).alias("priority"),
        "file",
        "page",
        F.col("_tables").alias("table_count"),
        F.lit(2).alias("structure_version"),
        "heading_path",
        "inherited_headings",
        "structural_blocks",
    )


def page_warnings(pages: DataFrame) -> DataFrame:
    """unreliable_table, image_dominant_page and empty_page rows; needs image_count too."""
    text = layout_text(F.col("raw_text"))
    tables = F.coalesce("tables", F.array().cast("array<array<array<string>>>"))
    found = F.array_compact(
        F.concat(
            F.transform(
                tables,
                lambda t, i: F.when(
                    ~table_reliable(t), F.struct(F.lit("unreliable_table").alias("type"), (i + 1).alias("table"))
                ),
            ),
            F.array(
                F.when(
                    (F.col("image_count") > 0) & (F.length(text) < 80),
                    F.struct(F.lit("image_dominant_page").alias("type"), F.lit(None).cast("int").alias("table")),
                ),
                F.when(
                    (text == "") & ~F.exists(tables, lambda t: table_text(t) != ""),
                    F.struct(F.lit("empty_page").alias("type"), F.lit(None).cast("int").alias("table")),
                ),
            ),
        )
    )
    return pages.select("file", "page", F.explode(found).alias("w")).select("file", "page", "w.type", "w.table")


# --- revisions ----------------------------------------------------------------------------------


def stage_revision(
    docs: DataFrame, manifest: dict[str, object], root: str, revision: str | None = None, report: dict[str, object] | None = None
) -> DataFrame:
    """Check a library build and write it as a new revision that no reader sees yet; returns its manifest row.

    Fails on an empty build, a foreign library id, exact duplicate content, or an import report of
    another library. The revision is a UTC stamp unless given. Documents come first and the manifest
    last: without it `publish_revision` refuses, and staging an aborted revision again replaces what it left.
    """
    from folioscan.operators.neardup import exact_duplicates

    library_id = str(manifest["id"])
    revision = revision or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    if report is not None and report.get("libraryId") != library_id:
        raise ValueError(f"the import report belongs to {report.get('libraryId')}")
    facts = docs.agg(
        F.count("*").alias("n"), F.max(F.when(F.col("ruleset_id") != library_id, F.col("id"))).alias("foreign")
    ).first()
    if facts.n == 0:
        raise ValueError("library contains no documents")
    if facts.foreign is not None:
        raise ValueError(f"documents use a different library id: {facts.foreign}")
    copy = exact_duplicates(docs).first()
    if copy is not None:
        raise ValueError(f"exact duplicate content: {copy.first_id} and {copy.id}")
    aliases = [str(a) for a in manifest.get("aliases", [])]  # type: ignore[union-attr]
    if any(not a.strip() for a in aliases):
        raise ValueError("aliases must be non-empty strings")
    staged = docs.withColumn("library_id", F.lit(library_id)).withColumn("revision", F.lit(revision))
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("library_id", "revision").parquet(f"{root}/documents")
    row = docs.sparkSession.range(1).select(
        F.lit(library_id).alias("id"),
        *[F.lit(str(manifest[k])).alias(k) for k in ("name", "system", "edition")],
        F.lit(revision).alias("revision"),
        F.lit(facts.n).alias("document_count"),
        F.array(*[F.lit(a) for a in dict.fromkeys(a.strip() for a in aliases)]).cast("array<string>").alias("aliases"),
        F.lit(None if report is None else json.dumps(report, ensure_ascii=False)).cast("string").alias("import_report"),
    )
    row.write.mode("append").parquet(f"{root}/revisions")
    return row


def publish_revision(spark: SparkSession, root: str, library_id: str, revision: str, at: str | None = None) -> None:
    """Make a staged revision the active one: one appended row. Refuses a revision without a manifest."""
    known = spark.read.parquet(f"{root}/revisions").where((F.col("id") == library_id) & (F.col("revision") == revision))
    if known.isEmpty():
        raise ValueError(f"revision {revision} of {library_id} was not staged")
    stamp = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    row = spark.range(1).select(F.lit(library_id).alias("library_id"), F.lit(revision).alias("revision"), stamp.alias("activated_at"))
    row.write.mode("append").parquet(f"{root}/activations")


def published_documents(spark: SparkSession, root: str) -> DataFrame:
    """The documents of all active revisions. The filter is on the partition columns: other revisions are not read."""
    active = current_revision(spark.read.parquet(f"{root}/activations"))
    return spark.read.parquet(f"{root}/documents").join(F.broadcast(active), ["library_id", "revision"], "left_semi")  # one row a library


def current_revision(activations: DataFrame) -> DataFrame:
    """Active revision per library: the one published last."""
    return activations.groupBy("library_id").agg(F.max_by("revision", "activated_at").alias("revision"))


def read_catalog(spark: SparkSession, glob: str) -> DataFrame:
    """Library manifests; repeated ids and empty aliases are errors."""
    schema = (
        "id string, name string, system string, edition string, revision string, documents string, "
        "indexDir string, aliases array<string>"
    )
    rows = spark.read.schema(schema).json(glob, multiLine=True)
    counts = rows.groupBy("id").agg(F.count("*").alias("_n"))
    blank = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.trim(F.coalesce(a, F.lit(""))) == "")
    bad = F.when(F.col("_n") > 1, F.lit("duplicate library id")).when(blank, F.lit("aliases must be non-empty strings"))
    return (
        rows.join(counts, "id")
        .withColumn("name", F.when(bad.isNull(), F.col("name")).otherwise(F.raise_error(bad).cast("string")))
        .drop("_n")
    )


# --- chunk vectors --------------------------------------------------------------------------------

MANIFEST_KEYS = ("ruleset_id", "source_digest", "model", "chunk_size", "chunk_overlap")


def new_chunk_vectors(chunks: DataFrame, vectors: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Vector records still missing from the index, with their parents' metadata.

    Resuming by anti join on the chunk id is right even after a partial write.
    """
    fresh = chunks if existing is None else chunks.join(existing.select("chunk_id"), "chunk_id", "left_anti")
    return fresh.join(vectors, "chunk_id")


def upsert_chunk_vectors(chunks: DataFrame, vectors: DataFrame, path: str, manifest: dict[str, object]) -> int:
    """Bring the vector index under `path` up to date; returns the number of records added.

    `manifest` has MANIFEST_KEYS. An index holds one library and one manifest, which is written first:
    a build that was cut off goes on where its records end, and one with another source or other
    settings is refused. `vector_index_status` says whether all records are there.
    """
    spark = chunks.sparkSession
    wanted = tuple(str(manifest[k]) for k in MANIFEST_KEYS)
    libraries = [r[0] for r in chunks.select("ruleset_id").distinct().limit(2).collect()]
    if libraries != [manifest["ruleset_id"]]:
        raise ValueError("an index holds exactly one library, that of its manifest")
    held = _maybe(spark, f"{path}/manifest")
    if held is None:
        schema = ", ".join(f"{k} string" for k in MANIFEST_KEYS)
        spark.createDataFrame([wanted], schema).coalesce(1).write.parquet(f"{path}/manifest")
    elif tuple(held.select(*MANIFEST_KEYS).first()) != wanted:
        raise ValueError("the index was built from another source or with other settings; build it anew")
    records = _maybe(spark, f"{path}/records")
    before = 0 if records is None else records.count()
    new_chunk_vectors(chunks, vectors, records).write.mode("append").parquet(f"{path}/records")
    return spark.read.parquet(f"{path}/records").count() - before


def vector_index_status(chunks: DataFrame, path: str) -> dict[str, object]:
    """Chunks, records, and whether each chunk has one; an index that was never begun has no records."""
    records = _maybe(chunks.sparkSession, f"{path}/records")
    expected = chunks.count()
    missing = expected if records is None else chunks.join(records.select("chunk_id"), "chunk_id", "left_anti").count()
    return {"chunks": expected, "records": expected - missing, "complete": missing == 0}


def _maybe(spark: SparkSession, path: str) -> DataFrame | None:
    """The table under a path, or nothing where none was written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
