"""Document, case and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.schemas import STRUCTURAL_BLOCKS

# JSON name of each column (fixed values).
JSON_NAMES = {
    "id": "id", "ruleset_id": "rulesetId", "source_id": "sourceId", "source_title": "sourceTitle",
    "title": "title", "full_path": "fullPath", "content": "content", "version": "version",
    "priority": "priority", "metadata": "metadata",
}
REQUIRED = ("id", "rulesetId", "sourceId", "sourceTitle", "title", "fullPath", "content", "version")
BLOCKS_JSON = "array<struct<headingPath:array<string>,content:string,tableIndex:int,rowIndex:int>>"
DOCUMENT_JSON = (
    "id string, rulesetId string, sourceId string, sourceTitle string, title string, fullPath string, "
    "content string, version string, priority int, metadata struct<sourceFile:string,legacyParentId:string,"
    "entryType:string,entryNameZh:string,entryNameEn:string,nameZh:string,nameEn:string,"
    f"headingPath:array<string>,structuralBlocks:{BLOCKS_JSON}>"
)
CASE_JSON = {
    "retrieval": "id string, query string, relevantIds array<string>, mustNotLeadWith array<string>",
    "answer": (
        "id string, turns array<struct<query:string,relevantIds:array<string>,requiredAny:array<array<string>>,"
        "requiredSourceGroups:array<array<string>>>>"
    ),
    "routing": (
        "id string, query string, expectedComplexity string, expectedDomains array<string>, expectedQuestionCount int"
    ),
    "planning": (
        "id string, query string, tasks array<struct<id:string,domain:string,dependsOn:array<string>>>, "
        "conditional boolean, expectedStage2Sufficient boolean"
    ),
}


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their place over all files (`ord`, files by path) and in their file (`line`, from 1).

    Spark packs the splits of files into partitions in an order of its own, so a line's place is the
    number of lines in the splits before its own and its distance from the split's first line. The
    table of splits is the only one that is ordered as a whole.
    """
    lines = spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = lines.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    before = Window.orderBy("file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_all", F.coalesce(F.sum("_lines").over(before), F.lit(0))).withColumn(
        "_own", F.coalesce(F.sum("_lines").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    place = F.col("_id") - F.col("_first")
    return (
        lines.where(F.trim("value") != "")
        .join(splits, ["file", "_start"])
        .select("value", "file", (F.col("_all") + place).alias("ord"), (F.col("_own") + place + 1).alias("line"))
    )


def _checked(value: Column, ok: Column, what: str, place: Column | None = None) -> Column:
    if place is None:
        place = F.concat(F.col("file"), F.lit(", line "), F.col("line").cast("string"))
    message = F.concat(F.lit(f"invalid {what} in "), place)
    return F.when(ok, value).otherwise(F.raise_error(message).cast("string"))


def read_documents(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Parent documents from JSON lines, metadata flattened to columns.

    Strict reading fails on the first line that is no JSON object or misses a
    required key; otherwise such lines are left out. Of repeated ids the last
    line wins but takes the place (`ord`) of the first.
    """
    lines = _numbered_lines(spark, path)
    parsed = lines.withColumn("v", F.try_parse_json("value")).withColumn("d", F.from_json("value", DOCUMENT_JSON))
    ok = F.col("v").isNotNull()
    for key in REQUIRED:
        ok = ok & F.col(f"d.{key}").isNotNull()
    if strict:
        parsed = parsed.withColumn("id", _checked(F.col("d.id"), ok, "document"))
    else:
        parsed = parsed.where(ok).withColumn("id", F.col("d.id"))
    places = parsed.groupBy("id").agg(F.min("ord").alias("ord"), F.max("ord").alias("_last"))
    rows = parsed.withColumnRenamed("ord", "_last").join(places, ["id", "_last"])
    m = "d.metadata."
    return rows.select(
        "ord",
        "id",
        F.col("d.rulesetId").alias("ruleset_id"),
        F.col("d.sourceId").alias("source_id"),
        F.col("d.sourceTitle").alias("source_title"),
        F.col("d.title").alias("title"),
        F.col("d.fullPath").alias("full_path"),
        F.col("d.content").alias("content"),
        F.col("d.version").alias("version"),
        F.coalesce("d.priority", F.lit(0)).alias("priority"),
        F.col(m + "sourceFile").alias("source_file"),
        F.col(m + "legacyParentId").alias("legacy_parent_id"),
        F.col(m + "entryType").alias("entry_type"),
        F.col(m + "entryNameZh").alias("entry_name_zh"),
        F.col(m + "entryNameEn").alias("entry_name_en"),
        F.col(m + "nameZh").alias("name_zh"),
        F.col(m + "nameEn").alias("name_en"),
        F.col(m + "headingPath").alias("heading_path"),
        F.col(m + "structuralBlocks").cast(STRUCTURAL_BLOCKS).alias("structural_blocks"),
        F.variant_get("v", "$.metadata", "variant").alias("metadata_raw"),
    )


def document_json(docs: DataFrame) -> DataFrame:
    """One JSON text per document with the exchange names; non-ASCII kept as is."""
    fields = [F.col(c).alias(j) for c, j in JSON_NAMES.items() if c in docs.columns]
    extra = []
    if "metadata" not in docs.columns:
        names = {
            "source_file": "sourceFile", "legacy_parent_id": "legacyParentId", "entry_type": "entryType",
            "entry_name_zh": "entryNameZh", "entry_name_en": "entryNameEn", "name_zh": "nameZh", "name_en": "nameEn",
            "heading_path": "headingPath",
        }
        extra = [F.struct(*[F.col(c).alias(j) for c, j in names.items() if c in docs.columns]).alias("metadata")] if any(
            c in docs.columns for c in names
        ) else []
    return docs.select(F.to_json(F.struct(*fields, *extra)).alias("value"))


def write_documents(docs: DataFrame, path: str) -> None:
    document_json(docs).write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def read_cases(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Evaluation cases of one kind; an invalid case or an empty set fails the job."""
    lines = _numbered_lines(spark, path).withColumn("c", F.from_json("value", CASE_JSON[kind]))
    ok = F.coalesce(F.length("c.id") > 0, F.lit(False))
    if kind in ("retrieval", "routing", "planning"):
        ok = ok & F.coalesce(F.length("c.query") > 0, F.lit(False))
    if kind == "retrieval":
        ok = ok & (F.coalesce(F.size("c.relevantIds"), F.lit(0)) > 0)
    if kind == "planning":
        ok = ok & (F.coalesce(F.size("c.tasks"), F.lit(0)) > 0)
    if kind == "answer":
        ok = ok & (F.coalesce(F.size("c.turns"), F.lit(0)) > 0) & F.coalesce(
            F.forall(
                "c.turns",
                lambda t: (F.coalesce(F.length(t["query"]), F.lit(0)) > 0)
                & (F.coalesce(F.size(t["relevantIds"]), F.lit(0)) > 0)
                & F.coalesce(F.exists(t["requiredAny"], lambda g: F.size(g) > 0), F.lit(False))
                & F.forall(
                    F.coalesce(t["requiredSourceGroups"], F.array().cast("array<array<string>>")),
                    lambda g: F.size(g) > 0,
                ),
            ),
            F.lit(False),
        )
    if lines.isEmpty():
        raise ValueError(f"{kind} case set is empty")
    checked = lines.withColumn("id", _checked(F.col("c.id"), ok, f"{kind} case"))
    rest = [f"c.{f.split()[0]}" for f in _top_fields(CASE_JSON[kind])[1:]]
    return checked.select("ord", "id", *rest)


def _top_fields(ddl: str) -> list[str]:
    from pyspark.sql.types import StructType

    return [f"{f.name} _" for f in StructType.fromDDL(ddl).fields]


def expand_history(cases: DataFrame) -> DataFrame:
    """Message rows of compact history templates: turn_count turns of filler, events in their turns.

    Columns: id, turn_count, filler_user, filler_assistant, events
    (array<struct<turn,user,assistant>>). Repeated or out-of-range event turns
    are errors.
    """
    turns = F.transform("events", lambda e: e["turn"])
    ok = (
        F.col("turn_count").between(1, 128)
        & (F.size(F.array_distinct(turns)) == F.size(turns))
        & F.forall(turns, lambda t: (t >= 1) & (t <= F.col("turn_count")))
    )
    checked = cases.withColumn("_id", _checked(F.col("id").cast("string"), ok, "history template", F.col("id").cast("string")))
    rows = checked.select(
        "*", F.explode(F.sequence(F.lit(1), F.col("turn_count"))).alias("turn")
    ).where(F.col("_id").isNotNull())
    event = F.get(F.filter("events", lambda e: e["turn"] == F.col("turn")), F.lit(0))
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.coalesce(event["user"], F.col("filler_user")).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.coalesce(event["assistant"], F.col("filler_assistant")).alias("content")),
    )
    return rows.select("id", "turn", F.posexplode(pair).alias("half", "m")).select(
        "id", ((F.col("turn") - 1) * 2 + F.col("half")).alias("position"), "m.role", "m.content"
    )
