"""Table layouts. Open metadata dictionaries become flat, prunable columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRUCTURAL_BLOCKS = (
    "array<struct<heading_path:array<string>,content:string,table_index:int,row_index:int>>"
)

# Core columns of a parent document.
DOCUMENT_COLUMNS = {
    "id": "string",
    "ruleset_id": "string",
    "source_id": "string",
    "source_title": "string",
    "title": "string",
    "full_path": "string",
    "content": "string",
    "version": "string",
    "priority": "int",
}

# Known metadata keys, flattened.
METADATA_COLUMNS = {
    "source_file": "string",
    "original_file": "string",
    "format": "string",
    "encoding": "string",
    "page": "int",
    "table_count": "int",
    "structure_version": "int",
    "legacy_parent_id": "string",
    "entry_type": "string",
    "entry_name": "string",
    "name_zh": "string",
    "name_en": "string",
    "entry_name_zh": "string",
    "entry_name_en": "string",
    "heading_path": "array<string>",
    "table_index": "int",
    "document_type": "string",
    "kind": "string",
    "category": "string",
    "type": "string",
    "is_index": "boolean",
    "is_navigation": "boolean",
    "is_update_log": "boolean",
    "structural_blocks": STRUCTURAL_BLOCKS,
}

DEFAULTS = {"priority": "0"}


def conform(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Add the columns a job needs that `df` lacks, as typed nulls (priority as 0)."""
    wanted = columns or {**DOCUMENT_COLUMNS, **METADATA_COLUMNS}
    missing = {
        name: F.lit(int(DEFAULTS[name]) if name in DEFAULTS else None).cast(kind)
        for name, kind in wanted.items()
        if name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns
