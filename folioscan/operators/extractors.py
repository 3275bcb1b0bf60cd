"""A registry of fact extractors by exact library identity, run over evidence, one ledger at a time, failing open."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The calling convention of extractors; others are reported as incompatible and not called.
PROTOCOL = 1
FACTS = ["kind", "subject", "level", "value", "detail", "label", "status"]
_OUT = "ledger_id {id}, row string, kind string, subject string, level int, value string, detail string, label string, status string, reason string, records bigint"

Extract = Callable[[str, pd.DataFrame], pd.DataFrame]
Identity = tuple[str, str, str]


class Extractor(NamedTuple):
    """extract(goal, evidence) takes the evidence rows of one ledger and returns rows of FACTS; a fact names its evidence by label.

    evidence_only: a ledger without facts still counts as matched, since answers are checked against
    the evidence alone.
    """

    name: str
    version: int
    keys: tuple[Identity, ...]
    extract: Extract
    protocol: int = PROTOCOL
    evidence_only: bool = False


class ExtractorRegistry:
    """Extractors by (library, system, edition); blanks around the parts do not count."""

    def __init__(self, extractors: list[Extractor] | None = None) -> None:
        self.by_key: dict[Identity, Extractor] = {}
        for extractor in extractors or []:
            self.register(extractor)

    def register(self, extractor: Extractor) -> None:
        """Refuses nameless extractors, versions below 1, empty or unstripped keys, and keys that are taken."""
        if not extractor.name.strip():
            raise ValueError("an extractor needs a name")
        if extractor.version < 1:
            raise ValueError("versions start at 1")
        if not extractor.keys:
            raise ValueError("an extractor needs a library identity")
        for key in extractor.keys:
            if len(key) != 3 or not all(key) or any(part != part.strip() for part in key):
                raise ValueError(f"a library identity has three stripped parts: {key}")
            if key in self.by_key:
                raise ValueError(f"there is an extractor for {key}")
        self.by_key.update({key: extractor for key in extractor.keys})

    def find(self, library: str | None, system: str | None, edition: str | None) -> Extractor | None:
        return self.by_key.get(tuple((part or "").strip() for part in (library, system, edition)))


def _evidence_problem(library: str | None, evidence: pd.DataFrame) -> str | None:
    names = evidence["document_id"].fillna("").str.strip()
    if evidence["label"].duplicated().any():
        return "labels repeat"
    if (names == "").any():
        return "a document has no id"
    if names.duplicated().any():
        return "documents repeat"
    return "evidence of another library" if (evidence["document_library"] != library).any() else None


def _facts_of(extractor: Extractor, goal: str, evidence: pd.DataFrame) -> pd.DataFrame:
    """What the extractor finds, checked: its columns, its references."""
    found = extractor.extract(goal, evidence)
    if not isinstance(found, pd.DataFrame):
        raise TypeError("an extractor returns a frame")
    found = found.reindex(columns=FACTS)
    labels = found["label"].dropna()
    needs = found["status"].isin(["known", "conflicting"]) & found["label"].isna()
    if not labels.isin(evidence["label"]).all() or needs.any():
        raise ValueError("a fact refers to no evidence")
    return found


def run_extractors(ledgers: DataFrame, evidence: DataFrame, registry: ExtractorRegistry) -> tuple[DataFrame, DataFrame]:
    """(facts, statuses) of all ledgers.

    ledgers(ledger_id, library_id, system, edition, goal), each once; evidence(ledger_id, label, title,
    content, document_id, document_library), what one answer has read. Every ledger is a group of its
    own and gets one status: unregistered, incompatible, build_failed (with the reason), no_facts or
    matched. An error inside an extractor fails its ledger only; its facts are dropped.
    """
    kind = dict(ledgers.dtypes)["ledger_id"]

    def build(ledger: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        columns = ["ledger_id", "row", *FACTS, "reason", "records"]
        if ledger.empty:
            return pd.DataFrame([], columns=columns)
        one = ledger.iloc[0]
        extractor = registry.find(one["library_id"], one["system"], one["edition"])
        facts, status, reason = pd.DataFrame([], columns=FACTS), "matched", None
        if extractor is None:
            status = "unregistered"
        elif extractor.protocol != PROTOCOL:
            status, reason = "incompatible", f"protocol {extractor.protocol}, expected {PROTOCOL}"
        elif problem := _evidence_problem(one["library_id"], rows):
            status, reason = "build_failed", problem
        elif rows.empty:
            status, reason = "no_facts", "no evidence"
        else:
            try:
                facts = _facts_of(extractor, one["goal"], rows.sort_values("label"))
            except Exception as error:  # noqa: BLE001 - whatever an extractor does must not stop the others
                status, reason = "build_failed", type(error).__name__
            else:
                if facts.empty and not extractor.evidence_only:
                    status, reason = "no_facts", "nothing found"
        out = facts.assign(row="fact", reason=None, records=None)
        end = pd.DataFrame([{"row": "status", "status": status, "reason": reason, "records": len(facts)}])
        made = pd.concat([out, end], ignore_index=True) if len(out) else end
        made["ledger_id"] = one["ledger_id"]
        made = made.reindex(columns=columns)
        texts = {c: made[c].astype(object).where(made[c].notna(), None) for c in ("row", *FACTS, "reason") if c != "level"}
        return made.assign(**texts).astype({"level": "Int32", "records": "Int64"})

    needed = ["ledger_id", "label", "title", "content", "document_id", "document_library"]
    names = ["ledger_id", "library_id", "system", "edition", "goal"]
    made = ledgers.select(*names).groupBy("ledger_id").cogroup(evidence.select(*needed).groupBy("ledger_id")).applyInPandas(build, _OUT.format(id=kind))
    facts = made.where(F.col("row") == "fact").select("ledger_id", *FACTS)
    statuses = made.where(F.col("row") == "status").select("ledger_id", "status", "reason", "records")
    return facts, statuses
