"""Document fingerprints from closed syncmers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import map_rows, texts_of

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the finisher of the public SplitMix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all windows of `size` code points, doubled up in log(size) vector steps."""
    done, power, width = None, 0, 1
    step, factor = codes.astype(np.uint64) + np.uint64(1), _BASE
    while True:
        if size & width:
            if done is None:
                done, power = step, width
            else:
                n = len(codes) - power - width + 1
                with np.errstate(over="ignore"):
                    done = step[:n] + factor * done[width : width + n]
                power += width
        width *= 2
        if width > size:
            return _mixed(done)
        half = width // 2
        with np.errstate(over="ignore"):
            step = step[: len(step) - half] + factor * step[half:]
            factor = factor * factor


def closed_syncmers(text: str, k: int = 12, s: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-mers (of code points) whose smallest inner s-mer is the first or the last one.

    Whether a k-mer is chosen depends on its own k characters only, so a change of the text moves
    anchors only within k characters of it. A text shorter than k has none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(codes) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inner = _rolling(codes, s)
    span = k - s + 1
    least, width = inner, 1
    while width < span:  # sliding minimum, doubled up
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[span - 1 :] == least))
    return at, _rolling(codes, k)[at]


def sketch(text: str, k: int = 12, s: int = 5, size: int = 128) -> str:
    """The fingerprint: the `size` smallest distinct 32-bit syncmer hashes in order, eight hex digits each.

    A text without syncmers (fewer than k code points, mostly) has one hash of the whole text, and an empty text none.
    """
    _, hashes = closed_syncmers(text, k, s)
    if not len(hashes):
        if not text:
            return ""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        hashes = _rolling(codes, len(codes))
    small = np.unique((_mixed(hashes) >> np.uint64(32)).astype(np.uint32))[:size]
    return small.astype(">u4").tobytes().hex()


def likeness(a: str, b: str, size: int = 128) -> float:
    """Estimated share of common syncmers (Jaccard) from two fingerprints: exact for texts with up to `size` syncmers together."""
    if a == b:
        return 1.0
    x, y = ({f[i : i + 8] for i in range(0, len(f), 8)} for f in (a, b))
    lowest = sorted(x | y)[:size]
    return sum(h in x and h in y for h in lowest) / len(lowest)


def fingerprints(docs: DataFrame, k: int = 12, s: int = 5, size: int = 128) -> DataFrame:
    """doc_id, fingerprint of whole texts; null and empty texts have the empty fingerprint, equal texts equal ones."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array([sketch(x, k, s, size) for x in texts_of(batch.column(1))], pa.string())], ["doc_id", "fingerprint"])

    return map_rows(docs, ["doc_id", "text"], run, "doc_id bigint, fingerprint string")


#: Ranges of ids at most: their starts are all that the driver holds.
MAX_RANGES = 65_536


def with_next(docs: DataFrame, share_rows: int = 5_000) -> DataFrame:
    """doc_id, text, next_text (the text of the next doc_id; after the last, of the first), by one range shuffle of the texts.

    Ids of the table itself, drawn by a hash, are the starts of ranges of about `share_rows` rows (more
    where that would be over MAX_RANGES). The documents with these ids (one per range) are sent a
    second time, as the last row of the range before, and all neighbours then stand in one sorted
    partition, read as a stream. Ids of any size are kept exactly. Of equal ids the one with the
    smaller text comes first. Rows without an id have no place in the order and no next text.
    """
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = placed.where(F.col("doc_id").isNotNull())
    lost = placed.where(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("string").alias("next_text"))
    rows, lowest = ordered.agg(F.count("*"), F.min("doc_id")).first()
    if not rows:
        return lost
    share = max(share_rows, -(-rows // MAX_RANGES))
    drawn = ordered.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("doc_id").distinct().collect()
    starts = np.array(sorted({lowest, *(r[0] for r in drawn)}), np.int64)
    schema = "range int, guest boolean, doc_id bigint, text string"

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy()
        at = np.searchsorted(starts, ids, side="right") - 1
        heads = np.flatnonzero(starts[at] == ids)
        twice = batch.take(pa.array(np.r_[np.arange(len(ids)), heads]))
        to = np.r_[at, (at[heads] - 1) % len(starts)].astype(np.int32)
        guest = np.r_[np.zeros(len(ids), bool), np.ones(len(heads), bool)]
        return pa.record_batch([pa.array(to), pa.array(guest), *twice.columns], ["range", "guest", "doc_id", "text"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next one
        for batch in batches:
            out = []
            for where, guest, name, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if held is not None and held[0] == where:
                    out.append((*held[1:], text))
                held = None if guest else (where, name, text)
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))], ["doc_id", "text", "next_text"])

    dealt = map_rows(ordered, ["doc_id", "text"], deal, schema)
    sorted_ranges = dealt.repartitionByRange(len(starts), "range").sortWithinPartitions("range", "guest", "doc_id", "text")
    return sorted_ranges.mapInArrow(neighbours, "doc_id bigint, text string, next_text string").union(lost)


def compare_edited(docs: DataFrame, k: int = 12, s: int = 5, size: int = 128) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document by doc_id; near_edited and near_next are the likeness (0 to 1) of a
    document's fingerprint to the edited text's and to the next document's. Null texts count as
    empty; two empty fingerprints are alike (1), an empty one is like no other (0). Repeated ids
    follow each other by text. Rows without an id have n_chars and fingerprint, all else is null.
    A single document is its own next one. Other columns are ignored; an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        from hashlib import sha256

        out, last = [], ("", "")
        for text, following in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            own = last[1] if text == last[0] else sketch(text, k, s, size)  # the next text is often the next row
            if following is None:
                out.append((len(text), None, own, None, None, None))
                continue
            cut = len(text) // 4
            edited = text[: len(text) - cut] + following[:cut]
            mark, after = sketch(edited, k, s, size), sketch(following, k, s, size)
            last = (following, after)
            digest = sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((len(text), digest, own, mark, likeness(own, mark, size), likeness(own, after, size)))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.record_batch([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*out), kinds))], names)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_rows(with_next(docs), ["doc_id", "text", "next_text"], run, schema)
