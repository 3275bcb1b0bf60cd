"""Fill-in-the-middle texts by secondary sort: pieces keyed by document and place, streamed into digests or texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
#: The parts in the order of the output, by form.
LAYOUT = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
#: The parts in the order of the text.
READING = ("prefix", "middle", "suffix")
#: Code points of a piece.
UNIT = 16_384
_BATCH_CHARS, _BATCH_ROWS = 1 << 21, 4_096
_KINDS = {"bigint": pa.int64(), "string": pa.string()}
_ABOUT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint"
_PIECES = f"row bigint, place bigint, piece string, {_ABOUT}"
_TURNED = f"{_PIECES}, output_sha256 string"


def form_of(doc_id: int | None, text: str) -> tuple[str, int, int]:
    """Form, end of the prefix and end of the middle, drawn from a hash of the id (a null id hashes as the empty string)."""
    digest = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(mark in text for mark in MARKS.values()) or h3 % 100 >= 90:
        return "plain", 0, 0
    units = len(text) + 1
    low, high = sorted((h1 % units, h2 % units))
    return ("spm" if h4 % 100 < 20 else "psm"), low, high


def cut_pieces(text: str, form: str, low: int, high: int, unit: int = UNIT) -> Iterator[str]:
    """The output in pieces of at most `unit` code points of text; a mark leads the first piece of its part."""
    ends = {"prefix": (0, low), "middle": (low, high), "suffix": (high, len(text))}
    for part in LAYOUT.get(form, ("",)):
        begin, end = ends.get(part, (0, len(text)))
        yield MARKS.get(part, "") + text[begin : min(end, begin + unit)]
        for at in range(begin + unit, end, unit):
            yield text[at : min(end, at + unit)]


class Restorer:
    """Finds the parts of an output that comes piece by piece; only two characters are held back, for marks across pieces.

    No mark stands in the texts of other forms than plain, and none can arise where texts and marks
    meet, as "<" occurs in a mark only at its start: the first find of the expected mark is the mark.
    """

    def __init__(self, form: str):
        self.due = list(LAYOUT.get(form, ()))
        self.rank, self.held, self.number = 0, "", 0

    def _placed(self, text: str) -> tuple[int, str]:
        self.number += 1
        return (self.rank << 48) + self.number, text

    def feed(self, piece: str) -> Iterator[tuple[int, str]]:
        """(place in the restored text, text) for what the piece settles."""
        self.held += piece
        while self.due and (at := self.held.find(MARKS[self.due[0]])) >= 0:
            if at:
                yield self._placed(self.held[:at])
            part = self.due.pop(0)
            self.held, self.rank = self.held[at + len(MARKS[part]) :], READING.index(part)
        settled = len(self.held) - 2 if self.due else len(self.held)
        if settled > 0:
            yield self._placed(self.held[:settled])
            self.held = self.held[settled:]

    def close(self) -> Iterator[tuple[int, str]]:
        if self.due:
            raise ValueError(f"no mark {MARKS[self.due[0]]} in the output")
        if self.held:
            yield self._placed(self.held)


def _batched(rows: Iterable[tuple], schema: str, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded text."""
    fields = [field.split() for field in schema.split(", ")]
    held, chars = [], 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, _KINDS[kind]) for x, (_, kind) in zip(zip(*held), fields)], [name for name, _ in fields])

    for row in rows:
        held.append(row)
        chars += size(row)
        if chars >= _BATCH_CHARS or len(held) >= _BATCH_ROWS:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one; values become Python objects only when their turn comes."""
    for batch in batches:
        columns = batch.columns
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in columns)


def fim_pieces(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """row, place, piece, doc_id, n, form, prefix_chars, middle_chars: the output of each document in pieces.

    row numbers the rows of the input, so repeated ids stay apart; what describes the document stands
    at its first piece only. A null text is empty; an empty one has a single empty piece.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            first = TaskContext.get().partitionId() << 33
            for number, (doc_id, text) in enumerate(_rows(batches)):
                text = text or ""
                form, low, high = form_of(doc_id, text)
                about = (doc_id, len(text), form, *((None, None) if form == "plain" else (low, high - low)))
                for place, piece in enumerate(cut_pieces(text, form, low, high, unit)):
                    yield first + number, place, piece, *(about if place == 0 else (None,) * 5)

        return _batched(rows(), _PIECES, lambda r: len(r[2]))

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES)


def in_order(pieces: DataFrame) -> DataFrame:
    """All pieces of a row in one partition, by place: `repartitionAndSortWithinPartitions` in the DataFrame interface.

    The sort spills to disk and the reader holds one piece, so neither a long document nor a large
    partition needs memory; rows are numbered, so no key is hot.
    """
    return pieces.repartition("row").sortWithinPartitions("row", "place")


def fim_texts(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: the whole output texts."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            about, parts = None, []
            for _, place, piece, *first in _rows(batches):
                if place == 0:
                    if about:
                        yield *about, "".join(parts)
                    about, parts = first, []
                parts.append(piece)
            if about:
                yield *about, "".join(parts)

        return _batched(rows(), f"{_ABOUT}, output string", lambda r: len(r[-1]))

    return in_order(fim_pieces(docs, unit)).mapInArrow(join, f"{_ABOUT}, output string")


def fim_digests(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    The pieces of a document stream in output order into one digest. The parts are found again in that
    stream by the marks alone and get their places in the text; the same partition, sorted anew by
    them, streams into the digest of the restored text. The texts are shuffled once: the second sort
    is inside the partitions.

    A null text counts as empty; a text that is empty or holds a mark is plain, with null
    prefix_chars and middle_chars. Repeated rows give a row each. An empty table gives no rows;
    other columns are ignored.
    """

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            row = about = digest = restorer = None

            def end() -> Iterator[tuple]:
                for where, text in restorer.close():
                    yield row, where, text, *(None,) * 6
                yield row, -1, "", *about, digest.hexdigest()

            for number, place, piece, *first in _rows(batches):
                if place == 0:
                    if about:
                        yield from end()
                    row, about, digest, restorer = number, first, sha256(), Restorer(first[2])
                digest.update(piece.encode())
                for where, text in restorer.feed(piece):
                    yield row, where, text, *(None,) * 6
            if about:
                yield from end()

        return _batched(rows(), _TURNED, lambda r: len(r[2]))

    schema = f"{_ABOUT}, output_sha256 string, restored_sha256 string"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            about = digest = None
            for _, place, piece, *first in _rows(batches):
                if place == -1:
                    if about:
                        yield *about, digest.hexdigest()
                    about, digest = first, sha256()
                digest.update(piece.encode())
            if about:
                yield *about, digest.hexdigest()

        return _batched(rows(), schema, lambda r: 200)

    turned = in_order(fim_pieces(docs, unit)).mapInArrow(turn, _TURNED)
    return turned.sortWithinPartitions("row", "place").mapInArrow(finish, schema)
