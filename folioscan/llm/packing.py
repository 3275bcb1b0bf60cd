"""Packing documents' tokens into sequences by bounded-space online best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.tokens import RANKS, VOCABULARY, Encoder


class OpenBins:
    """At most `most` open bins of `size`; a bit of one integer says for each free space whether an open bin has it.

    A piece goes to the bin with the least free space that holds it (the lowest set bit from its
    length on), else into a new bin. A full bin closes at once; over `most` open bins, the fullest
    one closes first (the lowest set bit). Each step is O(1) and the state is bounded.
    """

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.free_bits, self.open = 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.made = 0

    def _take(self, free: int) -> int:
        bins = self.bins[free]
        number = bins.pop()
        if not bins:
            self.free_bits ^= 1 << free
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece of 1 .. size tokens."""
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            number, free = self.made, self.size
            self.made += 1
        left = free - length
        if left:
            self.bins[left].append(number)
            self.free_bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
        return number, self.size - free


def cuts(total: int, size: int) -> np.ndarray:
    """Piece lengths of a document of `total` tokens: the first may be shorter than `size`, the others never are."""
    first = total % size or min(total, size)
    return np.array([first] + [size] * ((total - first) // size), np.int64)


def _stretches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `rows` or a little more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def token_pieces(docs: DataFrame, size: int, end_id: int, path: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32 bits); ids end with `end_id`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, ranks)
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(encoder.batch(batch.column(1))):
                data = memoryview(np.append(ids, np.uint32(end_id)).astype("<u4").tobytes())
                at = 0
                for number, many in enumerate(cuts(len(ids) + 1, size).tolist()):
                    of.append(k)
                    piece.append(number)
                    start.append(at)
                    length.append(many)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + many)]))
                    at += many
            yield pa.record_batch(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack_online(docs: DataFrame, size: int = 1024, end_id: int = 2, open_bins: int = 65_536, ahead: int = 65_536, path: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every text becomes its ids and `end_id`; null and empty texts are that one id. Texts of more than
    `size` ids are cut and lose nothing. Only pieces' lengths are shuffled, never texts or ids: they
    are dealt by a hash of the piece, ordered, and each task packs its share online with `open_bins`
    bins, so copies, hot sources and long texts spread evenly. The stream of pieces is looked at
    `ahead` pieces at a time, and the longer ones of such a stretch are placed first. Adaptive
    execution sizes the shares in bytes: a share wastes at most its last open bins. Equal rows are packed one by one; a null
    doc_id stays null. An empty table gives no rows. Other columns of `docs` are ignored.
    """
    pieces = token_pieces(docs, size, end_id, path, ranks)
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, share = OpenBins(size, open_bins), TaskContext.get().partitionId() << 40
        for stretch in _stretches(batches, ahead):
            lengths = stretch.column(3).to_numpy()
            placed = np.zeros((len(lengths), 2), np.int64)
            for k in np.argsort(-lengths, kind="stable").tolist():
                placed[k] = bins.place(int(lengths[k]))
            yield pa.record_batch([*stretch.columns, pa.array(placed[:, 0] + share), pa.array(placed[:, 1].copy())], [*columns, "sequence_id", "offset"])

    dealt = pieces.repartition(F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(F.xxhash64("doc_id", "ids_crc32", "piece"), *columns)
    return dealt.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
