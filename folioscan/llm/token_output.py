"""Packed token ids as binary rows: best-fit-decreasing packing with a segment tree over capacities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from folioscan.llm.tokens import RANKS, VOCABULARY, Encoder, flat_runs

#: Ids that one round of packing holds in memory at most (one longer text apart).
WINDOW = 4_000_000


class Capacities:
    """A segment tree over free spaces 0 .. size: an inner node holds the largest free space below it that some bin has."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _set(self, free: int, value: int) -> None:
        node = self.leaves + free
        self.tree[node] = value
        while node > 1:
            node >>= 1
            top = max(self.tree[2 * node], self.tree[2 * node + 1])
            if self.tree[node] == top:
                break
            self.tree[node] = top

    def add(self, free: int, number: int) -> None:
        if free:
            if not self.bins[free]:
                self._set(free, free)
            self.bins[free].append(number)

    def take(self, length: int) -> tuple[int, int] | None:
        """The bin with the least free space of `length` or more, as (free space, bin), or None."""
        if self.tree[1] < length:
            return None
        node = 1
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] >= length else 2 * node + 1
        free = node - self.leaves
        number = self.bins[free].pop()
        if not self.bins[free]:
            self._set(free, 0)
        return free, number


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece of 1 .. size ids, longest first, and the number of bins."""
    tree, made = Capacities(size), 0
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        free, at = tree.take(length) or (size, -1)
        if at < 0:
            at, made = made, made + 1
        number[k], offset[k] = at, size - free
        tree.add(free - length, at)
    return number, offset, made


def packed_rows(docs: DataFrame, size: int = 2048, end_id: int = 50256, pad_id: int = 50256, window: int = WINDOW, path: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """Rows of packed id matrices: sequence_id, n_tokens, input_ids, cu_seqlens, position_ids, segments.

    input_ids is one matrix row: `size` little-endian unsigned 16-bit ids, padded with `pad_id`;
    cu_seqlens has the cumulative segment lengths from 0 on; position_ids (16 bits each) start again
    at 0 in every segment and in the padding; segments names doc_id, start (the document's ids
    before it), length and row (a number of the input row) in the row's order. A text is its ids and `end_id`; null and empty texts
    are that one id; longer texts are cut every `size` ids and lose nothing. Each task packs its own
    rows in windows of `window` ids, so nothing is shuffled and memory is bounded. Repeated rows are
    packed one by one; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
    Ids that do not fit 16 bits are an error.
    """
    if size > 65535:
        raise ValueError("positions are written in 16 bits")
    segment = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("row", pa.int64())])

    def pack(ids: list[np.ndarray], names: list[int | None], number_of: list[int], first: int) -> Iterator[pa.RecordBatch]:
        totals = np.array([len(x) for x in ids], np.int64)
        counts = -(-totals // size)
        of = np.repeat(np.arange(len(ids)), counts)
        start = (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * size
        length = np.minimum(size, totals[of] - start)
        number, offset, made = best_fit_decreasing(length, size)
        order = np.lexsort((offset, number))
        of, start, length, number, offset = (x[order] for x in (of, start, length, number, offset))
        pool = np.concatenate(ids)
        source = flat_runs((np.cumsum(totals) - totals)[of] + start, length)
        target = flat_runs(number * size + offset, length)
        rows, places = np.full(made * size, pad_id, "<u2"), np.zeros(made * size, "<u2")
        rows[target] = pool[source]
        places[target] = flat_runs(np.zeros(len(length), np.int64), length)
        bounds = np.searchsorted(number, np.arange(made + 1))
        used = np.add.reduceat(length, bounds[:-1])
        for k in np.flatnonzero(used < size):
            places[k * size + used[k] : (k + 1) * size] = np.arange(size - used[k])
        data, where = rows.tobytes(), places.tobytes()
        sums = [np.r_[0, np.cumsum(length[a:b])] for a, b in zip(bounds[:-1], bounds[1:])]
        parts = pa.StructArray.from_arrays(
            [pa.array([names[k] for k in of], pa.int64()), pa.array(start), pa.array(length.astype(np.int32)), pa.array(np.array(number_of, np.int64)[of])], fields=list(segment)
        )
        yield pa.record_batch(
            [
                pa.array(first + np.arange(made)),
                pa.array(used),
                pa.array([data[2 * size * k : 2 * size * (k + 1)] for k in range(made)], pa.binary()),
                pa.array(sums, pa.list_(pa.int32())),
                pa.array([where[2 * size * k : 2 * size * (k + 1)] for k in range(made)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), parts),
            ],
            ["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "segments"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made = Encoder(path, ranks), TaskContext.get().partitionId() << 40
        held, names, numbers, many, row = [], [], [], 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), encoder.batch(batch.column(1))):
                whole = np.append(ids, np.uint32(end_id))
                if whole.max() > 65535:
                    raise ValueError(f"id {whole.max()} does not fit 16 bits")
                held.append(whole.astype(np.uint16))
                names.append(name)
                numbers.append(row)
                row += 1
                many += len(ids) + 1
                if many >= window:
                    for out in pack(held, names, numbers, made):
                        made += out.num_rows
                        yield out
                    held, names, numbers, many = [], [], [], 0
        if held:
            yield from pack(held, names, numbers, made)

    schema = (
        "sequence_id bigint, n_tokens bigint, input_ids binary, cu_seqlens array<int>, position_ids binary, "
        "segments array<struct<doc_id:bigint,start:bigint,length:int,row:bigint>>"
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write packed_rows(docs, **options) as Parquet: the input_ids of a file, one after the other, are one id matrix."""
    packed_rows(docs, **options).write.parquet(path)


def unpacked(rows: DataFrame, size: int = 2048) -> DataFrame:
    """The reverse of packed_rows: a row of doc_id, ids (with the end id) for each row that was packed; repeated and null ids stay apart."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, cu, segments in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids = np.frombuffer(data, "<u2").tolist()
                out += [(s["row"], s["doc_id"], s["start"], ids[a:b]) for s, a, b in zip(segments, cu, cu[1:])]
            yield pa.record_batch(
                [*(pa.array([x[k] for x in out], pa.int64()) for k in range(3)), pa.array([x[3] for x in out], pa.list_(pa.int32()))],
                ["row", "doc_id", "start", "ids"],
            )

    parts = rows.select("input_ids", "cu_seqlens", "segments").mapInArrow(run, "row bigint, doc_id bigint, start bigint, ids array<int>")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "ids"))), lambda x: x["ids"]))
    return parts.groupBy("row", "doc_id").agg(joined.alias("ids")).select("doc_id", "ids")
