"""Near-duplicate embeddings: a subspace pigeonhole join over rotated vectors, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import local_roots
from folioscan.llm.components import components
from folioscan.session import cut_lineage

#: Rows of a cell that are held against one another at once; larger cells are dealt into chunks, of which each pair is one unit.
CELL_ROWS = 512


def unit_vectors(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def rotated(units: np.ndarray, seed: int) -> np.ndarray:
    """A random rotation: signs, a shuffle and a Hadamard transform, over the next power of two dimensions.

    Only sums of pairs, so a vector's result does not depend on the rows beside it.
    """
    width = 1 << max(0, units.shape[1] - 1).bit_length()
    draw = np.random.default_rng(seed)
    out = np.zeros((len(units), width))
    out[:, : units.shape[1]] = units
    out = (out * draw.choice((-1.0, 1.0), width))[:, draw.permutation(width)]
    step = 1
    while step < width:
        pair = out.reshape(len(out), -1, 2, step)
        out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(out), width)
        step *= 2
    return out / np.sqrt(width)


def touched_cells(block: np.ndarray, width: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and cells of the grid of `width` that the ball of squared radius `reach` round each row of a block
    touches: its own cell, and those after it in the order of cells (a pair meets in the cell of its later row)."""
    home = np.floor(block / width).astype(np.int64)
    low = block - home * width
    row, spent, moved = np.arange(len(block)), np.zeros(len(block)), np.zeros((len(block), 0), np.int64)
    sign = np.zeros(len(block), np.int64)  # of the first dimension that moves
    for d in range(block.shape[1]):
        parts = [(row, spent, sign, moved, 0)]
        for step, gap in ((-1, low[row, d]), (1, width - low[row, d])):
            cost = spent + gap * gap
            near = (cost <= reach) & ((sign > 0) | ((sign == 0) & (step > 0)))
            parts.append((row[near], cost[near], np.where(sign[near] == 0, step, sign[near]), moved[near], step))
        moved = np.concatenate([np.column_stack([m, np.full(len(m), s)]) for *_, m, s in parts])
        row, spent, sign = (np.concatenate([p[k] for p in parts]) for k in range(3))
    return row, home[row] + moved


def _block_distances(a: np.ndarray, b: np.ndarray, blocks: int) -> np.ndarray:
    """Squared distances of row pairs, by block; the same for a pair wherever it is computed."""
    return ((a - b) ** 2).reshape(len(a), blocks, -1).sum(axis=2)


def near_vectors(
    vectors: DataFrame, cosine: float = 0.98, block_width: int = 8, cell: float = 0.4, seed: int = 7, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, over pairs of equal label with at least that cosine.

    Unit vectors at cosine c are sqrt(2 - 2c) apart, so in one of the rotated vectors' blocks their
    squared distance is at most the block's share, by its dimensions, of 2 - 2c. Each block is range-
    joined on a grid: a vector goes to its own cell and to the later cells that its share's ball
    touches. Within a cell, pairs within the share are verified by their cosine in double precision,
    each pair only in the first block that finds it, and counted; a cell returns counts and a
    spanning set of links for its rows, never pairs. Equal vectors of a label are one row with a
    weight. A cell of more than `cell_rows` rows is dealt into chunks, of which each pair is a unit.

    Labels of any type are compared as they are. Null, zero and non-finite vectors, null labels, and vectors of other lengths than the one
    compared with link with nothing: n_links 0, component_id their own vec_id, kept. Equal rows of
    one vec_id are linked copies: each counts the other. A null vec_id gives a null component. An
    empty table gives no rows; other columns are ignored.
    """
    finite = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite
    everything = vectors.select("vec_id", "embedding", "label")
    good = everything.where(usable)
    copies = cut_lineage(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")))
    reach = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12

    def layout(dims: int) -> tuple[int, int, float]:
        width = 1 << max(0, dims - 1).bit_length()
        each = min(block_width, width)
        return width // each, each, reach * each / width

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begin = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes):
                which = np.flatnonzero(sizes == dims)
                turned = rotated(unit_vectors(flat[(begin[which][:, None] + np.arange(dims))]), seed)
                blocks, each, share = layout(int(dims))
                side = max(cell, 1.01 * np.sqrt(share))
                for b in range(blocks):
                    row, grid = touched_cells(turned[:, b * each : (b + 1) * each], side, share * (1 + 1e-9) + 1e-15)
                    home = np.floor(turned[row, b * each : (b + 1) * each] / side).astype(np.int64)
                    own = (home == grid).all(axis=1)
                    for at in range(0, len(row), 20_000):
                        some = slice(at, at + 20_000)
                        taken = pa.array(which[row[some]])
                        keys = pa.array([x.tobytes() for x in grid[some].astype("<i2")], pa.binary())
                        yield pa.record_batch(
                            [*(batch.column(k).take(taken) for k in range(4)), pa.array(np.full(len(taken), b, np.int32)), keys, pa.array(own[some])],
                            ["node", "embedding", "label", "weight", "block", "cell", "own"],
                        )

    kind, label = (dict(vectors.dtypes)[c] for c in ("embedding", "label"))
    spread = copies.select("node", "embedding", "label", "weight").mapInArrow(
        cells, f"node bigint, embedding {kind}, label {label}, weight bigint, block int, cell binary, own boolean"
    )
    spread = spread.select("node", "embedding", "label", "weight", "block", "own", F.xxhash64("label", "block", "cell", F.size("embedding")).alias("cell"))
    sizes = spread.groupBy("cell").agg(F.count("*").alias("rows"), F.count_if("own").alias("owners"))
    crowded = cut_lineage(sizes.where("rows > 1 and owners > 0"))  # a cell of one row, or of none but guests, has no pair
    sized = spread.join(crowded, "cell").withColumn("chunks", F.ceil(F.col("rows") / cell_rows).cast("int"))
    dealt = sized.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    units = pairs.select(
        F.struct("cell", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")).alias("unit"),
        "node", "embedding", "label", "weight", "block", "own", "chunk",
    )

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            low, high = unit.column("low")[0].as_py(), unit.column("high")[0].as_py()
            dims = len(unit.column("embedding")[0])
            rows = unit.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            units_, own = unit_vectors(rows), unit.column("own").to_numpy()
            blocks, each, share = layout(dims)
            b = unit.column("block")[0].as_py()
            turned = rotated(units_, seed)
            part = turned[:, b * each : (b + 1) * each]
            node, weight, chunk = (unit.column(c).to_numpy() for c in ("node", "weight", "chunk"))
            same = unit.column("label").combine_chunks().dictionary_encode().indices.to_numpy()  # cells are hashes, labels are compared
            counts, left, right = np.zeros(len(rows), np.int64), [], []
            square = (part * part).sum(axis=1)
            for at in range(0, len(rows), 256):
                mine = slice(at, min(at + 256, len(rows)))
                near = square[mine, None] + square[None, :] - 2 * part[mine] @ part.T <= share + 1e-9
                i, j = np.nonzero(near)
                i += at
                # one order of the pair, not both guests, and the two chunks of this unit
                ok = (i < j) & (same[i] == same[j]) & (own[i] | own[j]) & ((chunk[i] != chunk[j]) if low != high else True)
                i, j = i[ok], j[ok]
                for begin in range(0, len(i), 20_000):
                    x, y = i[begin : begin + 20_000], j[begin : begin + 20_000]
                    found = _block_distances(turned[x], turned[y], blocks) <= share
                    first = found[:, b] & ~found[:, :b].any(axis=1)
                    x, y = x[first], y[first]
                    cos = (rows[x] * rows[y]).sum(axis=1) / np.sqrt((rows[x] ** 2).sum(axis=1) * (rows[y] ** 2).sum(axis=1))
                    link = cos >= cosine
                    x, y = x[link], y[link]
                    np.add.at(counts, x, weight[y])
                    np.add.at(counts, y, weight[x])
                    left.append(x)
                    right.append(y)
            if left and sum(map(len, left)):
                roots = local_roots(len(rows), np.concatenate(left), np.concatenate(right))
                some = np.flatnonzero(counts)
                yield pa.record_batch([pa.array(node[some]), pa.array(counts[some]), pa.array(node[roots[some]])], ["node", "links", "root"])

    found = (
        units.select("unit.*", "node", "embedding", "label", "weight", "block", "own", "chunk")
        .repartition("cell", "low", "high")
        .sortWithinPartitions("cell", "low", "high", "node")
        .mapInArrow(verified, "node bigint, links bigint, root bigint")
    )
    found = cut_lineage(found)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # a vector's copies link with one another and with all that the shared row links with
    of_copy = cut_lineage(
        copies.join(counts, "node", "left")
        .join(groups, "node", "left")
        .select(
            "label", "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    linked = good.join(of_copy, ["label", "embedding"])
    alone = everything.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (
        linked.select("vec_id", "n_links", "component_id")
        .union(alone)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of equal (cell, low, high) in sorted rows; a run may go over several batches."""
    held: list[pa.Table] = []
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        whole = pa.Table.from_batches([batch])
        bounds = [0, *edges.tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            piece = whole.slice(a, b - a)
            if held and any(held[-1].column(k)[0] != piece.column(k)[0] for k in range(3)):
                yield pa.concat_tables(held)
                held = []
            held.append(piece)
    if held:
        yield pa.concat_tables(held)
