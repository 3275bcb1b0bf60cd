"""Exact top-k search by inner product through a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import map_rows
from folioscan.session import cut_lineage, ensure_checkpoint_dir

#: Cells of each dimension of the approximation; one byte holds up to 256.
CELLS = 64
#: Vectors whose quantiles set the cells: the classes with the smallest hashes, at most so many.
SAMPLE = 4_096
#: Vectors of an approximation block, blocks of a shard (one task's reading), query vectors of a block (about).
BLOCK, SHARD_BLOCKS, QUERY_BLOCK = 4_096, 64, 1_024
#: Largest absolute value of an integer component; products of 2,048 dimensions then fit a long.
LARGEST = 1 << 26


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, for vectors without null or non-finite ones.

    The column itself is null for the others: the optimizer may evaluate it before a filter that would drop them.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    small = F.forall("v", lambda x: F.abs(x) <= LARGEST)
    checked = F.when(F.col("v").isNull(), None).when(small, F.col("v").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component exceeds {LARGEST}")))
    known = vectors.select("vec_id", F.when(F.coalesce(finite, F.lit(False)), scaled).alias("v"))
    return known.select("vec_id", checked.alias("v")).where(F.col("v").isNotNull())


def vector_classes(rows: DataFrame, every: int, k: int) -> DataFrame:
    """node, v, ids, asked: each distinct vector once, with the k smallest vec_ids that have it.

    Equal vectors have equal scores and ties go to the smaller vec_id, so no other of its rows can be
    among the first k of any query. The limit acts in each task before the shuffle, so a vector that
    many rows share is no hot key. asked: a query row has the vector.
    """
    query = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    first = Window.partitionBy("v", "asked").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("asked", query).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
    by_id = F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("vec_id"))
    return (
        few.groupBy("v")
        .agg(F.slice(F.sort_array(F.collect_list(by_id)), 1, k)["vec_id"].alias("ids"), F.bool_or("asked").alias("asked"))
        .select(F.monotonically_increasing_id().alias("node"), "v", "ids", "asked")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _extent(classes: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest component of each dimension over all vectors: one row a task and dimension, then `dims` rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dims, LARGEST, np.int64), np.full(dims, -LARGEST, np.int64)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(0))
                low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
        yield pa.record_batch([pa.array(np.arange(dims)), pa.array(low), pa.array(high)], ["dim", "low", "high"])

    found = classes.select("v").mapInArrow(partial, "dim bigint, low bigint, high bigint").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = sorted(tuple(r) for r in found.collect())
    return np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)


def cell_borders(sample: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each dimension the starts of its cells but the first, and (dims, cells) lowest and highest components of a cell.

    Inner borders are quantiles of the sample; the outer cells reach to the extremes of all vectors.
    """
    dims = len(low)
    starts, floor, ceiling = [], np.zeros((dims, cells), np.int64), np.zeros((dims, cells), np.int64)
    for j in range(dims):
        inner = np.unique(np.quantile(sample[:, j], np.arange(1, cells) / cells, method="inverted_cdf")).astype(np.int64)
        inner = inner[(inner > low[j]) & (inner <= high[j])]
        starts.append(inner)
        floor[j, : len(inner) + 1] = np.r_[low[j], inner]
        ceiling[j, : len(inner) + 1] = np.r_[inner - 1, high[j]]
    return starts, floor, ceiling


def _approximations(classes: DataFrame, starts: list[np.ndarray], block: int) -> DataFrame:
    """The approximation file: blocks of `block` vectors, their nodes and one byte a component."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                v = _matrix(part.column(1))
                codes = np.stack([np.searchsorted(s, v[:, j], side="right") for j, s in enumerate(starts)], axis=1).astype(np.uint8)
                nodes = part.column(0).to_numpy().astype("<i8")
                yield pa.record_batch([pa.array([int(nodes[0])]), pa.array([nodes.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())], ["block", "nodes", "codes"])

    return classes.select("node", "v").mapInArrow(pack, "block bigint, nodes binary, codes binary")


def bounds(queries: np.ndarray, floor: np.ndarray, ceiling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds, doubled, of the inner products of integer queries with vectors known by their cells' extremes."""
    middle, half = (floor + ceiling).astype(np.float64).T, (ceiling - floor).astype(np.float64).T
    q = queries.astype(np.float64)
    centre, spread = q @ middle, np.abs(q) @ half
    largest = np.abs(q).max(initial=0) * max(np.abs(middle).max(initial=0), half.max(initial=0)) * q.shape[1]
    slack = 0.0 if largest < 2.0**52 else largest * 2.0**-48  # sums below 2^53 are exact in double precision
    return centre - spread - slack, centre + spread + slack


def _scan(floor: np.ndarray, ceiling: np.ndarray, k: int):
    """Bounds of all (query, vector) of a tile, block by block; a vector stays while its upper bound reaches the k-th best lower bound."""
    dims = len(floor)
    names = ["query", "node", "low", "high"]

    def tile(approximations: pa.Table, asked: pa.Table) -> pa.Table:
        if not approximations.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.float64())] * 2, names)
        vectors = _matrix(asked.column("v").combine_chunks())
        query = asked.column("node").to_numpy()
        best = np.full((len(query), k), -np.inf)
        found = []
        for nodes, codes in zip(approximations.column("nodes"), approximations.column("codes")):
            node = np.frombuffer(nodes.as_py(), "<i8")
            code = np.frombuffer(codes.as_py(), np.uint8).reshape(-1, dims)
            each = np.arange(dims)
            low, high = bounds(vectors, floor[each, code], ceiling[each, code])
            best = np.sort(np.partition(np.hstack([best, low]), -k, axis=1)[:, -k:], axis=1)
            i, j = np.nonzero(high >= best[:, :1])
            found.append((i, node[j], low[i, j], high[i, j]))
        i, node, low, high = (np.concatenate(x) for x in zip(*found))
        stay = high >= best[i, 0]
        return pa.table([pa.array(query[i[stay]]), pa.array(node[stay]), pa.array(low[stay]), pa.array(high[stay])], names)

    return tile


def _inner_products(pairs: DataFrame) -> DataFrame:
    """query, node, ids, score from the two integer vectors of a pair, in exact longs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (_matrix(batch.column(c)).astype(np.int64) for c in (3, 4))
        return pa.record_batch([*batch.columns[:3], pa.array((a * b).sum(axis=1))], ["query", "node", "ids", "score"])

    return map_rows(pairs, ["query", "node", "ids", "v", "asked_v"], run, "query bigint, node bigint, ids array<bigint>, score bigint")


def top_k_exact(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, cells: int = CELLS, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` the k other rows with the highest inner product.

    Components count as floor(scale * x), scores are exact, ties go to the smaller vec_id (null last).

    The vectors are written once, each distinct one as a row, and beside them their approximations: the
    number of a quantile cell for each component, one byte. Query blocks meet shards of approximations
    in tiles, which give lower and upper bounds; a vector stays a candidate of a query while its upper
    bound reaches the k-th best lower bound, in its tile and then over all tiles. Exact vectors are read
    in the order of the bounds: first the best k candidates of each query, whose k-th exact score is
    then the bar, and of the others those whose bound reaches it. What is never read lies below the bar.
    Approximations are copied once per block of queries and queries once per shard, exact vectors never.

    Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as
    filled up with zeros. Repeated rows of a query each give its ranks, and have each other as
    candidates. Components beyond 2^26 after scaling are an error. An empty table or one without query
    rows gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/va-file-{uuid4().hex}"
    rows = integer_vectors(vectors, scale)
    dims = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(dims) - F.size("v"))))
    more = k + 1  # a query row may be among the best of its own vector
    vector_classes(rows, every, more).write.parquet(f"{folder}/exact")
    exact = spark.read.parquet(f"{folder}/exact")
    sample = exact.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    low, high = _extent(exact, dims)
    starts, floor, ceiling = cell_borders(np.array([r[0] for r in sample], np.int64).reshape(-1, dims), low, high, cells) if sample else ([np.empty(0, np.int64)] * dims, *np.zeros((2, dims, cells), np.int64))
    _approximations(exact, starts, block).write.parquet(f"{folder}/cells")
    cell_blocks = spark.read.parquet(f"{folder}/cells")
    asked = exact.where("asked").select("node", "v")
    query_blocks, shards = max(1, -(-asked.count() // query_block)), max(1, -(-cell_blocks.count() // shard_blocks))

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = cell_blocks.select(F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int").alias("shard"), numbers(query_blocks).alias("part"), "nodes", "codes")
    right = asked.select(F.pmod(F.xxhash64("node"), F.lit(query_blocks)).cast("int").alias("part"), "node", "v").select(numbers(shards).alias("shard"), "*")
    tile = _scan(floor, ceiling, more)
    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(lambda a, b: tile(a, b), "query bigint, node bigint, low double, high double")
    by_query = Window.partitionBy("query")
    bar = F.max(F.when(F.col("at") == more, F.col("low"))).over(by_query)
    candidates = found.withColumn("at", F.row_number().over(by_query.orderBy(F.col("low").desc(), "node"))).withColumn("bar", bar)
    candidates = candidates.where(F.col("bar").isNull() | (F.col("high") >= F.col("bar")))
    candidates = cut_lineage(candidates.select("query", "node", "high", F.row_number().over(by_query.orderBy(F.col("high").desc(), "node")).alias("visit")))

    def read(some: DataFrame) -> DataFrame:
        own = asked.select(F.col("node").alias("query"), F.col("v").alias("asked_v"))
        return _inner_products(some.join(exact.select("node", "v", "ids"), "node").join(own, "query"))

    first = cut_lineage(read(candidates.where(F.col("visit") <= more)))
    bars = first.groupBy("query").agg(F.count("*").alias("read"), F.min("score").alias("bar")).where(F.col("read") == more)
    rest = candidates.where(F.col("visit") > more).join(bars, "query").where(F.col("high") >= 2 * F.col("bar"))
    scored = first.unionByName(read(rest))

    # the best rows of each asked vector, one more than asked for, then without the query's own row
    each = scored.select("query", "score", (F.col("query") == F.col("node")).alias("own"), F.explode("ids").alias("vec_id"))
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    best = each.withColumn("n", F.row_number().over(by_query.orderBy(*order))).where(F.col("n") <= more)
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", "own"))).alias("hits"))
    members = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    answers = members.join(asked, "v").join(lists.withColumnRenamed("query", "node"), "node").select("query_id", "hits")
    self_at = F.coalesce(F.get(F.filter("hits", lambda h: h["own"] & h["vec_id"].eqNullSafe(F.col("query_id"))), F.lit(0))["n"], F.lit(0))
    others = answers.withColumn("self_at", self_at).select("query_id", F.slice(F.filter("hits", lambda h: h["n"] != F.col("self_at")), 1, k).alias("hits"))
    return others.select("query_id", F.posexplode("hits")).select("query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", "col.score")
