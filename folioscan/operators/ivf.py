"""Approximate cosine search with a stored inverted file of vector lists.

Unit vectors are clustered on a bounded sample (spherical k-means); every vector goes to the list
of its nearest centre and is written partitioned by list. A question probes the lists of its
nearest centres and scores their vectors exactly. How many lists reach a wanted recall depends on
the data, so it is measured when the index is written: stored vectors, drawn by hash and at most
`TRIALS`, are searched exactly, and the smallest number of lists that holds the wanted share of
their neighbours is kept with the index. A long list is stored in parts of bounded size, each
scored as its own group, so a list that holds a third of all vectors is many tasks. Questions that
find fewer than k vectors in their lists are searched exactly instead.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.operators.vectors import _scorer, _unit_rows, nearest_children
from folioscan.session import cut_lineage

#: Vectors that the centres are learnt from at most: those with the smallest hashes of their id.
SAMPLE = 65_536
#: Lists at most; the default number is the square root of the number of vectors.
MAX_LISTS = 1_024
#: Vectors of a list that one group scores.
PART_ROWS = 100_000
#: Stored vectors searched exactly to set the number of probed lists, the neighbours looked at, and the share of them wanted.
TRIALS, NEIGHBOURS, WANTED = 64, 100, 0.97
ROUNDS, SEED = 10, 11


@dataclass
class VectorLists:
    """A written inverted file: vectors by list and part, the centres, and the number of parts of each list."""

    path: str
    vectors: DataFrame
    parts: DataFrame
    centres: np.ndarray
    probes: int


def learn_centres(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centres of `lists` groups of unit vectors, from at most `sample` vectors drawn by a hash of chunk_id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = vectors.where(F.exists("embedding", lambda x: x != 0))
    rows = usable.count()
    lists = lists or min(MAX_LISTS, ceil(sqrt(rows)))
    drawn = usable.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1_000_000)) <= F.lit(ceil(1_200_000 * sample / rows))) if rows > sample else usable
    few = cut_lineage(drawn.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    if not rows:
        return np.zeros((0, 0))
    model = KMeans(k=max(2, lists), distanceMeasure="cosine", maxIter=ROUNDS, seed=SEED).fit(few)
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)


def probes_for(listed: DataFrame, centres: np.ndarray, wanted: float = WANTED, k: int = NEIGHBOURS, trials: int = TRIALS) -> int:
    """The smallest number of nearest lists that holds at least `wanted` of the k exact neighbours of the drawn vectors."""
    if len(centres) < 2:
        return 1
    drawn = listed.orderBy(F.xxhash64(F.lit("trial"), "chunk_id"), "chunk_id").limit(trials)
    drawn = cut_lineage(drawn.select(F.col("chunk_id").alias("query_id"), "embedding"))
    places = probed_lists(drawn, centres, len(centres)).select("query_id", "list", "place")
    near = nearest_children(drawn, listed, k).select("query_id", "chunk_id").join(listed.select("chunk_id", "list"), "chunk_id")
    counts = near.join(places, ["query_id", "list"]).groupBy("place").count().collect()  # at most one row a list
    held = np.zeros(len(centres))
    for r in counts:
        held[r["place"]] = r["count"]
    return int(np.searchsorted(np.cumsum(held), wanted * held.sum() - 1e-9) + 1)


def write_lists(
    vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, part_rows: int = PART_ROWS, wanted: float = WANTED
) -> VectorLists:
    """Write every vector of (chunk_id, embedding, source_id, ...) under its list, then the centres; open the result."""
    centres = learn_centres(vectors, lists, sample)
    kept = [c for c in ("chunk_id", "source_id", "embedding") if c in vectors.columns]
    schema = ", ".join(f"{n} {t}" for n, t in vectors.select(*kept).dtypes) + ", list int"

    def assign(batches):
        for batch in batches:
            if len(batch):
                near = np.argmax(_unit_rows(batch["embedding"]) @ centres.T, axis=1) if len(centres) else np.zeros(len(batch))
                yield batch.assign(list=near.astype(np.int32))

    listed = vectors.select(*kept).mapInPandas(assign, schema)
    listed = cut_lineage(listed)
    parts = listed.groupBy("list").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    dealt = listed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).drop("parts")
    dealt.repartition("list", "part").sortWithinPartitions("list", "part", "chunk_id").write.partitionBy("list").parquet(f"{path}/vectors")
    dealt.limit(0).write.parquet(f"{path}/shape")  # of no vectors no list is written
    spark = vectors.sparkSession
    parts.coalesce(1).write.parquet(f"{path}/parts")
    probes = probes_for(listed, centres, wanted)
    rows = [(k, [float(x) for x in c], probes) for k, c in enumerate(centres)]
    spark.createDataFrame(rows, "list int, centre array<double>, probes int").coalesce(1).write.parquet(f"{path}/centres")
    return read_lists(spark, path)


def read_lists(spark: SparkSession, path: str) -> VectorLists:
    """Open a written inverted file; the centres come last, so an aborted build cannot be opened."""
    centres = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # at most MAX_LISTS rows
    matrix = np.array([r.centre for r in centres]) if centres else np.zeros((0, 0))
    vectors = spark.read.schema(spark.read.parquet(f"{path}/shape").schema).parquet(f"{path}/vectors")
    return VectorLists(path, vectors, spark.read.parquet(f"{path}/parts"), matrix, centres[0].probes if centres else 1)


def probed_lists(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(query_id, embedding, list, place) for the `probes` nearest centres of each question; place counts from 0."""
    schema = ", ".join(f"{n} {t}" for n, t in queries.select("query_id", "embedding").dtypes) + ", list int, place int"

    def probe(batches):
        for batch in batches:
            if len(batch) and len(centres):
                order = np.argsort(-(_unit_rows(batch["embedding"]) @ centres.T), axis=1, kind="stable")[:, :probes]
                wide = batch.loc[batch.index.repeat(order.shape[1])]
                yield wide.assign(list=order.ravel().astype(np.int32), place=np.tile(np.arange(order.shape[1], dtype=np.int32), len(batch)))

    return queries.select("query_id", "embedding").mapInPandas(probe, schema)


def nearest_children_approx(queries: DataFrame, index: VectorLists, k: int = 100, probes: int | None = None, sources: list[str] | None = None) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): the best k of the probed lists; all vectors where those hold fewer than k."""
    stored = index.vectors.where(F.col("source_id").isin(sources)) if sources else index.vectors
    id_type, qid_type = dict(stored.dtypes)["chunk_id"], dict(queries.dtypes)["query_id"]
    schema = f"query_id {qid_type}, chunk_id {id_type}, similarity double"
    asked = cut_lineage(probed_lists(queries, index.centres, probes or index.probes).drop("place"))
    spread = asked.join(F.broadcast(index.parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def score(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "similarity": []})
        run = _scorer(q["query_id"].to_numpy(), _unit_rows(q["embedding"]), k)
        return pd.concat([p for s in range(0, len(v), 8192) for p in run(iter([v.iloc[s : s + 8192]]))])

    wanted = asked.select("list").distinct()
    pairs = stored.join(F.broadcast(wanted), "list", "left_semi").select("list", "part", "chunk_id", "embedding")
    found = spread.groupBy("list", "part").cogroup(pairs.groupBy("list", "part")).applyInPandas(score, schema)
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), F.col("chunk_id").asc())
    ranked = cut_lineage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    enough = ranked.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
    short = queries.join(enough, "query_id", "left_anti")
    return ranked.join(enough, "query_id", "left_semi").unionByName(nearest_children(short, stored, k))


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the exact (query_id, chunk_id) rows that were found; 1 for a question without any."""
    hit = found.select("query_id", "chunk_id").distinct().withColumn("hit", F.lit(1))
    return (
        exact.select("query_id", "chunk_id")
        .join(hit, ["query_id", "chunk_id"], "left")
        .groupBy("query_id")
        .agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    )
