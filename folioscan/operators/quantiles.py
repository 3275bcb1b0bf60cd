"""Exact nearest-rank percentiles that never gather a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.session import cut_lineage

#: Cells that a bracket is cut into at each step, and rows that a bracket may hold when it is ranked.
CELLS, FITS = 4_096, 65_536


def exact_percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float], fits: int = FITS) -> DataFrame:
    """One row per key with the value at rank max(1, ceil(p * n)) for each p.

    Selection by descent: each wanted rank has a bracket, at first all values of its key. A pass over
    the values counts those inside each bracket by equal cells, with partial sums before the shuffle;
    the cell that holds the rank, cut to its own smallest and largest value, is the next bracket. A
    bracket of one value is done; one of at most `fits` rows is ranked. So no task ever
    sorts more than that, whatever the distribution, and each pass narrows a bracket by the number of
    cells. The driver holds nothing but the number of open brackets.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    total = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    wanted = F.array(*[F.struct(F.lit(name).alias("stat"), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_n"))).alias("target")) for name, p in ps.items()])
    open_ = total.where("_n > 0").select(*keys, F.inline(wanted), "lo", "hi", F.col("_n").alias("inside"))
    ready, kind = None, dict(rows.dtypes)["_v"]
    by = [*keys, "stat"]
    while True:
        open_ = cut_lineage(open_)
        fit = open_.where((F.col("lo") == F.col("hi")) | (F.col("inside") <= fits))
        ready = fit if ready is None else ready.unionByName(fit)
        large = open_.where((F.col("lo") < F.col("hi")) & (F.col("inside") > fits))
        if large.isEmpty():
            break
        placed = (rows.join(large, keys) if keys else rows.crossJoin(F.broadcast(large))).where("_v between lo and hi")
        share = (F.col("_v").cast("double") - F.col("lo")) / (F.col("hi").cast("double") - F.col("lo"))
        cells = placed.groupBy(*by, "target", F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).alias("cell")).agg(
            F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
        )
        running = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hit = cells.withColumn("_upto", F.sum("c").over(running)).where("_upto >= target and _upto - c < target")
        open_ = hit.select(*by, (F.col("target") - F.col("_upto") + F.col("c")).alias("target"), F.col("lo").cast(kind), F.col("hi").cast(kind), F.col("c").alias("inside"))
    flat = ready.where("lo = hi").select(*by, F.col("lo").alias("_v"))
    found = flat.unionByName(_ranked(rows, ready.where("lo < hi"), keys))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("stat") == n, F.col("_v"))).alias(n) for n in ps])


def _ranked(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """The value at each bracket's rank, among the few values inside it, equal ones merged."""
    placed = (rows.join(brackets, keys) if keys else rows.crossJoin(F.broadcast(brackets))).where("_v between lo and hi")
    merged = placed.groupBy(*keys, "stat", "target", "_v").agg(F.count("*").alias("_c"))
    running = Window.partitionBy(*keys, "stat").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = merged.withColumn("_upto", F.sum("_c").over(running)).where("_upto >= target")
    return hit.groupBy(*keys, "stat").agg(F.min("_v").alias("_v"))
