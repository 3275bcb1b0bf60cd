"""How document filters interact: what each one removes in every order, alone, and together with the others."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The maximal runs of anything but ASCII space characters; a text starts and ends with at most one empty part."""
    return F.array_remove(F.split(text, SPACE, -1), "")


def too_short(text: Column) -> Column:
    return F.size(words(text)) < 50


def too_repetitive(text: Column) -> Column:
    return F.size(F.array_distinct(words(text))) * 100 < F.size(words(text)) * 65


def too_loud(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))) * 100 > F.char_length(text) * 5


def has_marks(text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Filters on the text alone, in the order of their bits; the filter on copies comes after them.
TEXT_FILTERS: dict[str, Callable[[Column], Column]] = {"A": too_short, "B": too_repetitive, "C": too_loud, "D": has_marks}
COPY_FILTER = "E"
#: Hashes of repeated texts that are broadcast at most, about 32 MB; more of them meet the texts by a shuffle.
BROADCAST_HASHES = 1_000_000


def later_copies(texts: DataFrame) -> DataFrame:
    """The rows whose text a smaller doc_id has as well: the existential self-join of (doc_id, body, ...).

    A first grouping of hashes leaves only rows whose hash occurs again. Up to a checked size these
    hashes are broadcast, and texts that stand alone are never shuffled. The other side of the left-semi join on hash, exact text and smaller doc_id
    is reduced to the smallest doc_id of each text before the shuffle, since any smaller one is a
    witness if and only if the smallest is: a row meets one witness, however many copies there are.
    A row without an id is nobody's witness and has none.
    """
    hashed = texts.withColumn("hash", F.xxhash64("body"))
    again = cut_lineage(hashed.groupBy("hash").agg(F.count("*").alias("rows")).where("rows > 1").select("hash"))
    copies = hashed.join(F.broadcast(again) if again.count() <= BROADCAST_HASHES else again, "hash", "left_semi")
    # Written out, so that the join reads both sides from shuffles of their own and can split a text with very many copies.
    first = cut_lineage(copies.groupBy(F.col("hash").alias("first_hash"), F.col("body").alias("first_body")).agg(F.min("doc_id").alias("first_id")))
    witness = (F.col("hash") == F.col("first_hash")) & (F.col("body") == F.col("first_body")) & (F.col("first_id") < F.col("doc_id"))
    return copies.join(first, witness, "left_semi").drop("hash")


def failures(docs: DataFrame, filters: dict[str, Callable[[Column], Column]] = TEXT_FILTERS) -> DataFrame:
    """doc_id, part, digest, mask, documents: the filters that rows fail, as bits in the filters' order, copies last.

    Ids that fail a text filter and ids of later copies are united and their bits put together by
    one grouping, which merges equal rows (same id, part and text) into a count before the shuffle.
    """
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("body"))
    key = ["doc_id", "part", F.sha2("body", 256).alias("digest")]
    bits = sum((F.when(fails(F.col("body")), 1 << n).otherwise(0) for n, fails in enumerate(filters.values())), F.lit(0))
    own = texts.select(*key, bits.alias("mask"), F.lit(1).alias("documents"))
    copies = later_copies(texts).select(*key, F.lit(1 << len(filters)).alias("mask"), F.lit(0).alias("documents"))
    return own.union(copies).groupBy("doc_id", "part", "digest").agg(F.bit_or("mask").alias("mask"), F.sum("documents").alias("documents"))


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] = TEXT_FILTERS, copy_filter: str = COPY_FILTER) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of what the step's filter does.

    docs: doc_id, text, source; labels: doc_id, quality, toxic. part is the source, null as the empty
    string; a null text is empty. kept counts the documents left after the step, removed those that it
    takes, redundant those that fail its filter but are gone already, unique_fails those that fail no
    other filter, good_lost and toxic_lost the removed ones with label quality or toxic 1, shapley the
    documents that its filter removes summed over all orders.

    Only counts per (part, combination of failed filters) are kept, at most 2^filters a part; all orders
    follow from them. A document that fails m filters is removed by each of them in orders! / m of all
    orders, as each is the first of the m equally often.

    Rows count one by one, repeated ids and equal rows too; labels count as 1 if any row of the id says
    so, rows without an id have none. No documents give no rows. Other columns are ignored.
    """
    letters = "".join([*filters, copy_filter])
    label = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    combinations = (
        failures(docs, filters)
        .join(label, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(*(F.sum(F.col("documents") * weight).alias(name) for name, weight in {"documents": F.lit(1), "good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))}.items()))
    )
    parts = combinations.groupBy("part").agg(F.collect_list(F.struct("mask", "documents", "good", "toxic")).alias("counts"))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    steps = parts.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    steps = steps.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"), "counts",
        sum((F.when(F.col("letter") == x, 1 << n).otherwise(0) for n, x in enumerate(letters)), F.lit(0)).alias("own"),
        sum((F.when(F.instr("filter_order", x) <= F.col("at"), 1 << n).otherwise(0) for n, x in enumerate(letters)), F.lit(0)).alias("before"),
    )
    own, before = F.col("own"), F.col("before")

    def total(condition: Callable[[Column], Column], value: Callable[[Column], Column] = lambda c: c["documents"]) -> Column:
        return F.aggregate("counts", F.lit(0).cast("bigint"), lambda acc, c: acc + F.when(condition(c["mask"]), value(c)).otherwise(F.lit(0).cast("bigint")))

    fails, gone = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) != 0)
    removed = lambda m: fails(m) & ~gone(m)
    return steps.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: c["documents"] * (F.lit(factorial(len(letters))) / F.bit_count(c["mask"])).cast("bigint")).alias("shapley"),
    )
