"""Query expansion, heading-aware reranking and pruning of candidate hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.rules import RerankRules
from folioscan.functions.scale import settle
from folioscan.functions.text import compact, compact_each, contains_any, let, ngrams, nfkc, strip
from folioscan.schemas import conform

HEADING_BONUS = 0.012
FULL_BLOCK = 160.0
EMPTY = "array<string>"


def is_creation_query(query: Column, rules: RerankRules) -> Column:
    """Asks to create a character as a whole, not about one of its sub-topics."""
    return (
        contains_any(query, list(rules.creation_verbs))
        & contains_any(query, list(rules.creation_subjects))
        & ~contains_any(query, list(rules.creation_subtopics))
    )


def is_direct_lookup(query: Column, rules: RerankRules) -> Column:
    return ~F.regexp_like(query, F.lit(rules.lookup_exception)) & F.regexp_like(query, F.lit(rules.lookup))


def expand_queries(queries: DataFrame, rules: RerankRules = RerankRules()) -> DataFrame:
    """Add aliases of the alias keys a query contains, in rule order and without repeats.

    `retrieval_query` uses the expansion only behind a gate; `expanded` is
    always the expanded text, which heading matching needs.
    """
    norm = strip(nfkc(F.col("query")))
    groups = []
    for key, aliases in rules.aliases.items():
        options = F.array(*[F.lit(a) for a in aliases])
        groups.append(
            F.when(
                F.contains(F.col("_norm"), F.lit(key)),
                F.filter(options, lambda a: ~F.contains(F.col("_norm"), a)),
            ).otherwise(F.array().cast(EMPTY))
        )
    added = F.array_distinct(F.concat(*groups)) if groups else F.array().cast(EMPTY)
    gate = is_creation_query(F.col("query"), rules) | contains_any(
        F.col("query"), list(rules.expansion_gates)
    )
    return (
        queries.withColumn("_norm", norm)
        .withColumn("expanded", F.concat_ws(" ", F.col("_norm"), added))
        .withColumn("retrieval_query", F.when(gate, F.col("expanded")).otherwise(F.col("query")))
        .drop("_norm")
    )


def heading_units(compact_query: Column, components: Column) -> Column:
    """Distinct units of compact heading components that occur in a compact query.

    A whole component if it occurs, else the smallest of its longest occurring
    4-, 3- or 2-grams.
    """

    def unit(c: Column) -> Column:
        def gram(size: int) -> Column:
            return F.array_min(F.filter(ngrams(c, size), lambda g: F.contains(compact_query, g)))

        return F.coalesce(F.when(F.contains(compact_query, c), c), gram(4), gram(3), gram(2))

    picked = F.transform(F.filter(components, lambda c: c != ""), unit)
    return F.array_distinct(F.filter(picked, lambda u: u.isNotNull()))


def _pairs_entity_with_category(units: Column, categories: Column) -> Column:
    named = F.filter(
        units, lambda u: F.exists(categories, lambda c: F.contains(c, u) | F.contains(u, c))
    )
    return (F.size(named) > 0) & (F.size(units) > F.size(named))


def _score_units(units: Column, categories: Column) -> Column:
    return F.when(_pairs_entity_with_category(units, categories), F.size(units).cast("double")).otherwise(
        F.lit(0.0)
    )


def heading_features(docs: DataFrame) -> DataFrame:
    """Compact heading components per document, and per structural block where there are any."""
    docs = conform(docs)
    block_paths = F.flatten(
        F.transform(
            F.coalesce("structural_blocks", F.array().cast(dict(docs.dtypes)["structural_blocks"])),
            lambda b: F.coalesce(b["heading_path"], F.array().cast(EMPTY)),
        )
    )
    own = F.concat(
        block_paths,
        F.coalesce("heading_path", F.array().cast(EMPTY)),
        F.array("title"),
        F.split("full_path", " > "),
    )
    # One delimited text per block, so that a single fold serves all blocks.
    per_block = F.transform(
        "structural_blocks",
        lambda b: F.array_join(F.coalesce(b["heading_path"], F.array().cast(EMPTY)), "\u0002"),
    )
    with_text = docs.select(
        F.col("id").alias("doc_id"),
        F.array_distinct(F.filter(own, lambda v: v != "")).alias("components"),
        per_block.alias("block_paths"),
        F.transform(
            "structural_blocks", lambda b: F.length(F.coalesce(b["content"], F.lit("")))
        ).alias("block_lengths"),
    )
    compacted = F.split(
        F.regexp_replace(
            _fold_joined(F.array_join("block_paths", "\u0001")),
            r"[^a-z0-9\x{4e00}-\x{9fff}\x{0001}\x{0002}]+",
            "",
        ),
        "\u0001",
    )
    return settle(with_text).select(
        "doc_id",
        compact_each(F.col("components")).alias("components"),
        F.when(F.col("block_paths").isNotNull(), F.transform(compacted, lambda p: F.split(p, "\u0002"))).alias(
            "block_components"
        ),
        "block_lengths",
    )


def _fold_joined(col: Column) -> Column:
    from folioscan.functions.text import nfkc_casefold

    return nfkc_casefold(col)


def heading_scores(pairs: DataFrame, docs: DataFrame, queries: DataFrame, rules: RerankRules = RerankRules()) -> DataFrame:
    """Structure score of each (query, document) pair: heading match and creation heading."""
    categories = F.array(*[F.lit(c) for c in rules.categories])
    q = queries.select(
        "query_id",
        compact(F.col("expanded")).alias("compact_expanded"),
        is_creation_query(F.col("query"), rules).alias("creation"),
    )
    rows = pairs.join(q, "query_id").join(heading_features(docs), "doc_id")
    query = F.col("compact_expanded")
    best_block = F.array_max(
        F.transform(
            F.arrays_zip("block_components", "block_lengths"),
            lambda b: _score_units(heading_units(query, b["block_components"]), categories)
            * F.least(F.lit(1.0), b["block_lengths"] / F.lit(FULL_BLOCK)),
        )
    )
    flat = _score_units(heading_units(query, F.col("components")), categories)
    match = F.when(F.col("block_components").isNotNull(), F.coalesce(best_block, F.lit(0.0))).otherwise(flat)
    verbs = list(rules.creation_verbs)
    creation = F.when(
        F.col("creation") & F.exists("components", lambda c: contains_any(c, verbs)), F.lit(2.0)
    ).otherwise(F.lit(0.0))
    scored = rows.withColumn("structure", F.least(match, F.lit(5.0))).withColumn("creation_heading", creation)
    return settle(scored.drop("compact_expanded", "creation", "components", "block_components", "block_lengths"))


def bigram_coverage(compact_query: Column, compact_text: Column) -> Column:
    """Share of the query's distinct bigrams (single characters if short) found in a text."""

    def share(text: Column) -> Column:
        grams = F.array_distinct(
            F.when(F.length(compact_query) >= 4, ngrams(compact_query, 2)).otherwise(ngrams(compact_query, 1))
        )
        return F.size(F.filter(grams, lambda g: F.contains(text, g))) / F.size(grams)

    return F.when(
        (F.length(compact_query) > 0) & (F.length(compact_text) > 0), let(compact_text, share)
    ).otherwise(F.lit(0.0))


def heading_rerank(
    hits: DataFrame, docs: DataFrame, queries: DataFrame, rules: RerankRules = RerankRules(), bonus: float = HEADING_BONUS
) -> DataFrame:
    """Add the heading bonus and re-rank; ties keep their base rank (column `base_rank`)."""
    scored = heading_scores(hits.withColumnRenamed("rank", "base_rank"), docs, queries, rules).withColumn(
        "score", F.col("score") + bonus * (F.col("structure") + F.col("creation_heading"))
    )
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("base_rank").asc())
    return scored.withColumn("rank", F.row_number().over(order)).drop("creation_heading")


def direct_lookup_prune(reranked: DataFrame, queries: DataFrame, rules: RerankRules = RerankRules()) -> DataFrame:
    """For lookup questions with a structured hit, keep structured hits and covered leaders.

    Leaders are the first three base hits whose excerpt covers at least 0.3 of
    the query's bigrams. Needs `excerpt`, `base_rank` and `structure`.
    """
    q = queries.select(
        "query_id",
        is_direct_lookup(F.col("query"), rules).alias("lookup"),
        compact(F.col("query")).alias("compact_query"),
    )
    rows = reranked.join(q, "query_id").withColumn("_text", compact(F.col("excerpt")))
    any_structure = F.max("structure").over(Window.partitionBy("query_id")) > 0
    leader = (F.col("base_rank") <= 3) & (bigram_coverage(F.col("compact_query"), F.col("_text")) >= 0.3)
    kept = rows.withColumn("_any", any_structure).where(
        ~(F.col("lookup") & F.col("_any")) | (F.col("structure") > 0) | leader
    )
    order = Window.partitionBy("query_id").orderBy(F.col("rank").asc())
    return kept.withColumn("rank", F.row_number().over(order)).drop("lookup", "compact_query", "_text", "_any")
