"""A stored inverted index with block bounds, and exact top-k search that skips what cannot win.

Layout. Documents are dealt by id into blocks of about `BLOCK_DOCS` and numbered inside them; all
chunks of a document stay in one block. A row of `postings` holds what one term has in one block:
the chunks with frequency and length, and a summary of them (shortest chunk by frequency) from
which the largest contribution of the term in the block follows under any mean length, so later
statistics never make a stored bound wrong. The empty term lists all chunks. Each task writes the
blocks that it indexed as one segment sorted by term, so postings are never shuffled and a reader
skips the pages of a segment that hold other terms. `documents` holds one row per document with
what ranking needs. `manifest` is written last and names the input and the settings.

Search. The summaries alone give, for each question and block, a bound of every score in it. The
blocks with the highest bounds are scored first; the k-th best score there is the bar, and of the
other blocks only those whose bound reaches it are scored at all. A block is scored as a product of
two small matrices (questions x terms, terms x chunks) and cut to its own best k, so no table of
questions and chunks exists. What is skipped lies provably below the k-th score: the result is that
of the full scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions.rules import MarkerRules
from folioscan.functions.text import tokens
from folioscan.operators import markers
from folioscan.operators.chunks import chunk
from folioscan.operators.lexical import B, K1, TIE_DIGITS, query_terms, top_k
from folioscan.schemas import conform
from folioscan.session import cut_lineage

BLOCK_DOCS = 32
#: Up to this many question terms, the terms themselves are pushed down to the segments.
PICKED_TERMS = 256
#: Tokens that a task indexes at once: a block with more of them has several rows a term.
TOKENS_AT_ONCE = 2_000_000
#: Blocks that a question looks at before it has a bar.
FIRST_BLOCKS = 3
#: Questions and chunks that are multiplied at once.
QUESTION_TILE, CHUNK_TILE = 1_024, 2_048
#: Question terms are broadcast up to this many bytes, estimated from a count; beyond it joins shuffle.
BROADCAST_BYTES = 32 * 1024 * 1024
#: Scores are compared after rounding to TIE_DIGITS digits and summed in no fixed order.
SLACK = 1e-6
VERSION = 1
#: places: document number << 32 | chunk index; counts: frequency << 16 | chunk length in tokens.
_POSTINGS = """block int, ruleset_id string, term string, places array<bigint>, counts array<int>, n_chunks bigint,
  shortest_1 int, shortest_2 int, shortest_3 int, shortest_more int, max_tf int"""


@dataclass
class StoredIndex:
    """A written index and the documents it was made of (for excerpts only)."""

    path: str
    postings: DataFrame
    documents: DataFrame
    stats: DataFrame
    manifest: dict
    docs: DataFrame
    size: int
    overlap: int

    def chunks_of(self, wanted: DataFrame) -> DataFrame:
        """The chunks of the documents in `wanted`, cut anew from these documents only."""
        named = self.docs.join(wanted.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
        return chunk(named, self.size, self.overlap)


def input_digest(docs: DataFrame) -> str:
    """A digest of the input that changes with its rows: count and two sums of row hashes."""
    columns = [c for c in ("id", "ruleset_id", "source_id", "title", "full_path", "content", "priority") if c in docs.columns]
    row = docs.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64(*columns) % 1_000_000_007).alias("a"),
        F.sum(F.xxhash64(F.lit(1), *columns) % 998_244_353).alias("b"),
    ).first()
    return f"{row.n}-{row.a or 0}-{row.b or 0}"


def _placed(docs: DataFrame, blocks: int, digest: Column) -> DataFrame:
    """Documents with their block and their number inside it; the only shuffle of the texts.

    The number of partitions is given, since what follows costs far more than the bytes of the shuffle suggest.
    """
    spark = docs.sparkSession
    partitions = min(blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    block = F.pmod(F.xxhash64("ruleset_id", "id"), F.lit(blocks)).cast("int")
    inside = Window.partitionBy("block").orderBy("ruleset_id", "id", digest)
    return docs.withColumn("block", block).repartition(partitions, "block").withColumn("doc_no", F.row_number().over(inside))


def _indexed(blocks: pa.Table) -> pa.RecordBatch:
    """The postings of whole chunks (block, ruleset_id, doc_no, chunk_index, terms) of one block, by library and term."""
    n = blocks.num_rows
    lists = blocks.column("terms").combine_chunks()
    length = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    if n and length.max() > 0xFFFF:
        raise ValueError("a chunk has more than 65,535 tokens")
    coded = lists.flatten().dictionary_encode()
    library = blocks.column("ruleset_id").combine_chunks().dictionary_encode()
    of = library.indices.to_numpy().astype(np.int64)
    words = len(coded.dictionary) + 1  # one more for the empty term, which lists all chunks
    row = np.r_[np.repeat(np.arange(n), length), np.arange(n)]
    code = np.r_[coded.indices.to_numpy().astype(np.int64), np.full(n, words - 1)]
    key, tf = np.unique((of[row] * words + code) * n + row, return_counts=True)
    group, row = key // n, key % n
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    offsets = np.r_[starts, len(key)].astype(np.int32)
    doc, chunk_index = (blocks.column(c).to_numpy().astype(np.int64) for c in ("doc_no", "chunk_index"))

    def shortest(some: np.ndarray) -> pa.Array:
        least = np.minimum.reduceat(np.where(some, length[row], 1 << 30), starts)
        return pa.array(least.astype(np.int32), mask=least == 1 << 30)

    first = group[starts]
    terms = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([""])]).take(pa.array(first % words))
    return pa.record_batch(
        [
            pa.array(np.full(len(starts), blocks.column("block")[0].as_py(), np.int32)), library.dictionary.take(pa.array(first // words)), terms,
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(doc[row] << 32 | chunk_index[row])),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array((tf << 16 | length[row]).astype(np.int32))),
            pa.array(np.diff(offsets).astype(np.int64)), *(shortest(tf == k) for k in (1, 2, 3)), shortest(tf > 3),
            pa.array(np.maximum.reduceat(tf, starts).astype(np.int32)),
        ],
        [field.split()[0] for field in _POSTINGS.replace("\n", " ").split(", ")],
    )


def _index_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks come block by block; each block is indexed as it is complete, or when it holds very many tokens."""
    held: list[pa.Table] = []
    tokens = 0
    for batch in batches:
        block = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), batch.num_rows]
        whole = pa.Table.from_batches([batch])
        for a, b in zip(edges, edges[1:]):
            part = whole.slice(a, b - a)
            if held and (tokens >= TOKENS_AT_ONCE or held[0].column("block")[0] != part.column("block")[0]):
                yield _indexed(pa.concat_tables(held))
                held, tokens = [], 0
            if b > a:
                held.append(part)
                tokens += len(part.column("terms").combine_chunks().flatten())
    if held:
        yield _indexed(pa.concat_tables(held))


def write_index(
    docs: DataFrame,
    path: str,
    size: int = 500,
    overlap: int = 50,
    rules: MarkerRules = MarkerRules(),
    block_docs: int = BLOCK_DOCS,
    digest: str | None = None,
) -> StoredIndex:
    """Write the index of `docs` under `path` (which must not exist) and open it.

    The postings of a block are made where its texts already are. The manifest comes last, so an
    aborted build is never read.
    """
    digest = digest or input_digest(docs)
    blocks = max(1, ceil(int(digest.split("-")[0]) / block_docs))
    docs_ = conform(docs)
    placed = _placed(docs_, blocks, F.xxhash64("content"))
    # Chunks keep id and source_id of their document, so these two carry its number and its block.
    numbered = placed.withColumn("id", F.col("doc_no")).withColumn("source_id", F.col("block"))
    cut = chunk(numbered, size, overlap).select(
        F.col("source_id").alias("block"), "ruleset_id", F.col("doc_id").alias("doc_no"), "chunk_index", tokens(F.col("search_text")).alias("terms")
    )
    made = cut.mapInArrow(_index_blocks, _POSTINGS)
    made.sortWithinPartitions("ruleset_id", "term", "block").write.parquet(f"{path}/postings")
    # The flags come from the opening of each text, before any shuffle.
    name = F.struct("id", "ruleset_id", "source_id", F.xxhash64("content").alias("digest"))
    flags = markers.document_flags(docs_.withColumn("id", name), rules).select(
        "doc_id.*", F.col("priority").cast("int").alias("priority"), "is_reference", "is_favored", "is_multiclass",
        markers.text_key(F.col("compact_title")).alias("title_key"),
    )
    numbered = _placed(flags, blocks, F.col("digest")).withColumnRenamed("id", "doc_id").drop("digest")
    numbered.sortWithinPartitions("block", "doc_no").write.parquet(f"{path}/documents")
    spark = docs.sparkSession
    directory = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").where(F.col("term") == "")
    lengths = F.aggregate("counts", F.lit(0).cast("bigint"), lambda acc, c: acc + c.bitwiseAND(0xFFFF))
    stats = directory.select("ruleset_id", "n_chunks", lengths.alias("tokens")).groupBy("ruleset_id").agg(
        F.sum("n_chunks").alias("chunk_count"), F.greatest(F.sum("tokens") / F.sum("n_chunks"), F.lit(1.0)).alias("average_length")
    )
    stats.coalesce(1).write.parquet(f"{path}/stats")
    top = spark.read.parquet(f"{path}/documents").agg(F.max(F.greatest(F.lit(0), F.col("priority")))).first()[0] or 0
    about = {"version": VERSION, "digest": digest, "size": size, "overlap": overlap, "max_priority": top, "rules": str(rules)}
    kinds = "version int, digest string, size int, overlap int, max_priority int, rules string"
    spark.createDataFrame([tuple(about.values())], kinds).coalesce(1).write.parquet(f"{path}/manifest")
    return read_index(spark, path, docs)


def read_index(spark: SparkSession, path: str, docs: DataFrame, digest: str | None = None, rules: MarkerRules | None = None) -> StoredIndex:
    """Open a written index; one without a manifest, of another version, input or rules is refused."""
    found = spark.read.parquet(f"{path}/manifest").first()
    manifest = found.asDict()
    if manifest["version"] != VERSION:
        raise ValueError(f"index version {manifest['version']}, expected {VERSION}")
    if digest is not None and manifest["digest"] != digest:
        raise ValueError("the index was made of other documents")
    if rules is not None and manifest["rules"] != str(rules):
        raise ValueError("the index was made with other marker rules")
    postings = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")  # of an empty library no file is written
    documents, stats = spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/stats")
    return StoredIndex(path, postings, documents, stats, manifest, docs, manifest["size"], manifest["overlap"])


def impact(tf: Column, length: Column, k1: float = K1, b: float = B) -> Column:
    """What one occurrence count contributes, before the term's gain."""
    return tf / (tf + k1 * (1.0 - b + b * length / F.col("average_length")))


def _largest_impact() -> Column:
    by_tf = [F.coalesce(impact(F.lit(n), F.col(f"shortest_{n}")), F.lit(0.0)) for n in (1, 2, 3)]
    return F.greatest(*by_tf, F.coalesce(impact(F.col("max_tf"), F.col("shortest_more")), F.lit(0.0)))


def _small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast what a count has shown to be small; beyond that the join shuffles and splits skewed keys."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


@dataclass
class _Asked:
    """Question terms with gains and bounds, the block summaries of their terms, and the postings that may hold them."""

    terms: DataFrame
    headers: DataFrame
    postings: DataFrame
    rows: int


def _asked(queries: DataFrame, index: StoredIndex) -> _Asked:
    """Terms: query_id, ruleset_id, term, gain, df, top (largest contribution anywhere), average_length."""
    wanted = cut_lineage(query_terms(queries))
    rows = wanted.count()
    vocabulary = wanted.select("ruleset_id", "term").distinct()
    postings = index.postings
    if rows <= PICKED_TERMS:
        postings = postings.where(F.col("term").isin([r[0] for r in vocabulary.select("term").distinct().collect()]))
    summaries = ["ruleset_id", "term", "block", "n_chunks", "shortest_1", "shortest_2", "shortest_3", "shortest_more", "max_tf"]
    stats = F.broadcast(index.stats)  # one row a library
    headers = cut_lineage(
        postings.select(*summaries)
        .join(_small(vocabulary, rows, 64), ["ruleset_id", "term"], "left_semi")
        .join(stats, "ruleset_id")
        .select("ruleset_id", "term", "block", "n_chunks", "chunk_count", "average_length", _largest_impact().alias("impact"))
    )
    n, df = F.col("chunk_count"), F.col("df")
    of_term = headers.groupBy("ruleset_id", "term").agg(
        F.sum("n_chunks").alias("df"), F.max("impact").alias("impact"), F.any_value("chunk_count").alias("chunk_count"), F.any_value("average_length").alias("average_length")
    )
    gain = F.col("weight") * F.log(1.0 + (n - df + 0.5) / (df + 0.5)) * (K1 + 1.0)
    terms = wanted.join(of_term, ["ruleset_id", "term"]).select("query_id", "ruleset_id", "term", "df", "average_length", gain.alias("gain"), (gain * F.col("impact")).alias("top"))
    return _Asked(cut_lineage(terms), headers, postings, rows)


def _group_table(spark: SparkSession) -> np.ndarray:
    """The marker-group boost of `lexical_adjustment` by question flags (favored + 2 multiclass) and document flags."""
    rows = [(q, d, bool(q & 1), bool(q & 2), bool(d & 1), bool(d & 2)) for q in range(4) for d in range(4)]
    flags = spark.createDataFrame(rows, "q int, d int, favored_intent boolean, multiclass_intent boolean, is_favored boolean, is_multiclass boolean")
    blank = flags.withColumns({"priority": F.lit(0), "is_reference": F.lit(False), "query_key": F.lit("q"), "title_key": F.lit("t")})
    table = np.zeros((4, 4))
    for r in blank.select("q", "d", markers.lexical_adjustment().alias("boost")).collect():
        table[r.q, r.d] = r.boost
    return table


def _block_scorer(limit: int, groups: np.ndarray, query_type: pa.DataType, k1: float = K1, b: float = B):
    """Score one block: lists of its asked terms against its documents, cut to the best `limit` of each question.

    Documents titled like a question are always returned, as their boost is added later.
    """
    names = ["query_id", "block", "doc_no", "chunk_index", "match_score"]
    none = pa.table([pa.array([], t) for t in (query_type, pa.int32(), pa.int32(), pa.int32(), pa.float64())], names)

    def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.StructArray]:
        """Row number of each element of a list column, and the elements."""
        lists = column.combine_chunks()
        return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()

    def tile(rows, contribution, chunk, asker_rows, asker, gains, n_rows, n_chunks, n_questions):
        lists, wanted = np.zeros((n_rows, n_chunks)), np.zeros((n_questions, n_rows))
        lists[rows, chunk] = contribution
        wanted[asker, asker_rows] = gains
        return np.round(wanted @ lists, TIE_DIGITS)

    def score(lists: pa.Table, documents: pa.Table) -> pa.Table:
        if not lists.num_rows or not documents.num_rows:
            return none
        row, at = flat(lists.column("places"))
        place, counts = at.to_numpy(), flat(lists.column("counts"))[1].to_numpy()
        doc, tf, length = place >> 32, counts >> 16, counts & 0xFFFF
        mean = lists.column("average_length").to_numpy()[row]
        contribution = tf / (tf + k1 * (1.0 - b + b * length / mean))
        # One row per document; its questions are those that the block is open for.
        known = documents.column("doc_no").to_numpy()
        order = np.argsort(known)
        known = known[order]
        flags, lift = documents.column("flags").to_numpy()[order], np.maximum(0, documents.column("priority").to_numpy()[order]) / 10000.0
        titled_row, titled = flat(documents.column("titled").take(pa.array(order)))
        here = np.isin(doc, known)
        row, place, contribution = row[here], place[here], contribution[here]
        asker_row, who = flat(lists.column("askers"))
        open_to = documents.column("open")[0].values
        ids, gains, question_flags, bars = (who.field(n) for n in ("query_id", "gain", "flags", "bar"))
        stay = np.asarray(pa.compute.is_in(ids, value_set=open_to).to_numpy(zero_copy_only=False), bool)
        if not stay.any() or not len(row):
            return none
        asker_row, ids = asker_row[stay], ids.filter(pa.array(stay))
        coded = ids.dictionary_encode()
        asker, questions = coded.indices.to_numpy(), coded.dictionary
        gains = gains.to_numpy(zero_copy_only=False)[stay]
        of_question, bar = np.zeros(len(questions), np.int64), np.zeros(len(questions))
        of_question[asker] = question_flags.to_numpy(zero_copy_only=False)[stay]
        bar[asker] = bars.to_numpy(zero_copy_only=False)[stay]
        number = {q: n for n, q in enumerate(questions.to_pylist())}
        forced = np.zeros((len(known), len(questions)), bool)
        for d, q in zip(titled_row.tolist(), titled.to_pylist()):
            if q in number:
                forced[d, number[q]] = True
        place, chunk_of = np.unique(place, return_inverse=True)
        parts = []
        for c in range(0, len(place), CHUNK_TILE):
            end = min(c + CHUNK_TILE, len(place))
            mine = (chunk_of >= c) & (chunk_of < end)
            used, short = np.unique(row[mine], return_inverse=True)
            doc_of = np.searchsorted(known, place[c:end] >> 32)
            starts = np.flatnonzero(np.r_[True, doc_of[1:] != doc_of[:-1]])
            docs = doc_of[starts]
            sizes = np.diff(np.r_[starts, end - c])
            which = np.full(lists.num_rows, -1)
            which[used] = np.arange(len(used))
            for q in range(0, len(questions), QUESTION_TILE):
                last = min(q + QUESTION_TILE, len(questions))
                ask = (asker >= q) & (asker < last) & (which[asker_row] >= 0)
                s = tile(short, contribution[mine], chunk_of[mine] - c, which[asker_row[ask]], asker[ask] - q, gains[ask], len(used), end - c, last - q)
                best = np.maximum.reduceat(s, starts, axis=1)
                first = np.minimum.reduceat(np.where(s == np.repeat(best, sizes, axis=1), np.arange(end - c), end), starts, axis=1)
                final = np.where(best > 0, best + lift[docs] + groups[of_question[q:last, None], flags[docs]], -np.inf)
                cut = np.partition(final, -limit, axis=1)[:, -limit] if final.shape[1] > limit else np.full(last - q, -np.inf)
                i, j = np.nonzero((best > 0) & ((final >= np.maximum(cut, bar[q:last])[:, None] - SLACK) | forced[docs, q:last].T))
                parts.append((i + q, docs[j], place[c + first[i, j]] & 0xFFFFFFFF, best[i, j]))
        i, d, where, value = (np.concatenate(x) for x in zip(*parts))
        block = np.full(len(i), documents.column("block")[0].as_py(), np.int32)
        return pa.table([questions.take(pa.array(i)), pa.array(block), pa.array(known[d].astype(np.int32)), pa.array(where.astype(np.int32)), pa.array(value)], names)

    return score


def _score_blocks(asked: _Asked, askers: DataFrame, documents: DataFrame, open_pairs: DataFrame, titled: DataFrame, limit: int, groups: np.ndarray) -> DataFrame:
    """query_id, block, doc_no, chunk_index, match_score: each block's best documents for the questions it is open for."""
    query_type = dict(askers.select(F.explode("askers").alias("a")).select("a.query_id").dtypes)["query_id"]
    open_to = open_pairs.groupBy("block").agg(F.collect_set("query_id").alias("open"))
    lists = asked.postings.select("ruleset_id", "term", "block", "places", "counts").join(_small(askers, asked.rows, 96), ["ruleset_id", "term"])
    open_blocks = cut_lineage(open_to.select("block"))
    lists = lists.join(_small(open_blocks, open_blocks.count(), 16), "block", "left_semi").select("block", "places", "counts", "average_length", "askers")
    by_title = titled.groupBy("block", "doc_no").agg(F.collect_set("query_id").alias("titled"))
    side = documents.join(open_to, "block").join(by_title, ["block", "doc_no"], "left").select(
        "block", "doc_no", "priority", (F.col("is_favored").cast("int") + 2 * F.col("is_multiclass").cast("int")).alias("flags"),
        "open", F.coalesce("titled", F.array().cast(f"array<{query_type}>")).alias("titled"),
    )
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[query_type]
    kernel = _block_scorer(limit, groups, arrow)
    schema = f"query_id {query_type}, block int, doc_no int, chunk_index int, match_score double"
    return lists.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(lambda a, b: kernel(a, b), schema)


def search_index(
    queries: DataFrame, index: StoredIndex, limit: int, sources: list[str] | None = None, rules: MarkerRules = MarkerRules(), first_blocks: int = FIRST_BLOCKS
) -> DataFrame:
    """query_id, doc_id, chunk_index, match_score, score, rank: BM25 of the best chunk plus boosts, the first `limit` per question.

    Statistics come from the whole library; `sources` restricts the candidates only. Equal scores are
    ranked by doc_id. Question ids are whole numbers or strings, each once.
    """
    if index.manifest["rules"] != str(rules):
        raise ValueError("the index was made with other marker rules")
    asked, groups = _asked(queries, index), _group_table(queries.sparkSession)
    query_side = cut_lineage(
        markers.query_flags(queries, rules)
        .select("query_id", "multiclass_intent", "favored_intent", markers.text_key(F.col("compact_query")).alias("query_key"))
        .join(queries.select("query_id", "ruleset_id"), "query_id")
    )
    documents = index.documents.where(F.col("source_id").isin(sources)) if sources else index.documents
    same = (F.col("query_key") == F.col("title_key")) & (F.col("q.ruleset_id") == F.col("d.ruleset_id"))
    titled = cut_lineage(_small(query_side, asked.rows, 64).alias("q").join(documents.alias("d"), same).select("query_id", "block", "doc_no"))

    # A bound of all scores of a block, for each question.
    gains = asked.terms.select("query_id", "ruleset_id", "term", "gain")
    reach = cut_lineage(
        asked.headers.select("ruleset_id", "term", "block", "impact")
        .join(_small(gains, asked.rows, 80), ["ruleset_id", "term"])
        .groupBy("query_id", "block")
        .agg(F.sum(F.col("gain") * F.col("impact")).alias("reach"))
    )

    def scored(open_pairs: DataFrame, bars: DataFrame | None) -> DataFrame:
        terms = asked.terms.join(query_side.select("query_id", "favored_intent", "multiclass_intent"), "query_id")
        terms = terms.join(bars, "query_id", "left") if bars is not None else terms.withColumn("bar", F.lit(None).cast("double"))
        flags = F.col("favored_intent").cast("int") + 2 * F.col("multiclass_intent").cast("int")
        asker = F.struct("query_id", "gain", flags.alias("flags"), F.coalesce("bar", F.lit(float("-inf"))).alias("bar"))
        askers = terms.groupBy("ruleset_id", "term").agg(F.first("average_length").alias("average_length"), F.collect_list(asker).alias("askers"))
        found = _score_blocks(asked, askers, documents, open_pairs, titled, limit, groups)
        best = found.groupBy("query_id", "block", "doc_no").agg(F.max(F.struct("match_score", (-F.col("chunk_index")).alias("i"))).alias("b"))
        return best.select("query_id", "block", "doc_no", F.col("b.match_score").alias("match_score"), (-F.col("b.i")).alias("chunk_index"))

    def with_scores(best: DataFrame) -> DataFrame:
        side = best.join(documents, ["block", "doc_no"]).join(query_side, ["query_id", "ruleset_id"])
        return side.withColumn("score", F.round(F.col("match_score") + markers.lexical_adjustment(), TIE_DIGITS))

    by_reach = Window.partitionBy("query_id").orderBy(F.col("reach").desc(), "block")
    visits = reach.withColumn("visit", F.row_number().over(by_reach))
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    opened = visits.where((F.col("visit") <= first_blocks)).select("query_id", "block").union(titled.select("query_id", "block")).distinct()
    first = cut_lineage(with_scores(scored(opened, None)).select("query_id", "doc_id", "chunk_index", "match_score", "score"))
    bars = top_k(first, limit, order).where(F.col("rank") == limit).select("query_id", (F.col("score") - SLACK).alias("bar"))
    most = index.manifest["max_priority"] / 10000.0 + float(groups.max())
    rest = visits.where(F.col("visit") > first_blocks).join(titled.select("query_id", "block"), ["query_id", "block"], "left_anti")
    rest = rest.join(bars, "query_id", "left").where(F.col("bar").isNull() | (F.col("reach") + most >= F.col("bar"))).select("query_id", "block")
    later = with_scores(scored(rest, bars)).select("query_id", "doc_id", "chunk_index", "match_score", "score")
    return top_k(first.unionByName(later), limit, order).select("query_id", "doc_id", "chunk_index", "match_score", "score", "rank")
