"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import groups_of, local_roots, map_rows, texts_of
from folioscan.llm.components import components
from folioscan.session import cut_lineage

#: Rows of one trie at most; larger groups are split (exactly) before they are joined.
TRIE_ROWS = 1024
#: Pairs that one traversal may meet at most.
TRIE_PAIRS = 4_000_000
#: Units that one step takes from a batch, so that its arrays stay small when units are full.
UNITS = 1024


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half of the shingles' XXH64."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(x, seed) for x in parts]), dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long) of whole texts; null and empty texts have fingerprint 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x, shingle) for x in texts_of(batch.column(1))], dtype=np.uint64)
        return pa.record_batch([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("text_hash"))
    return map_rows(rows, ["doc_id", "text", "text_hash"], run, "doc_id bigint, text_hash bigint, fp bigint")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at `errors` differing bits or fewer inside each of the groups [start, end).

    `values` are unsigned and sorted inside each group, so a trie node is a range of indices. All
    node pairs of one depth are walked together, from each group's root against itself: a step
    splits both nodes at the next bit and adds one to the differing bits of crossing children;
    pairs over the budget are pruned; pairs of single leaves are settled at once. After the split
    at bit 0 all nodes are leaves: a last step settles the pairs it made. Values are distinct.
    """
    a0, a1, b0, b1 = starts, ends, starts, ends
    spent = np.zeros(len(starts), np.int64)
    found_a, found_b = [], []
    for bit in range(63, -2, -1):
        same = a0 == b0
        keep = ~same | (a1 - a0 > 1)
        a0, a1, b0, b1, spent, same = (x[keep] for x in (a0, a1, b0, b1, spent, same))
        leaf = ~same & (a1 - a0 == 1) & (b1 - b0 == 1)
        near = leaf & (_popcount(values[np.where(leaf, a0, 0)] ^ values[np.where(leaf, b0, 0)]) <= errors) if len(a0) else leaf
        found_a.append(a0[near])
        found_b.append(b0[near])
        a0, a1, b0, b1, spent, same = (x[~leaf] for x in (a0, a1, b0, b1, spent, same))
        if bit < 0 or not len(a0):
            break
        ones = np.r_[0, np.cumsum((values >> np.uint64(bit)) & np.uint64(1))].astype(np.int64)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        cross = ~same
        a0, a1, b0, b1, spent = (
            np.concatenate(x)
            for x in (
                (a0, am, a0, am[cross]),
                (am, a1, am, a1[cross]),
                (b0, bm, bm, b0[cross]),
                (bm, b1, b1, bm[cross]),
                (spent, spent, spent + 1, spent[cross] + 1),
            )
        )
        keep = (spent <= errors) & (a0 < a1) & (b0 < b1)
        a0, a1, b0, b1, spent = (x[keep] for x in (a0, a1, b0, b1, spent))
    return np.concatenate(found_a), np.concatenate(found_b)


def _trie_links(batches: Iterator[pa.RecordBatch], errors: int) -> Iterator[pa.RecordBatch]:
    """Rows of members (fp, node), one row a unit, to links (a, b) that span the near ones of each unit."""
    for batch in batches:
        for at in range(0, batch.num_rows, UNITS):
            members = batch.column(0).slice(at, UNITS)
            fp, node = (x.to_numpy(zero_copy_only=False) for x in members.flatten().flatten())
            bounds = members.offsets.to_numpy() - members.offsets[0].as_py()
            starts, ends = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
            value = fp.view(np.uint64)
            order = np.lexsort((value, np.repeat(np.arange(len(starts)), ends - starts)))
            value, node = value[order], node[order]
            cost = np.cumsum((ends - starts) ** 2)
            for lo, hi in zip(*groups_of(cost // TRIE_PAIRS)):
                some = slice(starts[lo], ends[hi - 1])
                left, right = trie_pairs(value[some], starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo], errors)
                roots = local_roots(some.stop - some.start, left, right)
                moved = np.flatnonzero(roots != np.arange(len(roots)))
                if len(moved):
                    yield pa.record_batch([pa.array(node[some][moved]), pa.array(node[some][roots[moved]])], ["a", "b"])


def _bits(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def near_links(prints: DataFrame, errors: int = 3, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """Links (a, b) that connect all nodes whose distinct fingerprints differ in `errors` <= 3 bits.

    `prints` has node and fp, one row per distinct fp. With at most three errors one of four 16-bit
    blocks agrees, so the tries hang below those four nodes of each fingerprint. Blocks that too
    many fingerprints share are split once more by four 12-bit blocks of the rest, and what is still
    too large is dealt into chunks, of which each pair is one trie: nothing is dropped, and no trie
    has more than 2 * `trie_rows` rows.
    """
    if not 0 <= errors <= 3:
        raise ValueError("four blocks prove no more than three errors")
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), _bits(F.col("fp"), 16 * b, 16).alias("value")) for b in range(4)])
    first = prints.select("node", "fp", F.inline(blocks)).select("node", "fp", "block", F.xxhash64("block", "value").alias("unit"))
    small, large = _by_size(cut_lineage(first), trie_rows)
    pieces = []
    for b in range(4):
        others = [o for o in range(4) if o != b]
        # twelve bits each: the nibbles of the other three blocks, dealt in turn
        for k in range(4):
            value = sum((F.shiftleft(_bits(F.col("fp"), 16 * o + 4 * k, 4), 4 * i) for i, o in enumerate(others)), F.lit(0).cast("bigint"))
            pieces.append((b, k, value))
    sub = F.filter(
        F.array(*[F.struct(F.lit(b).alias("b"), F.lit(k).alias("k"), value.alias("value")) for b, k, value in pieces]),
        lambda x: x["b"] == F.col("block"),
    )
    second = cut_lineage(
        large.select("node", "fp", "block", "unit", F.explode(sub).alias("s")).select(
            "node", "fp", F.xxhash64("unit", "s.k", "s.value").alias("unit")
        )
    )
    small_second, dense = _by_size(second, trie_rows)
    chunks = F.ceil(F.col("rows") / trie_rows).cast("int")
    own = dense.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    pairs = own.select(
        "node", "fp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"), "unit", "own"
    ).select("node", "fp", F.xxhash64("unit", F.least("own", "other"), F.greatest("own", "other")).alias("unit"))
    units = small.select("unit", "fp", "node").unionByName(small_second.select("unit", "fp", "node")).unionByName(pairs.select("unit", "fp", "node"))
    # Each unit becomes one row. Sorting by unit after a `repartition` is not enough: adaptive execution drops that exchange when
    # the joins below deal by unit already, and then may read their shuffles in another deal, which tears the units apart.
    whole = units.groupBy("unit").agg(F.collect_list(F.struct("fp", "node")).alias("members")).where(F.size("members") > 1)
    return whole.select("members").mapInArrow(lambda batches: _trie_links(batches, errors), "a bigint, b bigint")


def _by_size(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of units of at most `limit` rows, and those of larger ones with their number of rows."""
    large = cut_lineage(rows.groupBy("unit").agg(F.count("*").alias("rows")).where(F.col("rows") > limit))
    return rows.join(large, "unit", "left_anti"), rows.join(large, "unit")


def _of_print(own: DataFrame, errors: int) -> DataFrame:
    """fp, n_same, component of each distinct fingerprint."""
    nodes = cut_lineage(own.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_same")))
    groups = components(near_links(nodes.where("node is not null"), errors))
    return nodes.join(groups, "node", "left").select("fp", "n_same", F.coalesce("component", "node").alias("component"))


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", errors: int = 3, shingle: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, n_same.

    component_id is the smallest doc_id reachable over links between fingerprints of `errors` bits
    or fewer; n_same counts the documents with this very fingerprint. Null, empty and blank texts
    have fingerprint zero and link like any other. Equal fingerprints are one node, so copies never
    meet as pairs. A document without an id has a fingerprint but a null component. Repeated ids
    give repeated rows. An empty table gives no rows. Other columns of `docs` are ignored.
    """
    own = cut_lineage(fingerprints(docs, id_column, text_column, shingle))
    return own.join(_of_print(own, errors), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
        "n_same",
    )


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", errors: int = 3, shingle: int = 3) -> DataFrame:
    """One row of each near-duplicate group: that with the smallest id, of equal ids the one with the smaller text hash.

    Rows are judged one by one: texts that share an id are in the groups of their own fingerprints, and
    a row that comes twice, or has a near copy under its own id, stays once. Rows without an id stay.
    Null and empty texts are one group. Other columns are kept as they are, whatever their names; an
    empty table gives no rows.
    """
    own = cut_lineage(fingerprints(docs, id_column, text_column, shingle).where("doc_id is not null"))
    key = F.struct("doc_id", "text_hash")
    rows = own.join(_of_print(own, errors), "fp").groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = rows.groupBy("component").agg(F.min(key).alias("first"))
    judged = cut_lineage(rows.join(first, "component").select("doc_id", "text_hash", "n", (key == F.col("first")).alias("kept")).where("not kept or n > 1"))
    whole = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_hash"))
    left = whole.join(judged, ["doc_id", "text_hash"], "left_anti")
    repeated = judged.where("kept")
    if not repeated.isEmpty():
        left = left.unionByName(whole.join(repeated, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"]))
    return left.select("row.*")
