"""Quality classifier: histogram gradient-boosted trees over document statistics, scored by numpy traversal."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import map_rows, texts_of

#: Labelled rows to learn from at most; a fixed bound, whatever the size of the corpus.
SAMPLE_ROWS = 20_000

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digits", "punctuation", "symbols", "bars",
    "exclamations", "spaces", "non_ascii", "short_words", "long_words", "capitals_words", "marked_ends", "symbol_ends",
    "distinct_words", "top_word", "repeated_next", "newlines", "distinct_lines", "words_per_line", "byte_entropy",
)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?'\"()-")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = True


def statistics(text: str) -> list[float]:
    """The FEATURES of one whole text; an empty text has zeros."""
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    words = data.split()
    if not words:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(FEATURES) - 1)
    counts = np.bincount(raw, minlength=256)
    n, size = len(words), len(raw)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    lengths, last = ends - starts, raw[ends - 1]
    kinds = Counter(words)
    lines = data.split(b"\n")
    share = counts[counts > 0] / size
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    return [
        np.log1p(size), np.log1p(n), lengths.mean(), lengths.std(), counts[65:91].sum() / max(1, letters), counts[48:58].sum() / size,
        counts[_PUNCTUATION].sum() / size, counts[_SYMBOL].sum() / size, counts[124] / n, counts[33] / n, counts[_SPACE].sum() / size,
        counts[128:].sum() / size, (lengths <= 3).mean(), (lengths > 14).mean(), sum(map(bytes.isupper, words)) / n,
        _PUNCTUATION[last].mean(), _SYMBOL[last].mean(), len(kinds) / n, max(kinds.values()) / n, sum(map(eq, words, words[1:])) / n,
        counts[10] / n, len(set(lines)) / len(lines), n / len(lines), float(-(share * np.log2(share)).sum()),
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(x) for x in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth in flat arrays: inner nodes by level, then leaves. A row goes right if it is over the limit."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: all rows go down one tree at a time, a level in each step."""
        total, index = np.full(len(rows), self.base), np.arange(len(rows))
        inner = self.feature.shape[1]
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(rows), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (rows[index, feature[node]] > limit[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(
    rows: np.ndarray, labels: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: int = 10
) -> Trees:
    """Boosted trees for 0/1 labels. Each level sums gradients into histograms of binned features and
    takes each node's best split; a node that gains nothing sends all its rows left. Without rows of
    both labels there are no trees and the score is the smoothed share of label 1."""
    inner = (1 << depth) - 1
    prior = (labels.sum() + 1) / (len(labels) + 2)
    base = float(np.log(prior / (1 - prior)))
    empty = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))
    if len(np.unique(labels)) < 2:
        return Trees(base, *empty)
    width = rows.shape[1]
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)], axis=1)
    flat = binned + np.arange(width) * bins
    total = np.full(len(rows), base)
    features, limits, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, curve = labels - p, p * (1 - p)
        node = np.zeros(len(rows), np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * (width * bins) + flat).ravel()
            g, h, c = (
                np.bincount(cell, np.repeat(w, width), many * width * bins).reshape(many, width, bins).cumsum(axis=2)
                for w in (gradient, curve, np.ones(len(rows)))
            )
            all_g, all_h, all_c = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
            gain[(c < least) | (all_c - c < least)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + k], limit[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[node]] > limit[node])
        at = node - inner
        leaf = rate * np.bincount(at, gradient, inner + 1) / (np.bincount(at, curve, inner + 1) + l2)
        total += leaf[at]
        features.append(feature)
        limits.append(limit)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(limits), np.array(leaves))


def fold(id_column: str, folds: int = 4) -> Column:
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(folds))


def fit_quality(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Learn from the documents of `labels` (doc_id, quality 0/1) outside the fold `held_out`.

    At most `sample_rows` labelled ids are drawn, by the order of a hash of the id, so the sample,
    its broadcast and the matrix on the driver have a fixed bound. Rows without an id or label are
    left out; a repeated label row is one more example.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold("doc_id", folds) != held_out))
    drawn = known.select("doc_id", F.col("quality").cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = matrix(texts_of(batch.column(0)))
        return pa.record_batch([batch.column(1), pa.array(list(values))], ["label", "features"])

    found = map_rows(rows, ["text", "label"], run, "label double, features array<double>").toPandas()
    values = np.array(found["features"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort(values.T)  # the same model whatever order the rows arrive in
    return fit_trees(values[order], found["label"].to_numpy(np.float64)[order])


def quality_score(model: Trees, text: Column) -> Column:
    """Probability that a text has label 1; null counts as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(matrix([x or "" for x in texts])))

    return score(text)


def score_documents(docs: DataFrame, model: Trees, limit: float = 0.7, held_out: int = 2, folds: int = 4) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= limit).

    Null and empty texts get the score of a text without words; repeated rows get equal scores; a
    null id is in no fold (held_out false); other columns of `docs` are ignored.
    """
    scored = docs.select("doc_id", quality_score(model, F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Trees, limit: float = 0.7) -> DataFrame:
    """The rows of `docs` that the model does not reject."""
    return docs.where(quality_score(model, F.col("text")) >= limit)
