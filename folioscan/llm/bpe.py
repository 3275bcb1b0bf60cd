"""Byte-level BPE from its vocabulary file: merges from a priority queue over a linked list; decoding by concatenation."""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioscan.llm.tokens import VOCABULARY, Encoder

#: Fixed value: what the vocabulary's pre-tokenizer cuts a text into.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens whose ids a task remembers.
REMEMBERED = 200_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file: printable Latin-1 bytes for themselves, the others from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Bpe(Encoder):
    """Encodes and decodes with the vocabulary, merges and added tokens of a tokenizer file."""

    def __init__(self, path: str = VOCABULARY) -> None:  # nothing of the other encoders is loaded
        with open(path, encoding="utf-8") as lines:
            file = json.load(lines)
        letters = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        vocabulary = file["model"]["vocab"]
        self.strings = {i: b"".join(letters[c] for c in token) if all(c in letters for c in token) else token.encode() for token, i in vocabulary.items()}
        self.byte_ids = [vocabulary[c] for c in byte_letters()]
        self.base = 1 + max(vocabulary.values())
        self.merges: dict[int, int] = {}  # a pair of ids, as one number, to its rank and the id of both, as one number
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[a] * self.base + vocabulary[b]] = rank * self.base + vocabulary[a + b]
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.strings |= {i: token.encode() for token, i in self.added.items()}
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pre_tokens = regex.compile(PRE_TOKENS)
        self.word = lru_cache(maxsize=REMEMBERED)(self.merged)

    def merged(self, word: str) -> list[int]:
        """Ids of one pre-token. All neighbouring pairs that merge wait in a queue by (rank, position);
        a pair is stale, and skipped, if one of its symbols has changed since it was queued."""
        symbols = [self.byte_ids[b] for b in word.encode()]
        size = len(symbols)
        if size == 1:
            return symbols
        known, base = self.merges.get, self.base
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        queue = []  # of rank, id and position, as one number
        for k in range(size - 1):
            hit = known(symbols[k] * base + symbols[k + 1])
            if hit is not None:
                queue.append(hit * size + k)
        heapify(queue)
        while queue:
            hit, at = divmod(heappop(queue), size)
            following = after[at]
            if symbols[at] < 0 or following >= size or known(symbols[at] * base + symbols[following]) != hit:
                continue
            symbols[at], symbols[following] = new, _ = hit % base, -1
            after[at] = end = after[following]
            if end < size:
                before[end] = at
                hit = known(new * base + symbols[end])
                if hit is not None:
                    heappush(queue, hit * size + at)
            start = before[at]
            if start >= 0:
                hit = known(symbols[start] * base + new)
                if hit is not None:
                    heappush(queue, hit * size + start)
        return [x for x in symbols if x >= 0]

    def _ordinary(self, text: str) -> list[int]:
        words = self.pre_tokens.findall(text)
        if len(words) == 1:
            return self.word(text) if len(text) < 64 else self.merged(text)
        return [i for w in words for i in (self.word(w) if len(w) < 64 else self.merged(w))]

    def entire(self, text: str) -> np.ndarray:
        ids: list[int] = []
        for part in self.cut_added.split(text) if self.cut_added else [text]:
            if part in self.added:
                ids.append(self.added[part])
            else:
                ids += self._ordinary(part)
        return np.array(ids, np.uint32)

    def alone(self, piece: str) -> np.ndarray:
        return np.array(self._ordinary(piece), np.uint32)

    def after_space(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [self._ordinary(" " + x) for x in pieces]
        stops = np.cumsum([len(x) for x in lists])
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(stops[-1])), stops

    def decode(self, ids: list[int]) -> str:
        """The text of `ids`, special tokens included; unknown ids give nothing, broken UTF-8 the replacement character."""
        try:
            data = b"".join(map(self.strings.__getitem__, ids))
        except KeyError:
            data = b"".join([self.strings.get(i, b"") for i in ids])
        return data.decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array<int>) of whole texts; null and empty texts have no ids. Rows are independent of one another:
    repeated rows give equal ids, a null doc_id stays null, other columns are ignored, an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)
        gc.disable()  # lists of numbers by the million, and no cycles among them
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                ids = bpe.batch(part.column(1))
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])
        gc.enable()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids, decoded: the texts of the id lists; null lists count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)
        for batch in batches:
            texts = [bpe.decode(ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []) for ids in batch.column(1)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")
