"""Token ids of whole texts by a public byte-level BPE, for the packing operators."""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: A space between two characters that are no white space always starts a new pre-token, so a text may be cut there.
#: Texts with other white space beside a space, with a special token, or with characters outside these blocks are not cut.
UNCUT = (
    r"[^\x21-\x7e\x{a1}-\x{ac}\x{ae}-\x{b1}\x{b4}-\x{b8}\x{ba}\x{bb}\x{bf}-\x{2af}\x{370}-\x{4ff}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3} \n]"
    r"|  | \n|\n |<\||\A | \z"
)


def flat_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... of consecutive runs, one after the other."""
    begins = np.cumsum(lengths) - lengths
    return np.repeat(starts - begins, lengths) + np.arange(int(lengths.sum()))


class Encoder:
    """Ids as tokenizers' encode(text, add_special_tokens=False) gives them, for batches of texts.

    Texts are cut at single spaces and each distinct piece of a batch is encoded once, by the same
    vocabulary as a rank file; texts that cannot be cut go to tokenizers whole. Nothing outlives a batch.
    """

    def __init__(self, path: str = VOCABULARY, ranks: str = RANKS) -> None:
        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        with open(ranks, "rb") as lines:
            order = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=order, special_tokens={})
        self.width = np.zeros(max(order.values()) + 1, np.int64)
        self.width[list(order.values())] = [len(x) for x in order]

    def batch(self, column: pa.Array) -> list[np.ndarray]:
        """Ids (unsigned 32-bit) of each text of an Arrow column; null counts as empty."""
        texts = pc.fill_null(column, "")
        odd = pc.match_substring_regex(texts, UNCUT)
        full = pc.greater(pc.binary_length(texts), 0)
        whole, cut = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (pc.and_(odd, full), pc.and_(pc.invert(odd), full)))
        out = [np.empty(0, np.uint32)] * len(texts)
        for k in whole:
            out[k] = self.entire(texts[k].as_py())
        for at in range(0, len(cut), 20_000):
            some = cut[at : at + 20_000]
            for k, ids in zip(some, self._cut(texts.take(pa.array(some)))):
                out[k] = ids
        return out

    def _cut(self, texts: pa.Array) -> list[np.ndarray]:
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        ids, stops = self.after_space(words)
        starts = np.r_[0, stops[:-1]]
        firsts = [self.alone(words[c]) for c in codes[offsets[:-1]].tolist()]
        first_lengths = np.array([len(x) for x in firsts])
        at, many = starts[codes], (stops - starts)[codes]
        at[offsets[:-1]] = len(ids) + np.cumsum(first_lengths) - first_lengths
        many[offsets[:-1]] = first_lengths
        pool = np.concatenate([ids, *firsts])
        flat = pool[flat_runs(at, many)]
        bounds = np.r_[0, np.cumsum(many)][offsets]
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def entire(self, text: str) -> np.ndarray:
        """Ids of any text, special tokens included."""
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def alone(self, piece: str) -> np.ndarray:
        return np.array(self.pieces.encode_ordinary(piece), np.uint32)

    def after_space(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, each as it stands after a space, one piece after the other, and where each one's ids stop."""
        ids = self.pieces.encode_to_numpy(" " + " ".join(pieces), disallowed_special=()).astype(np.uint32)
        ends = np.cumsum([len(x.encode()) + 1 for x in pieces])
        return ids, np.searchsorted(np.cumsum(self.width[ids]), ends) + 1  # no token reaches over the end of a piece
