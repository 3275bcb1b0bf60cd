"""Language-model scores of running text: hashed-context bit predictors, mixed in the logistic domain by gated weights and refined adaptively."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.quality import fold
from folioscan.session import cut_lineage

#: Contexts of the predictors: the last 2, 3 and 5 bytes, across words; the word so far, and with it one or two words before it.
ORDERS = (2, 3, 5, "word", "pair", "triple")
#: Table slots of each, as powers of two. A line of 16 slots holds a check byte and the 15 nodes of half a byte.
#: The memory of all tables together is fixed, 28 MB of states; a context that finds no line is as if never seen.
SLOTS = (20, 21, 22, 22, 23, 23)
STARTS = np.r_[0, np.cumsum([1 << s for s in SLOTS])].astype(np.int64)
#: Weight sets: by which of the last four predictors know their context, and the bit's place in its half byte.
GATES = 16 * 4
BUCKETS = 33
#: What a state's two halves say about the zeros and the ones seen, at least.
LEVELS = np.array([0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 512, 2048, 16384])
_CHUNK = 4096
#: Documents that share a row per word; bytes of whole documents whose contexts are made at once; bytes of one online step; bytes scored at once.
BATCH_DOCUMENTS, STRETCH, STEP, PASS = 4_000, 1 << 18, 1 << 15, 1 << 14
#: Half codes of the bytes: these end with the first half, the next 48 with the second, all others are a mark and their two half
#: bytes. The choice suits Latin lower case; elsewhere bytes only cost more halves. A code holds third half, first and second.
SHORT = b" etaoinrshd\xc3"
LONGER = b"ulcmpfgvbywkjxzq0123456789\n.,!-'\xa9\xa8\xb3\xbc\xa4\xb6\xb1\xaa\xa7\x9f\xad\"%()?"
CODES = np.array([b % 16 << 8 | 0xF0 | b >> 4 for b in range(256)], np.uint16)
CODES[list(SHORT)] = np.arange(len(SHORT)) << 4
CODES[list(LONGER)] = np.arange(len(LONGER)) + (len(SHORT) << 4)
_ODD, _MORE = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    x ^= x >> np.uint32(15)
    x *= _MORE
    return x ^ (x >> np.uint32(13))


def running_text(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all documents, each word closed by a space and each document by a line feed, and each document's size."""
    joined = pc.binary_join(words, " ")
    closed = pc.if_else(pc.equal(joined, ""), "\n", pc.binary_join_element_wise(joined, "\n", " "))
    sizes = pc.binary_length(closed).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer("".join(closed.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8), sizes


def word_of_byte(raw: np.ndarray) -> np.ndarray:
    """Number of the word each byte belongs to; what closes a word is its last byte."""
    ends = (raw == 32) | (raw == 10)
    return np.cumsum(ends) - ends


def contexts(raw: np.ndarray, owner: np.ndarray, sizes: np.ndarray | None = None) -> list[np.ndarray]:
    """A hash per byte and predictor of what stands before it in its document, across words.

    `owner` numbers the words; `sizes` are the documents' bytes (one document if not given).
    """
    size = len(raw)
    sizes = np.array([size]) if sizes is None else sizes
    at = np.arange(size, dtype=np.uint32)
    since = at - np.repeat((np.cumsum(sizes) - sizes).astype(np.uint32), sizes)  # bytes before it in the document
    back = []
    for k in range(1, 6):
        before = np.zeros(size, np.uint32)
        before[k:] = raw[: max(0, size - k)]
        before[k:] += np.uint32(1)
        before[since < k] = 0
        back.append(before)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if size else np.empty(0, np.int64)
    lengths = np.diff(np.r_[first, size])
    place = at - np.repeat(first.astype(np.uint32), lengths)
    # all bytes of the word so far: a running sum of place-dependent values, less the sum at the word's start
    term = _spread((raw.astype(np.uint32) + np.uint32(1)) * (_spread(place + np.uint32(77)) | np.uint32(1)))
    total = np.cumsum(term, dtype=np.uint32)
    begin = total[first] - term[first]
    so_far = total - term - np.repeat(begin, lengths)
    whole = _spread(total[first + lengths - 1] - begin + np.uint32(1))
    opens = since[first] == 0
    one = np.r_[np.zeros(1, np.uint32), whole[:-1]][: len(whole)]
    one[opens] = 0
    two = np.r_[np.zeros(1, np.uint32), one[:-1]][: len(one)]
    two[opens] = 0
    pair = so_far + np.repeat(_spread(one + np.uint32(3)), lengths)
    byte2 = back[0] | back[1] << np.uint32(9)
    byte3 = byte2 + back[2] * np.uint32(0x27D4EB2F)
    byte5 = byte3 + _spread(back[3] | back[4] << np.uint32(9))
    triple = pair + np.repeat(_spread(two + np.uint32(5)) * _MORE, lengths)
    return [_spread(x) for x in (byte2, byte3, byte5, so_far, pair, triple)]


def lines(hashes: list[np.ndarray], high: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """First slot and check of each predictor's line for the first half of a byte or, after the half `high`, the second."""
    if high is not None:
        turn = (high.astype(np.uint32) + np.uint32(1)) * np.uint32(0xC2B2AE3D)
        hashes = [_spread(h + turn) for h in hashes]
    at = [STARTS[k] + ((h >> np.uint32(36 - bits)).astype(np.int64) << 4) for k, (bits, h) in enumerate(zip(SLOTS, hashes))]
    return at, [np.maximum((h >> np.uint32(3)).astype(np.uint8), 1) for h in hashes]


def slots(hashes: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
    """Table indices of each predictor for a byte whose bits so far, after a leading one, are `node`."""
    depth = int(node[0]).bit_length() - 1
    if depth < 4:
        return [x + node for x in lines(hashes)[0]]
    rest = 1 << depth - 4
    return [x + (rest | node & rest - 1) for x in lines(hashes, node >> (depth - 4) & 15)[0]]


def states_of(counts: np.ndarray) -> np.ndarray:
    """One byte for each pair of counts (zeros, ones)."""
    level = [(np.searchsorted(LEVELS, x, "right") - 1).astype(np.uint8) for x in counts]
    return level[0] << 4 | level[1]


_ZEROS, _ONES = LEVELS[np.arange(256) >> 4].astype(float), LEVELS[np.arange(256) & 15].astype(float)


def _stretch(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.log((np.maximum(ones, 0) + 0.1) / (np.maximum(zeros, 0) + 0.1)), -9, 9)


#: What a state predicts: by all that was seen, and less one zero or one one.
_STRETCHED = np.concatenate([_stretch(_ZEROS, _ONES), _stretch(_ZEROS - 1, _ONES), _stretch(_ZEROS, _ONES - 1)]).astype(np.float32)


class Mixer:
    """States of the slots (or counts of zeros and ones, 2 x slots), weights per gate, and the refining table per gate and bucket (zeros, ones)."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray, refined: np.ndarray | None = None) -> None:
        self.states = counts if counts.dtype == np.uint8 else states_of(counts)  # not copied: tasks share what was broadcast
        self.weights, self.share = weights.astype(np.float32), None
        if refined is not None:
            self.share = ((refined[1] + 0.5 * _CENTRES) / (refined.sum(axis=0) + 0.5)).astype(np.float32).ravel()

    def found(self, at: list[np.ndarray], checks: list[np.ndarray], leave_out: bool) -> tuple[list[np.ndarray], np.ndarray]:
        """Copies of the lines that belong to their contexts, one after the other and empty for the others, and the weight sets
        of the first bits. A line is fetched from the large table once; its bits are then read from the copy."""
        whole = self.states.view(np.complex128)  # items of 16 bytes, only copied
        copies, mask = [], np.zeros(len(at[0]), np.uint8)
        for k, (x, c) in enumerate(zip(at, checks)):
            line = whole.take(x >> 4)
            states = line.view(np.uint8)
            first = states[1::16]
            known = (states[::16] == c) & ((first > 1) & (first != 16) if leave_out else first > 0)
            line[~known] = 0
            copies.append(states)
            if k >= len(at) - 4:
                mask |= known.view(np.uint8) << np.uint8(k - len(at) + 4)
        return copies, mask << np.uint8(2)

    def gate(self, at: list[np.ndarray]) -> np.ndarray:
        """Weight set of the first bit in the half byte that any slots `at` belong to."""
        mask = np.zeros(len(at[0]), np.int64)
        for k, x in enumerate(at[-4:]):
            mask |= (self.states[x & -16 | 1] > 0).astype(np.int64) << k
        return mask * 4

    def inputs(self, at: list[np.ndarray], bit: np.ndarray, leave_out: bool, gate: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions (predictors and a bias, x bytes) and gates. `leave_out` takes one occurrence of the bit itself away."""
        gate = self.gate(at) + int(at[0][0] & 15).bit_length() - 1 if gate is None else gate
        rows = np.empty((len(at) + 1, len(bit)), np.float32)
        shift = (bit + 1) << 8 if leave_out else None
        for k, slot in enumerate(at):
            state = self.states.take(slot)
            np.take(_STRETCHED, state + shift if leave_out else state, out=rows[k], mode="clip")
        rows[-1] = 0.3
        return rows, gate

    def mixed(self, rows: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The weighted sums of each bit's row by its gate; bits of one gate side by side are summed at once."""
        total = np.empty(len(gate), np.float32)
        bounds = np.r_[0, np.flatnonzero(gate[1:] != gate[:-1]) + 1, len(gate)]
        if len(bounds) > 100:
            return np.clip(np.einsum("kn,nk->n", rows, self.weights[gate]), -12, 12)
        for low, high in zip(bounds.tolist(), bounds[1:].tolist()):
            np.dot(self.weights[gate[low]], rows[:, low:high], out=total[low:high])
        return np.clip(total, -12, 12, out=total)

    def final(self, stretched: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability of a one: the mixed one, and half of it from the refining table, read between its two nearest buckets."""
        p = 1 / (1 + np.exp(-stretched))
        if self.share is not None:
            place = (stretched + np.float32(12)) * np.float32((BUCKETS - 1) / 24)
            low = np.minimum(place.astype(np.int64), BUCKETS - 2)
            part = place - low.astype(np.float32)
            low += gate * BUCKETS
            below = self.share.take(low)
            p = np.float32(0.5) * (p + below + part * (self.share.take(low + 1) - below))
        return np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6))


_CENTRES = 1 / (1 + np.exp(-np.linspace(-12, 12, BUCKETS)))[None, :]


def _bits(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    node = np.ones(len(raw), np.int64)
    for k in range(7, -1, -1):
        bit = (raw >> k & 1).astype(np.int64)
        yield node, bit
        node = 2 * node + bit


def _steps(raw: np.ndarray, hashes: list[np.ndarray], size: int = STEP) -> Iterator[tuple[slice, np.ndarray, list[np.ndarray]]]:
    for at in range(0, len(raw), size):
        some = slice(at, at + size)
        yield some, raw[some], [h[some] for h in hashes]


def _halves(coded: np.ndarray, hashes: list[np.ndarray]) -> Iterator[tuple[np.ndarray | slice, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """First, second and third half codes: of which bytes, the halves, and the lines and checks of their contexts."""
    first = (coded >> 4 & 15).astype(np.uint8)
    yield (slice(None), first, *lines(hashes))
    some = np.flatnonzero(first >= len(SHORT))
    if len(some):
        hashes, before, coded = [h.take(some) for h in hashes], first.take(some), coded.take(some)
        second = (coded & 15).astype(np.uint8)
        yield (some, second, *lines(hashes, before))
        rest = np.flatnonzero(before == 15)
        if len(rest):
            third = (coded.take(rest).astype(np.uint16) >> 8).astype(np.uint8)
            yield (some.take(rest), third, *lines([h.take(rest) for h in hashes], second.take(rest) + np.uint8(16)))


class Counts:
    """What one task has seen: for each line its check, the 16 half codes that followed, and hits less misses.

    A line counts for one context at a time; a context that misses it more often than it was hit takes it over.
    """

    def __init__(self) -> None:
        total = int(STARTS[-1])
        self.seen = np.zeros(total + 1, np.int32)  # the last slot takes what finds no line
        self.check, self.worth = np.zeros(total // 16, np.uint8), np.zeros(total // 16, np.int32)

    def add(self, raw: np.ndarray, hashes: list[np.ndarray]) -> None:
        by_line, nowhere = self.seen[:-1].reshape(-1, 16), len(self.seen) - 1
        ones = np.ones(STEP, np.int32)
        for _, some, own in _steps(raw, hashes):
            for _, half, at, checks in _halves(some, own):
                half = half.astype(np.int64)
                for first, check in zip(at, checks):
                    line, slot = first >> 4, first + half
                    hit = self.check.take(line) == check
                    np.add.at(self.worth, line, (hit.view(np.int8) * np.int8(2) - np.int8(1)).astype(np.int32))
                    missed = np.flatnonzero(~hit)
                    if len(missed):
                        lost = line.take(missed)
                        over = np.flatnonzero(self.worth.take(lost) < 0)
                        if len(over):
                            taken = lost.take(over)
                            self.check[taken] = check.take(missed.take(over))
                            by_line[taken] = 0
                            self.worth[taken] = 1
                            missed = np.flatnonzero(self.check.take(line) != check)
                        slot[missed] = nowhere
                    np.add.at(self.seen, slot, ones[: len(slot)])

    def chunks(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Number, checks and counts of each stretch of lines that has any."""
        for chunk in np.unique(np.flatnonzero(self.check) // _CHUNK).tolist():
            seen = self.seen[chunk * _CHUNK * 16 : min((chunk + 1) * _CHUNK * 16, len(self.seen) - 1)]
            yield chunk, self.check[chunk * _CHUNK : (chunk + 1) * _CHUNK].tobytes(), seen.astype("<u2" if seen.max() < 65536 else "<u4").tobytes()


def merged(checks: list[bytes], counts: list[bytes]) -> bytes:
    """States of a stretch of lines that several tasks counted: each line goes to the context seen most by one task, with all its counts."""
    checks = [np.frombuffer(x, np.uint8) for x in checks]
    counts = [np.frombuffer(x, "<u2" if len(x) == 32 * len(c) else "<u4").reshape(-1, 16) for x, c in zip(counts, checks)]
    best, owner = np.zeros(len(checks[0]), np.int64), np.zeros(len(checks[0]), np.uint8)
    for check, seen in zip(checks, counts):
        total = seen.sum(axis=1, dtype=np.int64)
        more = (total > best) | ((total == best) & (check > owner))
        best[more], owner[more] = total[more], check[more]
    summed = np.zeros((len(owner), 16), np.int64)
    for check, seen in zip(checks, counts):
        summed += np.where((check == owner)[:, None], seen, 0)
    out = np.zeros((len(owner), 16), np.uint8)
    out[:, 0] = owner
    for depth in range(4):
        sides = summed.reshape(len(owner), 1 << depth, 2, 8 >> depth).sum(axis=3)
        out[:, 1 << depth : 2 << depth] = states_of(np.moveaxis(sides, 2, 0))
    return out.tobytes()


def _sorted_halves(mixer: Mixer, raw: np.ndarray, hashes: list[np.ndarray], leave_out: bool) -> Iterator[tuple[np.ndarray | slice, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Of which bytes; order by weight set; half codes and first gates in that order; lines (Mixer.found), for all halves of each byte."""
    for some, half, at, checks in _halves(raw, hashes):
        copies, gate = mixer.found(at, checks, leave_out)
        order = np.argsort(gate, kind="stable")
        yield some, order, half.take(order).astype(np.int64), gate.take(order).astype(np.int64), copies


def _rows(copies: list[np.ndarray], slot: np.ndarray, shift: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """What Mixer.inputs gives, from copies of lines: all predictors share the places `slot` of their bits."""
    for k, states in enumerate(copies):
        state = states.take(slot)
        np.take(_STRETCHED, state if shift is None else state + shift, out=rows[k], mode="clip")
    return rows


def tuned(mixer: Mixer, raw: np.ndarray, hashes: list[np.ndarray], curves: np.ndarray, table: np.ndarray) -> None:
    """One online step: bits are predicted without their own occurrence and go to the nearest bucket of their gate in the refining
    `table`; then each gate's weights move against their coding error, by a Newton step over all curvature so far (`curves`)."""
    push = np.zeros(mixer.weights.shape)
    space = np.full((len(ORDERS) + 1, len(raw)), 0.3, np.float32)
    for _, order, half, first, copies in _sorted_halves(mixer, raw, hashes, True):
        bounds, place = np.searchsorted(first, np.arange(0, GATES + 4, 4)), order << 4
        for depth in range(4):
            bit, gate = half >> (3 - depth) & 1, first + depth
            rows = _rows(copies, place + (1 << depth | half >> (4 - depth)), (bit + 1) << 8, space[:, : len(half)])
            stretched = mixer.mixed(rows, gate)
            bucket = ((stretched + np.float32(12)) * np.float32((BUCKETS - 1) / 24) + np.float32(0.5)).astype(np.int64)
            table += np.bincount((bit * GATES + gate) * BUCKETS + bucket, minlength=table.size).reshape(table.shape)
            p = 1 / (1 + np.exp(-stretched))
            error, curve = bit.astype(np.float32) - p, np.maximum(p * (1 - p), np.float32(1e-4))
            for g in np.flatnonzero(np.diff(bounds)).tolist():
                some = slice(bounds[g], bounds[g + 1])
                x = rows[:, some]
                push[g * 4 + depth] += x @ error[some]
                curves[g * 4 + depth] += (x * curve[some]) @ x.T
    mixer.weights += np.linalg.solve(curves, push[:, :, None])[:, :, 0].astype(np.float32)


def byte_scores(mixer: Mixer, raw: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each byte after what stands before it."""
    out = np.empty(len(raw))
    space = np.full((len(ORDERS) + 1, PASS), 0.3, np.float32)
    for some, part, own in _steps(raw, hashes, PASS):
        product = np.ones(len(part))
        for which, order, half, first, copies in _sorted_halves(mixer, part, own, False):
            chance, place, rows, each = np.float32(1), order << 4, space[:, : len(half)], np.empty(len(half))
            for depth in range(4):
                gate = first + depth
                _rows(copies, place + (1 << depth | half >> (4 - depth)), None, rows)
                p = mixer.final(mixer.mixed(rows, gate), gate)
                chance = chance * np.where(half & 8 >> depth, p, 1 - p)
            each[order] = chance
            product[which] *= each
        out[some] = np.log10(product)
    return out


def _stretches(words: pa.ListArray) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Codes of the bytes, contexts and document sizes of whole documents, about STRETCH bytes at a time."""
    sizes = pc.binary_length(pc.binary_join(words, " ")).to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.empty(0, np.int64)
    group = np.cumsum(sizes) // STRETCH
    for start in np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist() if len(group) else []:
        raw, own = running_text(words.slice(start, int(np.count_nonzero(group == group[start]))))
        yield CODES.take(raw), contexts(raw, word_of_byte(raw), own), own


_HEADS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64()), ("score", pa.float64())]))
_HEAD_TYPE = "array<struct<doc_id:bigint,n_tokens:bigint,bytes:bigint,score:double>>"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_DOCUMENTS):
            yield batch.slice(at, BATCH_DOCUMENTS)


def _words(batch: pa.RecordBatch) -> pa.ListArray:
    """The words of each document of a batch."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column(1), "")))
    flat = parts.flatten()
    real = pc.not_equal(flat, "")
    kept = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
    offsets = kept[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat.filter(real))


def _tokens(parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Document number and code of each token of a batch, and the words of the codes; code 0 is the end token, of each document once."""
    coded = pa.concat_arrays([pa.array([""]), parts.flatten()]).dictionary_encode()
    doc = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()).astype(np.int64))
    codes = np.r_[coded.indices.to_numpy()[1:], np.zeros(len(parts), np.int32)]
    return np.r_[doc, np.arange(len(parts))], codes.astype(np.int64), coded.dictionary.to_pylist()


def _learnt(names: list[int | None], held_out: int, folds: int) -> np.ndarray:
    return np.array([x is not None and zlib.crc32(str(x).encode()) % folds != held_out for x in names], bool)


def word_table(docs: DataFrame, held_out: int = 2, folds: int = 7) -> DataFrame:
    """word, count: every token of all documents and its occurrences in those that are learnt from; counted in batches before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            doc, codes, words = _tokens(_words(batch))
            own = _learnt(batch.column(0).to_pylist(), held_out, folds)[doc]
            yield pa.record_batch([pa.array(words, pa.string()), pa.array(np.bincount(codes[own], minlength=len(words)))], ["word", "count"])

    return docs.select("doc_id", "text").mapInArrow(run, "word string, count bigint").groupBy("word").agg(F.sum("count").alias("count"))


def postings(docs: DataFrame, model: tuple[Broadcast, np.ndarray, np.ndarray]) -> DataFrame:
    """word, batch, docs, times, heads: for each word of a batch of documents the numbers of those that have it and how often;
    heads (doc_id, n_tokens, bytes and the score of the running text, in the order of numbers) stand beside the end token only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, mixer = TaskContext.get().partitionId() << 32, Mixer(model[0].value, *model[1:])
        for batch in _parts(batches):
            number += 1
            parts = _words(batch)
            size, score = [], []
            for raw, hashes, own in _stretches(parts):
                size.append(own)
                score.append(np.bincount(np.repeat(np.arange(len(own)), own), byte_scores(mixer, raw, hashes), len(own)))
            doc, codes, words = _tokens(parts)
            tokens = np.bincount(doc, minlength=batch.num_rows)
            columns = [batch.column(0), pa.array(tokens), pa.array(np.concatenate(size)), pa.array(np.concatenate(score))]
            heads = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, _HEADS.value_type)], fields=list(_HEADS.value_type))
            heads = pa.ListArray.from_arrays(pa.array([0, len(heads)], pa.int32()), heads)
            key, times = np.unique(codes * batch.num_rows + doc, return_counts=True)
            code, doc = key // batch.num_rows, key % batch.num_rows
            offsets = pa.array(np.searchsorted(code, np.arange(len(words) + 1)).astype(np.int32))
            rows = [
                pa.array(words, pa.string()),
                pa.array(np.full(len(words), number)),
                pa.ListArray.from_arrays(offsets, pa.array(doc.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
                pa.concat_arrays([heads.cast(_HEADS), pa.nulls(len(words) - 1, _HEADS)]),
            ]
            for at in range(0, len(words), 20_000):
                yield pa.record_batch([x.slice(at, 20_000) for x in rows], ["word", "batch", "docs", "times", "heads"])

    return docs.select("doc_id", "text").mapInArrow(run, f"word string, batch bigint, docs array<int>, times array<int>, heads {_HEAD_TYPE}")


def fit_mixer(docs: DataFrame, held_out: int = 2, folds: int = 7) -> tuple[Broadcast, np.ndarray, np.ndarray]:
    """Learn from the running text of all documents outside the fold `held_out`.

    Two passes: what follows each context, counted by tasks and merged by stretch of lines; then mixing
    weights and the refining table, learnt online by each task in document order and averaged by its bytes
    or added up. The second leaves the occurrence at hand out of its own counts. What reaches the driver
    has the fixed size of the tables. Returns the states (broadcast once), weights and refining table of a Mixer.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")

    def training(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        for batch in _parts(batches):
            yield from _stretches(_words(batch.filter(pa.array(_learnt(batch.column(0).to_pylist(), held_out, folds)))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for raw, hashes, _ in training(batches):
            counts = counts or Counts()
            counts.add(raw, hashes)
        for chunk, check, seen in counts.chunks() if counts else ():
            yield pa.record_batch([pa.array([chunk]), pa.array([check], pa.binary()), pa.array([seen], pa.binary())], ["chunk", "checks", "seen"])

    def merge(table: pa.Table) -> pa.Table:
        data = merged(table.column("checks").to_pylist(), table.column("seen").to_pylist())
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "data": pa.array([data], pa.binary())})

    counted = texts.mapInArrow(count, "chunk bigint, checks binary, seen binary")
    chunks = counted.groupBy("chunk").applyInArrow(merge, "chunk bigint, data binary").toArrow()
    states = np.zeros(int(STARTS[-1]), np.uint8)
    for chunk, data in zip(chunks.column("chunk").to_pylist(), chunks.column("data")):
        part = np.frombuffer(data.as_py(), np.uint8)
        states[chunk * _CHUNK * 16 : chunk * _CHUNK * 16 + len(part)] = part
    shared = spark.sparkContext.broadcast(states)
    initial = np.full((GATES, len(ORDERS) + 1), 0.2)

    def tune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, weight, step = Mixer(shared.value, initial), 0.0, 0
        table = np.zeros((2, GATES, BUCKETS))
        curves = np.tile(20.0 * np.eye(initial.shape[1]), (GATES, 1, 1))
        flat = table.reshape(-1)
        for raw, hashes, _ in training(batches):
            for _, some, own in _steps(raw, hashes):
                step += 1
                if step & (step - 1) == 0:
                    flat[:] = 0  # the table starts anew at every doubling: it forgets what weights far from the last ones gave
                tuned(mixer, some, own, curves, flat)
                weight += len(some)
        if weight:
            learnt = (mixer.weights.astype("<f8").tobytes(), table.astype("<f8").tobytes())
            yield pa.record_batch([pa.array([weight]), *(pa.array([x], pa.binary()) for x in learnt)], ["weight", "data", "table"])

    parts = texts.mapInArrow(tune, "weight double, data binary, table binary").toArrow()
    weight = np.array(parts.column("weight").to_pylist())
    learnt = [np.frombuffer(x.as_py(), "<f8").reshape(initial.shape) for x in parts.column("data")]
    weights = np.average(learnt, axis=0, weights=weight) if learnt else initial
    refined = sum((np.frombuffer(x.as_py(), "<f8").reshape(2, GATES, BUCKETS) for x in parts.column("table")), np.zeros((2, GATES, BUCKETS)))
    return shared, weights, refined


def score_documents(docs: DataFrame, held_out: int = 2, folds: int = 7) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Tokens are words of lower-cased whole texts and one end per document. base_score is the add-one
    unigram score; score is the mixer's log10 probability of the running text, the same words in their
    order, each with a space after it, and the end as a line feed; bits_per_byte is its cost over these
    bytes. Both are learnt from all documents outside the fold `held_out`. For the base a document's
    words meet their counts by word: a batch of documents is one row per word, so no word, however
    common, has more rows than there are batches, and sums are formed before they are shuffled by document.
    The mixer's contexts reach two words back; their tables have a fixed size (SLOTS), so in large
    tables only contexts seen often keep a line. A document's contexts are made at once, in memory.

    Null and empty texts have the end token only; a null doc_id is neither learnt from nor held out;
    repeated rows are scored one by one (and learnt from as often); other columns are ignored; an
    empty table gives no rows.
    """
    words = cut_lineage(word_table(docs, held_out, folds))
    totals = words.where("count > 0").agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    seen, kinds = int(totals[0]), int(totals[1])
    least = F.log10(F.lit(float(seen + kinds + 1)))
    pairs = (
        postings(docs, fit_mixer(docs, held_out, folds))
        .join(words, "word")
        .select("batch", "count", F.inline(F.arrays_zip("docs", "times", F.coalesce("heads", F.array().cast(_HEAD_TYPE)).alias("head"))))
    )
    n = F.col("times").cast("bigint")
    summed = pairs.groupBy("batch", "docs").agg(
        *(F.max(f"head.{c}").alias(c) for c in ("doc_id", "n_tokens", "bytes", "score")),
        F.sum(F.when(F.col("count") > 0, n).otherwise(0)).alias("n_known"),
        F.sum(n * (F.log10(F.col("count").cast("double") + 1) - least)).alias("base_score"),
    )
    return summed.select(
        "doc_id",
        F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(seen).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
        (-F.col("score") * F.log2(F.lit(10.0)) / F.col("bytes")).alias("bits_per_byte"),
    )
