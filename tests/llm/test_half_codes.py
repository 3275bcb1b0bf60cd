"""op6 codes frequent bytes by one half; what it scores and learns is what a plain walk over the bits gives."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from folioscan.llm import language_model as lm


def _walked(code):
    """The half codes of one byte."""
    first, second, third = code >> 4 & 15, code & 15, code >> 8
    return [first] if first < len(lm.SHORT) else [first, second] if first < 15 else [first, second, third]


def test_every_byte_has_its_own_code():
    codes = [tuple(_walked(int(c))) for c in lm.CODES]
    assert len(lm.SHORT) + -(-len(lm.LONGER) // 16) < 16 and len(set(codes)) == 256
    assert not any(a != b and b[: len(a)] == a for a in codes for b in codes)
    assert all(len(codes[b]) == 1 for b in b" etaoin") and len(codes[0x4E]) == 3


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["the", "cat", "sat", "où", "mats;", "x=7", "日本", "~"], k=40)) for _ in range(12)]
    words = pa.array([t.split() for t in texts], pa.list_(pa.string()))
    raw, sizes = lm.running_text(words)
    hashes, counts = lm.contexts(raw, lm.word_of_byte(raw), sizes), lm.Counts()
    coded = lm.CODES.take(raw)
    counts.add(coded, hashes)
    states = np.zeros(int(lm.STARTS[-1]), np.uint8)
    for chunk, check, seen in counts.chunks():
        data = lm.merged([check], [seen])
        states[chunk * lm._CHUNK * 16 :][: len(data)] = np.frombuffer(data, np.uint8)
    mixer = lm.Mixer(states, np.full((lm.GATES, len(lm.ORDERS) + 1), 0.2))
    table = np.zeros((2, lm.GATES, lm.BUCKETS))
    lm.tuned(mixer, coded, hashes, np.tile(20.0 * np.eye(len(lm.ORDERS) + 1), (lm.GATES, 1, 1)), table)
    return raw, coded, hashes, lm.Mixer(states, mixer.weights, table), table


def _plain(mixer, code, hashes):
    """log10 probability of one byte, bit by bit."""
    log, high = 0.0, None
    for n, half in enumerate(_walked(code)):
        at, checks = lm.lines(hashes, high)
        lines = [mixer.states[x[0] : x[0] + 16] if mixer.states[x[0]] == c[0] and mixer.states[x[0] + 1] else np.zeros(16, np.uint8) for x, c in zip(at, checks)]
        gate = sum(4 << k for k, line in enumerate(lines[-4:]) if line[1])
        for depth in range(4):
            states = [int(line[1 << depth | half >> (4 - depth)]) for line in lines]
            sides = [(lm.LEVELS[s >> 4], lm.LEVELS[s & 15]) for s in states]
            row = [min(9, max(-9, math.log((b + 0.1) / (a + 0.1)))) for a, b in sides] + [0.3]
            mixed = min(12, max(-12, sum(w * x for w, x in zip(mixer.weights[gate + depth], row))))
            p = float(mixer.final(np.array([mixed], np.float32), np.array([gate + depth]))[0])
            log += math.log10(p if half >> (3 - depth) & 1 else 1 - p)
        high = np.array([half + (16 if n == 1 else 0)], np.uint8)
    return log


def test_scores_against_a_plain_walk(model):
    raw, coded, hashes, mixer, _ = model
    got = lm.byte_scores(mixer, coded, hashes)
    for at in range(0, len(raw), 7):
        assert got[at] == pytest.approx(_plain(mixer, int(coded[at]), [h[at : at + 1] for h in hashes]), abs=1e-4)


def test_each_bit_is_tuned_once(model):
    _, coded, _, _, table = model
    assert table.sum() == 4 * sum(len(_walked(int(c))) for c in coded) < 8 * len(coded)
