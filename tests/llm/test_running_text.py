"""op6 scores running text: contexts cross word borders, lines belong to one context each."""

import random
import zlib

import numpy as np
import pyarrow as pa

from folioscan.llm import language_model as lm


def _stream(*documents):
    words = pa.array([d.split() for d in documents], pa.list_(pa.string()))
    raw, sizes = lm.running_text(words)
    return raw, lm.contexts(raw, lm.word_of_byte(raw), sizes), sizes


def test_text_of_documents():
    raw, _, sizes = _stream("a bc", "", "d")
    assert raw.tobytes() == b"a bc \n\nd \n" and sizes.tolist() == [6, 1, 3]


def test_contexts_reach_two_words_back_and_stop_at_documents():
    a, b, c = (_stream(t) for t in ("one two three", "ten two three", "one six three"))
    same = lambda x, y, at: [bool(g[at] == h[at]) for g, h in zip(x[1], y[1])]
    first = 8  # the first byte of the third word
    assert same(a, b, first) == [True, True, True, True, True, False]  # only the word triple sees the first word
    assert same(a, c, first) == [False, False, False, True, False, False]  # bytes and pairs see the word before
    alone, second = _stream("one two three"), _stream("something else", "one two three")
    start = len("something else \n")
    for own, later in zip(alone[1], second[1]):
        assert (own == later[start:]).all()


def test_counts_against_brute_force():
    rng = random.Random(3)
    raw, hashes, _ = _stream(*(" ".join(rng.choices(["the", "cat", "sat", "on", "mats", "é"], k=30)) for _ in range(20)))
    parts = []
    for part in (slice(0, 900), slice(900, None)):  # two tasks
        counts = lm.Counts()
        counts.add(raw[part], [h[part] for h in hashes])
        parts.append({c: (check, seen) for c, check, seen in counts.chunks()})
    states = np.zeros(int(lm.STARTS[-1]), np.uint8)
    for chunk in parts[0].keys() | parts[1].keys():
        both = [p[chunk] for p in parts if chunk in p]
        data = lm.merged([x for x, _ in both], [x for _, x in both])
        states[chunk * lm._CHUNK * 16 :][: len(data)] = np.frombuffer(data, np.uint8)
    for k in range(len(lm.ORDERS)):
        for at in range(0, len(raw), 37):
            follow = raw[hashes[k] == hashes[k][at]]
            lines, checks = lm.lines([h[at : at + 1] for h in hashes])
            own = states[lines[k][0] :][:16]
            want = lm.states_of(np.array([[(follow < 128).sum()], [(follow >= 128).sum()]]))[0]
            assert own[0] == checks[k][0] and own[1] == want
            inner = follow[follow < 128]
            assert own[2] == lm.states_of(np.array([[(inner < 64).sum()], [(inner >= 64).sum()]]))[0]


def test_frequent_context_takes_a_line_over():
    counts = lm.Counts()
    first = [np.array([x], np.uint32) for x in (1 << 20,) * 6]
    other = [h ^ np.uint32(1 << 4) for h in first]  # the same line, another check
    raw = np.array([65], np.uint8)
    counts.add(raw, first)
    line = lm.lines(first)[0][0][0] >> 4
    for _ in range(3):
        counts.add(raw, other)
    assert counts.check[line] == lm.lines(other)[1][0][0] and counts.seen[line * 16 : line * 16 + 16].sum() < 3


def test_order_of_words_counts(spark):
    rng = random.Random(5)
    phrases = ["the cat sat on the mat", "a dog ran over the hill", "rain falls in the long night", "all birds sing at dawn"]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(12))) for i in range(300)]
    right = [t for _, t in rows[:40]]
    wrong = [" ".join(rng.sample(t.split(), len(t.split()))) for t in right]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    free = [i for i in range(20_000, 30_000) if held(i)]
    texts, probes = [(i, t) for i, t in rows if not held(i)], list(zip(free, right + wrong))
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(texts + probes, "doc_id long, text string")).collect()}
    for n in range(40):
        right, wrong = got[free[n]], got[free[n + 40]]
        assert abs(right.base_score - wrong.base_score) < 1e-6 and right.held_out and wrong.held_out
        assert right.score > 0.6 * wrong.score and right.score > right.base_score
