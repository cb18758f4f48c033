import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from quillon.llm import gru, op01_lm
from quillon.llm.common import Words


def ids_of(rng, high, sizes):
    return [rng.integers(0, high, n).astype("<u2") for n in sizes]


def test_every_window_is_learnt_from(monkeypatch):
    """Each target of each document gives a gradient once, whatever the round, also where a long one is cut."""
    docs = [np.arange(i, i + n).astype("<u2") for i, n in ((2, 100), (300, 41), (500, 7))]
    real_gradients, seen = gru.gradients, []

    def noted(p, bounds, x, y, keep, real, h, over):
        seen.extend(y[real].tolist())
        return real_gradients(p, bounds, x, y, keep, real, h, over)

    monkeypatch.setattr(gru, "gradients", noted)
    counts = np.ones(gru.VOCABULARY)
    for seed, most in ((0, 1024), (1, 30), (2, 1)):
        seen.clear()
        gru.train(gru.start(counts), np.full(gru.SIZE, 1e-3, np.float32), gru.classes(counts), docs, slots=2, length=10, rate=0.1, seed=seed, most=most)
        assert sorted(seen) == sorted(x for d in docs for x in d.tolist())


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    ids = ids_of(rng, 300, (40, 7, 1, 25))
    counts = np.bincount(np.concatenate(ids), minlength=gru.VOCABULARY) + 1.0
    flat, bounds = gru.start(counts).astype(np.float64), gru.classes(counts)
    p = gru.views(flat)
    packed = gru.pack(ids, 3)
    assert sorted(x for i in range(4) for x in packed[1][packed[3] == i].tolist()) == sorted(x for d in ids for x in d.tolist())
    x, y, keep, doc = next(gru.windows(packed, 16))
    h = np.zeros((gru.HIDDEN, x.shape[1]))
    loss, g, (rows, emb), _ = gru.gradients(p, bounds, x, y, keep, doc >= 0, h, 1)
    g["emb"] = np.zeros(gru.SHAPES["emb"])
    g["emb"][rows] = emb
    for name, d in g.items():
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        was = p[name][at]
        sides = []
        for e in (1e-3, -1e-3):
            p[name][at] = was + e
            sides.append(gru.gradients(p, bounds, x, y, keep, doc >= 0, h, 1)[0])
        p[name][at] = was
        assert abs((sides[0] - sides[1]) / 2e-3 - d[at]) < 1e-3 * max(1, abs(d[at]))


@pytest.mark.parametrize("counts", [np.ones(gru.VOCABULARY), 1e6 / np.arange(1, gru.VOCABULARY + 1), np.eye(1, gru.VOCABULARY)[0] * 1e9])
def test_classes_are_a_partition_and_probabilities_add_up(counts):
    bounds = gru.classes(counts)
    assert bounds[0] == 0 and bounds[1] == 1 and bounds[-1] == gru.VOCABULARY and (np.diff(bounds) > 0).all() and len(bounds) == gru.CLASSES + 1
    p, s = gru.views(gru.start(counts + 1)), np.random.default_rng(1).normal(0, 1, (gru.HIDDEN, 1)).astype(np.float32)
    every = gru.log_likelihood(p, bounds, np.repeat(s, gru.VOCABULARY, axis=1), np.arange(gru.VOCABULARY))
    assert abs(np.exp(every.astype(float)).sum() - 1) < 1e-4


def test_large_logits_don_t_overflow():
    counts = np.ones(gru.VOCABULARY)
    flat, bounds = gru.start(counts), gru.classes(counts)
    gru.views(flat)["wm"][:] = 40
    assert not gru.bounded(gru.views(flat)) and np.isfinite(gru.score(flat, bounds, ids_of(np.random.default_rng(2), 4000, (50, 3)), slots=2, length=9)).all()


def test_score_does_not_depend_on_packing():
    ids, counts = ids_of(np.random.default_rng(4), 2000, (300, 1, 60, 61, 2)), np.ones(gru.VOCABULARY)
    flat, bounds = gru.start(counts), gru.classes(counts)
    together = gru.score(flat, bounds, ids, slots=3, length=16)
    assert np.allclose(together, [gru.score(flat, bounds, [d], slots=1, length=5)[0] for d in ids], atol=1e-2)


def test_four_thousand_words_have_ids(spark):
    words = [f"w{i}".encode() for i in range(4094)]
    h, n = Words()([b" ".join(words)])
    docs = spark.createDataFrame([(1, b" ".join(words).decode())], "doc_id long, text string")
    got = op01_lm.encode(docs, h, np.ones(len(words)), 1, ["doc_id"], "text").head()
    assert n.tolist() == [4094] and got.n_unknown == 0 and len(set(np.frombuffer(got.ids, "<u2"))) == 4095


def test_words_are_told_apart_as_bytes_split_does():
    rng, words = random.Random(6), Words()
    texts = ["".join(rng.choice(["a", "B", "b", "é", "É", " ", "\n", "\x0b", "\x1f", "\u00a0", "."]) for _ in range(rng.randrange(60))).encode() for _ in range(300)] + [b"", b" ", b"x" * 3_000_000]
    h, n = words(texts)
    split = [t.lower().split() for t in texts]
    assert n.tolist() == [len(s) for s in split]
    flat = [w for s in split for w in s]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
    keys = np.unique(h)
    assert op01_lm.Index(keys[::2], bits=6)(keys).tolist() == [i // 2 if i % 2 == 0 else -1 for i in range(len(keys))]


def test_base_score_by_brute_force_and_model_beats_it(spark, monkeypatch):
    """Words follow each other in a fixed order, so that a model of sequences must win on documents held out."""
    rng, rows = random.Random(9), []
    for i in range(700):
        at, out = rng.randrange(40), []
        for _ in range(rng.randrange(1, 120)):
            out.append(f"Wort{at}" if rng.random() < 0.9 else f"rare{rng.randrange(3000)}")
            at = (at * 7 + 3) % 40
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(out)))
    rows += [(700, None), (701, ""), (702, " \n ")]
    tokens = {i: (t or "").lower().split() + [None] for i, t in rows}
    c = Counter(t for i, ts in tokens.items() if crc32(str(i).encode()) % 7 != 2 for t in ts)
    n, v = sum(c.values()), len(c)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1 << 17, 64):
        monkeypatch.setattr(op01_lm, "HEAD", most)
        got = op01_lm.lm_score(docs, rounds=3, copies=2).collect()
        assert len(got) == len(rows)
        for r in got:
            ts = tokens[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc32(str(r.doc_id).encode()) % 7 == 2, len(ts), sum(c[t] > 0 for t in ts), n)
            assert math.isclose(r.base_score, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
        held = [r for r in got if r.held_out]
        if most > 64:
            assert len(held) > 50 and sum(r.score for r in held) > sum(r.base_score for r in held) * 0.95
