import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import op02_order_minhash as op2
from quillon.llm import op06_license as op6
from quillon.llm import op08_simhash as op8
from quillon.llm import op10_pii as op10
from quillon.llm.components import components
from quillon.llm.op01_lm import lm_score
from quillon.llm.op03_exact_dedup import exact_dedup
from quillon.llm.op04_mixing import mix
from quillon.llm.op05_line_dedup import line_dedup
from quillon.llm.op07_bpe import bpe, decode, encode_text, encoding, pieces, vocabulary
from quillon.llm.op09_toxicity import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept long, spans string, fp string"
LONG = "This line is well over forty code points long, É and all."


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i is None else f"src{i % 3}", 0, 1, "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    rows = [(i, f"word{i} a b c d e f g {LONG}\n{LONG.upper() if i % 2 else LONG} ") for i in range(8)]
    return docs(spark, [*rows, (7, rows[7][1]), (None, "null id"), (8, None), (9, ""), (10, "w " * 30_000), (11, "x" * 50_000), (12, None)])


def run_all(spark, d, labels):
    v = vocabulary()
    return {
        "lm": lambda: lm_score(d, rounds=1), "omh": lambda: op2.order_minhash(d), "exact": lambda: exact_dedup(d), "mix": lambda: mix(d), "lines": lambda: line_dedup(d), "license": lambda: op6.license_scan(d),
        "bpe": lambda: bpe(d, **v), "simhash": lambda: op8.near_dedup(d), "toxicity": lambda: toxicity(d, labels), "pii": lambda: op10.pii_spans(d),
    }


@pytest.mark.parametrize("name", ["lm", "omh", "exact", "mix", "lines", "license", "bpe", "simhash", "toxicity", "pii"])
def test_odd_rows_and_empty_tables(spark, odd, name):
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = run_all(spark, odd, labels)[name]().collect()
    assert len(got) == odd.count() if name != "mix" else len(got) > 0
    assert run_all(spark, odd.limit(0), labels.limit(0))[name]().collect() == []


def test_exact(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs(spark, [(1, "a"), (2, "a"), (3, None), (4, ""), *((i, "hot") for i in range(10, 60))])).collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (10, 59, 50, False), (59, 59, 50, True)} <= got


def test_lines(spark):
    d = docs(spark, [*((i, f"own {i}\n {LONG}\t\n{LONG.upper().replace('É', 'É')}") for i in range(5)), (9, LONG[:30])])
    got = {r.doc_id: r for r in line_dedup(d, batches=3).collect()}
    assert got[4].n_dropped == 0 and got[0].n_dropped == 2 and got[0].kept_text == "own 0" and got[0].n_lines == 3 and got[9].n_dropped == 0


def test_pii_against_brute_force(spark):
    text = "a@b.cc_x@y.zz. 1.2.3.4.5 999.1.2.3 GB82 WEST 1234 5698 7654 32 +1 (23) 456-7890 card 4111 1111 1111 1111, 𝒳 k@l.mn"
    got = op10.pii_spans(docs(spark, [(1, text)])).head().spans
    assert [(s.kind, text[s.start : s.end]) for s in got if s.kind == "email"] == [("email", m[0]) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert {(s.kind, s.t) for s in got} >= {("ip", "1.2.3.4"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (23) 456-7890")}
    assert not any(s.t == "999.1.2.3" for s in got)


def test_license():
    words, base, first, last, base_labels, labels, score, free, exprs = op6.scan(b"CC BY. SPDX-License-Identifier: (MIT OR GPL-2.0) AND Apache-2.0\nall rights reserved")
    assert (base, first, base_labels, exprs) == (2, 0, "cc-by,reserved", "mit gpl-2.0 or apache-2.0 and") and "mit" in labels and 0 < score < 1
    assert op6.to_rpn(b"mit or") == ["mit"] and op6.to_rpn(b")") == [] and op6.evaluate(op6.to_rpn(b"gpl-3.0 or mit"))[0] == 1.0


def test_bpe_cuts_and_round_trip(spark):
    v, rng = vocabulary(), random.Random(1)
    enc = encoding(**v)
    for _ in range(30):
        text = "".join(rng.choice(["a", "é", "1", "'s", " ", "  ", "\n", "!", "词", " ", "<|endoftext|>"]) for _ in range(600))
        assert "".join(pieces(text, 20)) == text
        assert encode_text(enc, text, 20).tolist() == enc.encode_ordinary(text)
    texts = ["", "a", "héllo wörld 12345  x\n\n<|endoftext|> 𝒳", "word " * 3000 + "x" * 5000, None]
    for r in bpe(docs(spark, list(enumerate(texts))), **v, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256")).collect():
        text = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert (r.n_tokens, list(r.ids)) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    got = decode(bpe(docs(spark, [(1, "héllo wörld"), (2, None)]), **v), **v).collect()
    assert [bytes(r.decoded) for r in sorted(got, key=lambda r: r.doc_id)] == ["héllo wörld".encode(), b""]


def near(a, b, tau):
    return bin((a ^ b) & (2**64 - 1)).count("1") <= tau


@pytest.mark.parametrize(("tau", "most"), [(2, None), (2, 0), (2, 4), (0, None), (1, 0), (1, 4), (3, 0), (3, None), (4, 0), (4, 30)])
def test_simhash_links_connect_what_is_near(spark, tau, most):
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centre for _ in range(6)} | {centre[0] ^ (1 << i) for i in range(20)} | {0, 2**63})
    signed = [op8.signed(x) for x in fps]
    got = {r.node: r.root for r in components(op8.links(spark.createDataFrame([(x,) for x in signed], "fp long"), tau=tau, most_candidates=most)).collect()}
    up = {x: x for x in signed}
    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if near(a, b, tau) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    assert all(got.get(x, x) == root(x) for x in signed)


@pytest.mark.parametrize("hubs", [1, 20, 10**6])
def test_components_with_and_without_hubs(spark, monkeypatch, hubs):
    from quillon.llm import components as c

    monkeypatch.setattr(c, "HUBS", hubs)
    rng = random.Random(6)
    pairs = [(1000, i) for i in range(200)] + [(i, i + 1) for i in range(300, 380)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(250)] + [(-5, 2000 + i) for i in range(100)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for p in pairs:
        a, b = sorted(map(root, p))
        up[b] = a
    want = {x: root(x) for x in up if root(x) != x}
    got = components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_thresholds_add_up():
    t, cost = op8.allocate(np.array([[1.0, 500, 2], [1, 1, 1]]), np.array([21.0, 21, 22]), np.array([0.1] * 3), 2)
    assert (t.sum(axis=1) == 0).all() and t[0, 1] == -1 and cost[1] == 3


def test_order_minhash(spark):
    rows = [(5, "a b c d e f g h i j k l"), (2, "zzz"), (9, None), (7, "é" * 7)]
    got = {r.doc_id: r for r in op2.order_minhash(docs(spark, rows)).collect()}
    order = [(i, t or "") for i, t in sorted(rows)]
    for k, (i, t) in enumerate(order):
        other, h = order[(k + 1) % 4][1], len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - h] + other[:h]).encode()).hexdigest() and got[i].n_chars == len(t)
    same = spark.createDataFrame([("a b c d e f a b c d e f a b c d e",), ("a b c d e f a b c d e f a b c d e",), ("a b c d e f a b c d e",)], "t string")
    sigs = [r.s for r in op2.signature(same, F.col("t"), "s").collect()]
    assert sigs[0] == sigs[1] != sigs[2]


def test_mixing_takes_shortages_from_siblings(spark):
    rows = [(i, "w " * 10) for i in range(30)]
    d = docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") < 3, "de").otherwise("en"))
    got = mix(d, tree={"lang": F.col("lang"), "source": F.col("source")}, weights={"lang": {"de": 1, "en": 1}}, share=0.5, max_epochs=1)
    by = {r.lang: r.n for r in got.groupBy("lang").agg(F.sum("copies").alias("n")).collect()}
    assert by == {"de": 3, "en": 12}
