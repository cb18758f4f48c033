"""Operators that SQL can't express, against plain Python on small fixtures."""

import random
import re
import struct
import time
from zlib import crc32

import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import op02_order_minhash as op2
from quillon.llm import op06_license as op6
from quillon.llm import op08_simhash as op8
from quillon.llm import op10_pii as op10
from quillon.llm.op03_exact_dedup import exact_dedup
from quillon.llm.op04_mixing import mix
from quillon.llm.op05_line_dedup import line_dedup
from quillon.llm.op09_toxicity import toxicity


def texts_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# ---- Order MinHash ------------------------------------------------------------------------------
def chained(parts):
    """Spark's xxhash64 of several values: each one's hash is the next one's seed."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<q", p), h)
    return h


def signature(text, k=5, bins=32, least=2):
    words = (text or "").split()
    if not words:
        return [None] * bins
    seen, elements = {}, []
    for i in range(max(len(words) - k, 0) + 1):
        h = chained(words[i : i + k]) & op2.TOP
        o = seen[h] = seen.get(h, -1) + 1
        e = xxhash.xxh64_intdigest(struct.pack("<i", o), xxhash.xxh64_intdigest(struct.pack("<q", h), 42)) & op2.TOP
        elements.append((e, i + 1))
    elements.sort()
    out = []
    for b in range(bins):
        start = sum(e >> 32 < b for e, _ in elements)
        picked = [elements[(start + j) % len(elements)] for j in range(least)]
        out.append(chained([e for e, _ in sorted(picked, key=lambda x: (x[1], x[0]))]) & 0xFFFFFFFF)
    return out


def test_order_minhash_signatures(spark):
    rng = random.Random(1)
    texts = [None, "", "one", "a b", "a b c d e", "a b c d e f", "a b c d e a b c d e a b c d e"]
    texts += [" ".join(rng.choice("abcdefgh") + (str(rng.randrange(50)) if rng.random() < 0.7 else "") for _ in range(n)) for n in (7, 12, 40, 90, 300)]
    got = [r.s for r in op2.signature(texts_of(spark, texts), F.col("text"), "s").orderBy("doc_id").collect()]
    assert got == [signature(t) for t in texts]


def test_order_minhash_likeness_follows_edits(spark):
    rng = random.Random(2)
    for n in (40, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        edited = lambda m: [w if i not in m else "new" for i, w in enumerate(base)]  # noqa: E731, B023
        sides = [base, edited({n // 2}), edited(set(rng.sample(range(n), n // 8))), base[n // 2 :] + base[: n // 2], [f"x{i}" for i in range(n)]]
        df = spark.createDataFrame([(i, " ".join(base), " ".join(s)) for i, s in enumerate(sides)], "i long, a string, b string")
        both = op2.signature(op2.signature(df, F.col("a"), "x"), F.col("b"), "y").withColumn("l", op2.likeness("x", "y")).orderBy("i").collect()
        for r in both:
            assert r.l == sum(p == q for p, q in zip(signature(r.a), signature(r.b), strict=True)) / 32
        same, one, some, swapped, other = (r.l for r in both)
        assert same == 1 and 0.5 < one < 1 and some < one and other == 0
        assert swapped < 0.85  # the same words in the same places but for one cut: nearly the same k-mers, another order


# ---- licences -----------------------------------------------------------------------------------
def test_license_places(spark):
    rng, parts = random.Random(3), ["CC", "by", "BY", "cc by", "General", "public", "license", "All rights", "reserved", "é", "x1", "\x7f", "nc"]
    texts = [None, "", "cc by"] + ["".join(rng.choice(parts) + rng.choice([" ", "-", "\n", "", " . "]) for _ in range(rng.randrange(60))) for _ in range(300)]
    got = {r.doc_id: r for r in op6.license_scan(texts_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted((k, label) for p, label in op6.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), *((places[0][0], places[-1][0]) if places else (None, None)))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_expressions_and_linear_time():
    assert op6.to_rpn(b"x MIT OR (Apache-2.0 AND GPL-2.0 WITH Classpath) junk more", 2) == ["mit", "apache-2.0", "gpl-2.0", "classpath", "with", "and", "or"]
    assert op6.to_rpn(b"mit and (bsd or") == ["mit"] and op6.to_rpn(b"mit or\nbsd") == ["mit"]
    for text in (b"SPDX-License-Identifier: MIT " * 100_000, b"SPDX-License-Identifier: MIT\n" * 100_000, b"SPDX-License-Identifier: " + b"MIT OR " * 400_000 + b"BSD", b"SPDX-License-Identifier: " + b" OR ".join(b"l%d" % i for i in range(60_000)), b"lesser general public license cc by nc " * 60_000):
        began = time.time()
        got = op6.scan(text)
        assert time.time() - began < 20 and got[5]


# ---- SimHash ------------------------------------------------------------------------------------
def fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints_and_components(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "a", "A", "a b", "a b c", "a b c d", "a b c a b c a b c", "é É x y"]
    for _ in range(25):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 400))]
        texts += [" ".join(base), " ".join(base[:-1]), " ".join([*base, "tail"])]
    got = {r.doc_id: r for r in op8.near_dedup(texts_of(spark, texts)).collect()}
    fps = [fingerprint(t) for t in texts]
    assert [got[i].fp % 2**64 for i in range(len(texts))] == fps
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert [got[i].component_id for i in range(len(texts))] == [root(i) for i in range(len(texts))]


# ---- toxicity -----------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def judged(spark):
    rng, rows = random.Random(5), []
    for i in range(1500):
        toxic = rng.random() < 0.3
        words = [f"word{rng.randrange(400)}" for _ in range(rng.randrange(20, 80))]
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["you scum", "vile trash", "hate them"]))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), {i: y for i, _, y in rows}


def test_toxicity_on_held_out_rows(judged):
    docs, labels, truth = judged
    got = toxicity(docs, labels).collect()
    assert len(got) == len(truth) and all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held)


def test_toxicity_neither_learns_from_held_out_labels_nor_exceeds_its_sample(judged):
    docs, labels, _ = judged
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda d, y, **how: {(r.doc_id, r.text): r.score for r in toxicity(d, y, epochs=2, **how).collect()}
    own = scores(docs, labels)
    assert own == scores(docs, turned)
    assert own == scores(docs.withColumns({"lang": F.lit("x"), "source": F.col("doc_id").cast("string")}), labels)
    few = scores(docs, labels, fit_rows=100)
    assert few != own and few == scores(docs.unionByName(docs), labels, fit_rows=100)  # rows that repeat are one


# ---- personal data ------------------------------------------------------------------------------
def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def digits_of(t):
    return re.sub("[^0-9]", "", t)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(digits_of(t)) <= 19 and luhn(digits_of(t))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits_of(t)) <= 15),
}


def test_base_kinds_equal_re(spark):
    rng = random.Random(6)
    parts = ["a", "B9", "@", ".", "-", "+", "%", " ", "  ", "\n", "1", "12", "255", "256", "0001", "4111 1111 1111 1111", "5500-0000-0000-0004", "+1 (23) 456-7890", "10.0.0.1", "x@y.zz", "é", "𝒳", "(", ")"]
    texts = [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 80))) for _ in range(1500)] + [" ".join(["a@b.c 1.2.3.4 +1 234 567 890"] * 400)]
    got = {r.doc_id: r.spans for r in op10.pii_spans(texts_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        for kind, (pattern, valid) in BASE.items():
            assert [(s.start, s.end, s.t) for s in got[i] if s.kind == kind] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t or "") if valid(m[0])], (t, kind)


def test_iban_before_words_and_context(spark):
    good = ["GB82 WEST 1234 5698 7654 32", "gb82west12345698765432", "DE89370400440532013000"]
    texts = [f"{g} A B" for g in good] + [f"{g} IBAN ACCOUNT" for g in good] + ["GB82 WEST 1234 5698 7654 33", "GB82WEST123456987654321"]
    got = [[s.t for s in r.spans if s.kind == "iban"] for r in op10.pii_spans(texts_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [[g] for g in good] * 2 + [[], []]
    rng = random.Random(7)
    texts = ["".join(rng.choice(["x" * rng.randrange(30), " mail ", "a@b.c", "é", "𝒳", " "]) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    for r in op10.pii_spans(texts_of(spark, texts)).collect():
        for s in (s for s in r.spans if s.kind == "email"):
            near = r.text[max(0, s.start - 40) : s.start] + " " + r.text[s.end : s.end + 40]
            assert s.score == pytest.approx(0.8 + 0.2 * bool(re.search("(?i)mail|contact|write|address", near)))


def test_many_spans_take_linear_time(spark):
    df = texts_of(spark, ["a@b.c " * 40_000, "1.2.3.4 " * 30_000, "a@b" + ".c" * 60_000])
    began = time.time()
    assert [len(r.spans) for r in op10.pii_spans(df).orderBy("doc_id").collect()] == [40_000, 30_000, 1]
    assert time.time() - began < 60


# ---- dedup and mixing ---------------------------------------------------------------------------
def test_hot_and_cold_digests_are_treated_alike(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, f"text {min(rng.randrange(1, 40) ** 2 // 30, 20)}") for i in range(600)], "doc_id long, text string")
    rows = lambda **how: sorted(map(tuple, exact_dedup(df, **how).collect()))
    assert rows() == rows(capacity=1) == rows(min_copies=10**6)


def test_heavy_lines_and_runs_that_go(spark, monkeypatch):
    from quillon.llm import op05_line_dedup as op5

    rng = random.Random(9)
    lines = [f"line number {i} is repeated over many documents here" for i in range(30)]
    df = texts_of(spark, ["\n".join([f"own {i}", *rng.sample(lines[: 3 + i % 28], 3)]) for i in range(120)])
    rows = lambda: sorted((r.doc_id, r.n_dropped, r.kept_text) for r in line_dedup(df, batches=3).collect())
    tables = spark.catalog.listTables()
    usual = rows()
    for heavy in (1, 20):
        monkeypatch.setattr(op5, "HEAVY", heavy)
        assert rows() == usual
    assert sum(n for _, n, _ in usual) > 100
    monkeypatch.setattr(op5.LineRuns, "at_least", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        line_dedup(df)
    assert spark.catalog.listTables() == tables


def test_weight_zero_leaves_its_share_to_others(spark):
    rows = [("A", "x")] * 40 + [("A", "y")] * 10 + [("B", "z")] * 100
    df = spark.createDataFrame([(i, "w", d, s) for i, (d, s) in enumerate(rows)], "doc_id long, text string, d string, s string")
    got = mix(df, tree={"d": F.col("d"), "s": F.col("s")}, weights={"s": {"x": 0}}, share=0.5, max_epochs=1).groupBy("s").agg(F.sum("copies").alias("n")).collect()
    assert {r.s: r.n for r in got} == {"y": 10, "z": 65}
    got = mix(df, tree={"d": F.col("d"), "s": F.col("s")}, weights={"d": {"B": 0}, "s": {"y": 0}}, share=0.5, max_epochs=1).groupBy("s").agg(F.sum("copies").alias("n")).collect()
    assert {r.s: r.n for r in got} == {"x": 40}
