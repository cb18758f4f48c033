import random

import corpus_pipeline
import pytest

from quillon.llm import near_copies as module
from quillon.llm.near_copies import near_copies
from quillon.llm.op08_simhash import simhash


def shingle_set(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("most", "chunk"), [(32, 384), (2, 384), (2, 5)])
def test_near_copies_against_brute_force(spark, most, chunk):
    rng = random.Random(8)
    texts = [None, "", "a b", "A  b", "a b c d e f g h", "a b c d e f g h i"]
    for n in (12, 40, 60, 200):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts += [edited(rng, base, e) for e in (0, 0, 1, 1, 1, 2, 2, 3, n // 20, n // 15, n // 10)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    sets, up = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in up:
        for j in up:
            if i < j and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]) and root(i) != root(j):
                up[max(root(i), root(j))] = min(root(i), root(j))
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string"), most=most, chunk=chunk).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: root(i) for i in up} and len(got) == len(rows)
    assert len({root(i) for i in up}) < len(up) - 10


def test_pipeline_drops_copies_at_jaccard_08(spark):
    """One replaced word in 80: Jaccard 71 / 81 on five words, several bits apart as fingerprints."""
    rng, rows = random.Random(2), []
    for g in range(8):
        base = [f"g{g}x{i}" for i in range(80)]
        other = list(base)
        other[40] = f"other{g}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    rng.shuffle(rows)
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in left) == [2 * g for g in range(8)]
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([], "doc_id long, text string"), "").collect() == []


def test_simhash_links_come_first(spark, monkeypatch):
    """Without what the exact join adds, the groups are those of fingerprints within 4 bits, verified."""
    rng, texts = random.Random(4), ["", None, "a b", "A  b"]
    for n in (30, 80, 300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts += [edited(rng, base, e) for e in (0, 1, 1, 2, 2, 3, n // 10)]
        texts += [" ".join(base + [f"t{i}" for i in range(e)]) for e in (0, 1, 2, 5)]
    sets, fps = [shingle_set(t) for t in texts], [simhash((t or "").encode(), 5) for t in texts]

    def groups(linked):
        least = list(range(len(texts)))
        for _ in texts:
            for i, j in linked:
                least[i] = least[j] = min(least[i], least[j])
        return dict(enumerate(least))

    near = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])]
    close = [(i, j) for i, j in near if ((fps[i] ^ fps[j]) % 2**64).bit_count() <= 4 or sets[i] == sets[j]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda: {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    assert found() == groups(near)
    monkeypatch.setattr(module, "_apart", lambda pairs, joined: pairs.where("false"), raising=False)
    assert found() == groups(close) != groups(near)
    assert len(set(groups(close).values())) < len({frozenset(s) for s in sets})
