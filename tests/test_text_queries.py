import math
import random
from collections import Counter

import pytest

from quillon.plans.queries import ORACLE_SQL, QUERIES

WORDS = [f"term{chr(97 + i)}" for i in range(20)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """150 and 130 reviews of 20 words, some of which follow others. The last rows of a class have a word of their own."""
    rng, rows, at = random.Random(4), [], tmp_path_factory.mktemp("text")
    for i in range(280):
        held = {w for k, w in enumerate(WORDS) if rng.random() < 0.2 + k / 40}
        held |= {WORDS[k + 7] for k in range(13) if WORDS[k] in held and rng.random() < 0.8}
        rows.append((i, " ".join(sorted(held)) + (" lateword" if i in range(120, 150) else ""), int(i < 150)))
    spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows


def test_queries_with_sql_equal_it(spark, tables):
    """The same rows as DuckDB's, where every table is the one that this module writes."""
    duckdb = pytest.importorskip("duckdb")
    at, _ = tables
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet/*.parquet'")
    for name in ("k2_node_order", "k2_greedy_u2", "nb_predict", "k2nb_2parents", "k2nb_learnt", "term_matrix", "head_per_class", "matrix_synth", "snake_schedule"):
        got = QUERIES[name](spark, at)
        want = db.sql(ORACLE_SQL[name]).select(*got.columns).fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name


def matrix_of(rows):
    """(doc_id, 0/1 of 200) by brute force."""
    df = Counter(w for _, t, _ in rows for w in set(t.split()))
    vocab = sorted(w for w, n in df.items() if n >= 10)
    return {i: [int(k < len(vocab) and vocab[k] in t.split()) for k in range(200)] for i, t, _ in rows}, len(vocab)


def greedy(matrix, terms, u):
    lf = lambda n: math.lgamma(n + 1)

    def score(child, parents):
        by = Counter((tuple(v[p] for p in parents), v[child]) for v in matrix)
        r, n = len({v[child] for v in matrix}), Counter()
        for (c, _), a in by.items():
            n[c] += a
        return sum(lf(r - 1) - lf(m + r - 1) for m in n.values()) + sum(lf(a) for a in by.values())

    out = set()
    for child in range(terms):
        parents, old = [], score(child, [])
        while len(parents) < u and (left := [z for z in range(child) if z not in parents]):
            best, z = max((round(score(child, [*parents, z]), 9), -z) for z in left)
            if best <= old + 1e-9 * max(1, abs(old)):
                break
            parents, old = [*parents, -z], best
            out.add((child, len(parents), -z))
    return out


def test_k2_and_matrix_over_200_terms_against_brute_force(spark, tables):
    at, rows = tables
    matrix, terms = matrix_of(rows)
    assert terms > 12
    assert {r.doc_id: [int(x) for x in r.v] for r in QUERIES["term_matrix"](spark, at).collect()} == matrix
    for u in (1, 2):
        got = QUERIES[f"k2_greedy_u{u}"](spark, at).collect()
        assert {r.child for r in got} == set(range(200))
        assert {(r.child, r.step, r.parent) for r in got if r.step} == greedy(list(matrix.values()), terms, u)


def test_text_queries_over_all_reviews(spark, tables):
    at, rows = tables
    ids, run = {r[0] for r in rows}, lambda name: QUERIES[name](spark, at).collect()
    assert {r.doc_id for r in run("clean_text")} == ids
    assert {(r.doc_id, r.term) for r in run("term_incidence")} == {(i, w) for i, t, _ in rows for w in t.split()}
    df = Counter(w for _, t, _ in rows for w in set(t.split()))
    assert {r.term: r.df for r in run("vocabulary_topk")} == {w: n for w, n in df.items() if n >= 10} and df["lateword"] == 30
    for name in ("nb_predict", "k2nb_1parent", "k2nb_2parents", "k2nb_learnt"):
        assert {r.doc_id for r in run(name)} == ids
    assert [run(name)[0].n for name in ("nb_accuracy", "k2nb_accuracy", "k2nb_learnt_accuracy")] == [280, 280, 280]
    assert len(run("head_per_class")) == 200


def test_nb_over_all_reviews_against_brute_force(spark, tables):
    at, rows = tables
    matrix, terms = matrix_of(rows)
    by = {q: [sum(matrix[i][k] for i, _, label in rows if label == q) for k in range(terms)] for q in (0, 1)}
    lp = {q: [math.log((n + 1) / (sum(by[q]) + terms)) for n in by[q]] for q in by}
    score = lambda i, q: sum(x for x, has in zip(lp[q], matrix[i], strict=False) if has)
    assert {r.doc_id: r.predicted for r in QUERIES["nb_predict"](spark, at).collect()} == {i: int(score(i, 1) > score(i, 0) + 1e-9) for i in matrix}
