import math

import pytest
from pyspark.sql import functions as F

from quillon.__main__ import main
from quillon.functions.special import log2, log_factorial
from quillon.functions.text import clean, tokens
from quillon.operators import bayes, k2
from quillon.sources.matrices import bernoulli_matrix, parent_lines, parse_parent_lines, read_matrix, read_parent_list, read_parent_map, read_reviews, sample_matrix, write_matrix, write_parent_map


def edges(df):
    return {(r.child, r.step): (r.parent, round(r.score, 6)) for r in df.collect()}


def test_golden_sample(spark):
    assert edges(k2.k2(sample_matrix(spark), 3)) == {(0, 0): (-1, -7.927324), (1, 0): (-1, -7.927324), (1, 1): (0, -6.802395), (2, 0): (-1, -7.745003), (2, 1): (1, -5.192957)}


def test_score_does_not_depend_on_parent_order(spark):
    w = k2.compressed(sample_matrix(spark))
    rows = spark.createDataFrame([(2, 2, 0, 1), (2, 2, 1, 0)], "child int, r int, p1 int, p2 int")
    assert {round(r.score, 9) for r in k2.scores(w, rows, 2).collect()} == {-5.991464547}


def test_constant_and_duplicate_columns(spark):
    rows = [(i, [7, i % 2, i % 2, (i // 2) % 3, i % 2]) for i in range(60)]
    found = edges(k2.k2(spark.createDataFrame(rows, "rid long, v array<int>"), 5, u=9))
    assert {c for c, _ in found} == set(range(5))
    assert all(parent != 0 for (_, step), (parent, _) in found.items() if step)
    assert (0, 1) not in found and found[4, 1][0] == 1 and found[2, 1][0] == 1


def test_order_u_and_errors(spark):
    m = sample_matrix(spark)
    assert all(step == 0 for _, step in edges(k2.k2(m, 3, u=0)))
    assert edges(k2.k2(m, 3, order=[2, 1, 0]))[1, 1][0] == 2
    with pytest.raises(ValueError):
        k2.k2(m, 3, order=[0, 0, 1])
    with pytest.raises(ValueError, match="null cells"):
        k2.compressed(spark.createDataFrame([(0, [1, None])], "rid long, v array<int>"))
    assert k2.alpha(m, [(0, 1), (2, 1)]) == 4


def test_log_factorial(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 20, 21, 500, 10**6)], "n long").select("n", log_factorial(F.col("n")).alias("x")).collect()
    assert all(abs(r.x - math.lgamma(r.n + 1)) <= 1e-9 * max(1, r.x) for r in got)


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 0  1\n\n0.0 1 1\n")
    assert sorted(r.v for r in read_matrix(spark, str(tmp_path / "m.txt")).collect()) == [[0, 1, 1], [1, 0, 1]]
    rows = [(0, []), (1, [0]), (2, [1, 0])]
    back = parse_parent_lines(parent_lines(spark.createDataFrame(rows, "node int, parents array<int>"))).collect()
    assert sorted((r.node, r.parents) for r in back) == rows
    assert bernoulli_matrix(spark, 100, 3, 0.7, 1).collect() == bernoulli_matrix(spark, 100, 3, 0.7, 1).collect()


def test_text_and_bayes(spark):
    text = spark.createDataFrame([("see https://a.b/c/d now @x $y 12 &quot;The Élan, élan!",), (None,)], "text string")
    got = text.select(tokens(clean(F.col("text"))).alias("t")).collect()
    assert got[0].t == ["see", "élan"] and got[1].t == []
    docs = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (5, 0)], "doc_id long, label int")
    held = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 1)], "doc_id long, label int, idx int")
    vocab = spark.createDataFrame([(0,), (1,)], "idx int")
    assert {r.doc_id: r.predicted for r in bayes.naive_bayes(docs, held, vocab).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    parents = spark.createDataFrame([(0, None, None), (1, 0, None)], "node int, p1 int, p2 int")
    assert {r.doc_id: r.predicted for r in bayes.naive_bayes_k2(docs, held, parents).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


def test_width_and_children(spark):
    m = sample_matrix(spark)
    for n in (2, 4):
        with pytest.raises(ValueError, match="3 to 3 features"):
            k2.k2(m, n)
    with pytest.raises(ValueError, match="2 to 3 features"):
        k2.k2(m.unionByName(spark.createDataFrame([(99, [1, 0])], "rid long, v array<int>")), 3)
    for wrong in ({"u": -1}, {"children": [3]}):
        with pytest.raises(ValueError):
            k2.k2(m, 3, **wrong)
    every = edges(k2.k2(m, 3))
    assert edges(k2.k2(m, 3, children=[2])) == {k: v for k, v in every.items() if k[0] == 2}
    assert k2.k2(m.limit(0), 3).collect() == []


def test_blocks_and_rows_that_are_not_counted_change_nothing(spark, monkeypatch):
    rows = [(i, [(i * (j + 3) // 7 + (i % (j + 2) == 0)) % 2 for j in range(24)]) for i in range(200)]
    m = spark.createDataFrame(rows, "rid long, v array<int>")
    usual = edges(k2.k2(m, 24))
    monkeypatch.setattr(k2, "CHUNK", 7)
    assert edges(k2.k2(m, 24)) == usual
    assert sorted(k2.compressed(m, pays=0).groupBy("v").sum("w").collect()) == sorted(k2.compressed(m, pays=1).groupBy("v").sum("w").collect())
    assert k2.compressed(m, pays=0).count() == 200 > k2.compressed(sample_matrix(spark)).count()


def test_score_over_the_product_of_domains(spark):
    rows = [(i, [i % 3, (i // 2) % 2, i % 5 % 2, (i * i) % 3]) for i in range(40)]
    m = spark.createDataFrame(rows, "rid long, v array<int>")
    w = k2.compressed(m)
    candidates = spark.createDataFrame([(3, 2, 0, 1), (2, 2, 0, 1)], "child int, r int, p1 int, p2 int")
    for r in k2.scores(w, candidates, 2).collect():
        assert math.isclose(k2.score_over_product(m, r.child, [0, 1]).head().score, r.score, abs_tol=1e-9)
    assert round(k2.score_over_product(sample_matrix(spark), 0, []).head().score, 6) == -7.927324


def test_reviews_from_csv_to_accuracy(spark, tmp_path):
    (tmp_path / "r.csv").write_text('text,stars,useful\n"good, ""really""\ngood",5,1\nbad thing,1,0\ngood stuff,5,\nunclear,x,2\nbad bad,1,\n')
    got = read_reviews(spark, str(tmp_path / "r.csv"))
    assert got.dtypes == [("doc_id", "bigint"), ("text", "string"), ("stars", "int")]
    rows = got.orderBy("doc_id").collect()
    assert [(r.text, r.stars) for r in rows] == [('good, "really"\ngood', 5), ("bad thing", 1), ("good stuff", 5), ("unclear", None), ("bad bad", 1)]
    docs = bayes.head_per_class(got)
    found = bayes.term_incidence(docs)
    vocab = bayes.vocabulary(found, min_df=1)
    held = found.join(vocab, "term").select("doc_id", "label", "idx")
    assert bayes.accuracy(bayes.naive_bayes(docs, held, vocab)).head().accuracy == 1.0
    (tmp_path / "x.csv").write_text("text,rating\na,1\n")
    with pytest.raises(ValueError, match="stars"):
        read_reviews(spark, str(tmp_path / "x.csv"))


def test_maps_and_matrices_on_disk(spark, tmp_path):
    found = k2.parent_map(k2.k2(sample_matrix(spark), 3))
    assert {r.node: r.parents for r in found.collect()} == {0: [], 1: [0], 2: [1]}
    assert {r.node: (r.p1, r.p2) for r in k2.parents_by_column(k2.k2(sample_matrix(spark), 3)).collect()} == {0: (None, None), 1: (0, None), 2: (1, None)}
    for kind in ("text", "parquet", "json"):
        write_parent_map(found, f"{tmp_path}/{kind}", kind)
    assert {r.node: r.parents for r in read_parent_map(spark, f"{tmp_path}/text").collect()} == {0: [], 1: [0], 2: [1]}
    assert {r.node: r.parents for r in spark.read.parquet(f"{tmp_path}/parquet").collect()} == {0: [], 1: [0], 2: [1]}
    (tmp_path / "list.txt").write_text("[]\n[0]\n\n[1, 0]\n" + "".join(f"[{i}]\n" for i in range(2, 199)))
    got = {r.node: r.parents for r in read_parent_list(spark, f"{tmp_path}/list.txt").collect()}
    assert len(got) == 200 and got[0] == [] and got[2] == [1, 0] and got[199] == [198]
    write_matrix(sample_matrix(spark), f"{tmp_path}/m")
    assert sorted(r.v for r in read_matrix(spark, f"{tmp_path}/m").collect()) == sorted(r.v for r in sample_matrix(spark).collect())


def test_generator_and_log2(spark):
    cells = [x for r in bernoulli_matrix(spark, 3000, 5, 0.7, 3).collect() for x in r.v]
    assert abs(sum(cells) / len(cells) - 0.7) < 0.02
    rows = lambda *how: [r.v for r in bernoulli_matrix(spark, 20, *how).collect()]
    assert rows(1, 1.0) == [[1]] * 20 and rows(9, 0.0) == [[0] * 9] * 20
    assert rows(6, 0.5) == rows(6, 0.5, 0) != rows(6, 0.5, 1)
    with pytest.raises(ValueError, match="one feature"):
        rows(0, 0.5)
    assert [r[0] for r in spark.createDataFrame([(8.0,), (0.0,), (-1.0,)], "x double").select(log2(F.col("x"))).collect()] == [3.0, None, None]


def test_command_line(spark, tmp_path, capsys):
    write_matrix(sample_matrix(spark), f"{tmp_path}/m")
    main(["--matrix", f"{tmp_path}/m", "--features", "3"], spark)
    assert capsys.readouterr().out.splitlines() == ["0 [] -7.927324", "1 [0] -6.802395", "2 [1] -5.192957"]
    main(["--random", "50", "--features", "4", "--seed", "1", "--out", f"{tmp_path}/o"], spark)
    assert read_parent_map(spark, f"{tmp_path}/o").count() == 4
    for wrong in (["--random", "0"], ["--features", "3"], ["--random", "5", "--probability", "2"]):
        with pytest.raises(SystemExit):
            main(wrong, spark)


def test_entry_without_corpus_operators():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
