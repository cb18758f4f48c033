"""The registered queries of the structure-learning and text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.text import PUNCTUATION, REMOVED, STOP_WORDS, clean
from quillon.operators import bayes, k2
from quillon.plans.settle import settle
from quillon.sources.matrices import SAMPLE, bernoulli_matrix, parent_lines, parse_parent_lines, sample_matrix

TERMS = 200


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- inputs -------------------------------------------------------------------------------------
def reviews(spark, sf_dir):
    """Labelled English documents as reviews of 5 or 1 stars."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return docs.where("lang = 'en'").join(labels, "doc_id").select("doc_id", "text", F.when(F.col("quality") == 1, 5).otherwise(1).alias("stars"))


def _text(spark, sf_dir, most=TERMS):
    """All labelled reviews, the terms they hold (settled), and the vocabulary."""
    docs = bayes.labelled(reviews(spark, sf_dir))
    found = settle(bayes.term_incidence(docs))
    return docs, found, settle(bayes.vocabulary(found, most=most))


def lineitem_matrix(spark, sf_dir):
    """Flag, status, line number, discount and tax in hundredths, quantity by tens."""
    code = lambda c, names: F.coalesce(*[F.when(F.col(c) == n, i) for i, n in enumerate(names)], F.lit(len(names)))
    cells = [code("l_returnflag", "ANR"), code("l_linestatus", "FO"), F.col("l_linenumber"), F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100), F.floor(F.col("l_quantity") / 10)]
    return _table(spark, sf_dir, "lineitem").select(F.array(*[c.cast("int") for c in cells]).alias("v"))


def text_matrix(spark, sf_dir):
    docs, found, vocab = _text(spark, sf_dir)
    return bayes.term_matrix(docs, found, vocab, TERMS)


SQL_REVIEWS = """
rv AS (SELECT doc_id, text, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS label FROM documents JOIN labels USING (doc_id) WHERE lang = 'en'),
hd AS (SELECT doc_id, text, label FROM rv)"""
SQL_HEAD = "SELECT doc_id, text, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS n FROM rv) WHERE n <= 100"
_cleaned = "text"
for _p in REMOVED:
    _cleaned = f"regexp_replace({_cleaned}, '{_p}', '', 'g')"
_cleaned = f"translate({_cleaned}, '{PUNCTUATION.replace(chr(39), chr(39) * 2)}', '')"
SQL_TERMS = f"""{SQL_REVIEWS},
cl AS (SELECT doc_id, label, {_cleaned} AS text FROM hd),
tm AS (SELECT DISTINCT doc_id, label, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM cl),
ti AS (SELECT * FROM tm WHERE term NOT IN ({', '.join(f"'{w}'" for w in STOP_WORDS)})),
top AS (SELECT term, count(*) AS df FROM ti GROUP BY term HAVING count(*) >= 10 ORDER BY df DESC, term LIMIT {{most}}),
vo AS (SELECT term, df, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx FROM top)"""


def sql_terms(most: int) -> str:
    return SQL_TERMS.replace("LIMIT {most}", f"LIMIT {most}")


SQL_TEXT_MATRIX = sql_terms(TERMS) + f""",
m AS (SELECT doc_id, list_transform(range({TERMS}), lambda i: CASE WHEN list_contains(t, i) THEN 1 ELSE 0 END) AS v
  FROM hd LEFT JOIN (SELECT doc_id, list(idx) AS t FROM ti JOIN vo USING (term) GROUP BY doc_id) USING (doc_id))"""
SQL_TEXT_MATRIX = SQL_TEXT_MATRIX.replace("list_contains(t, i)", "coalesce(list_contains(t, CAST(i AS INTEGER)), false)")
SQL_LINEITEM = """
m AS (SELECT [CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END, CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END,
  l_linenumber, CAST(round(l_discount * 100) AS INTEGER), CAST(round(l_tax * 100) AS INTEGER), CAST(floor(l_quantity / 10) AS INTEGER)] AS v FROM lineitem)"""
SQL_SAMPLE = "m AS (SELECT unnest([" + ", ".join(str(r) for r in SAMPLE) + "]) AS v)"


def k2_sql(matrix: str, order: list[int], u: int) -> str:
    """The greedy search, a few common table expressions for each level."""
    lf = lambda x: f"lgamma(CAST({x} AS DOUBLE) + 1)"
    out = [matrix, "w AS (SELECT v, count(*) AS w FROM m GROUP BY v)", f"o AS (SELECT unnest({list(range(len(order)))}) AS ord, unnest({order}) AS node)"]
    out.append("r AS (SELECT node, count(DISTINCT v[node + 1]) AS r FROM w, o GROUP BY node)")
    out.append(f"""s0 AS (SELECT child, sum({lf('a')}) + any_value({lf('r - 1')}) - {lf('sum(a) + any_value(r) - 1')} AS score
      FROM (SELECT o.node AS child, v[o.node + 1] AS x, sum(w) AS a, any_value(r) AS r FROM w, o JOIN r ON r.node = o.node GROUP BY ALL) GROUP BY child)""")
    out.append("t0 AS (SELECT child, score, true AS active FROM s0)")
    for k in range(1, u + 1):
        ps = [f"p{t}" for t in range(1, k)]
        pre = "".join(f"{p}, " for p in ps)
        out.append(f"""d{k} AS (SELECT t.child, {"".join(f't.{p}, ' for p in ps)}c.node AS cand, r.r FROM t{k - 1} t JOIN o oc ON oc.node = t.child JOIN o c ON c.ord < oc.ord JOIN r ON r.node = t.child
          WHERE t.active{"".join(f' AND c.node <> t.{p}' for p in ps)})""")
        cfg = "".join(f"v[{p} + 1] AS c_{p}, " for p in ps) + "v[cand + 1] AS c_c"
        names = "".join(f"c_{p}, " for p in ps) + "c_c"
        out.append(f"n{k} AS (SELECT child, {pre}cand, r, {cfg}, v[child + 1] AS x, sum(w) AS a FROM w, d{k} GROUP BY ALL)")
        out.append(f"g{k} AS (SELECT child, {pre}cand, r, {names}, sum(a) AS n, sum({lf('a')}) AS i FROM n{k} GROUP BY child, {pre}cand, r, {names})")
        out.append(f"s{k} AS (SELECT child, {pre}cand, sum({lf('r - 1')} - {lf('n + r - 1')} + i) AS score FROM g{k} GROUP BY child, {pre}cand)")
        out.append(f"b{k} AS (SELECT * FROM s{k} QUALIFY row_number() OVER (PARTITION BY child ORDER BY round(score, 9) DESC, cand) = 1)")
        out.append(f"""t{k} AS (SELECT b.child, {"".join(f'b.{p}, ' for p in ps)}b.cand AS p{k}, b.score, true AS active FROM b{k} b JOIN t{k - 1} t USING (child) WHERE b.score > t.score + 1e-9 * greatest(1.0, abs(t.score)))""")
    rows = ["SELECT child, 0 AS step, -1 AS parent, round(score, 6) AS score FROM t0"] + [f"SELECT child, {k}, p{k}, round(score, 6) FROM t{k}" for k in range(1, u + 1)]
    return "WITH " + ",\n".join(out) + "\n" + " UNION ALL ".join(rows)


def _k2(matrix, n, **how):
    def query(spark, sf_dir):
        return k2.k2(matrix(spark, sf_dir), n, **how).withColumn("score", F.round("score", 6))

    return query


def _sample(spark, sf_dir):
    return sample_matrix(spark)


# ---- single operators ---------------------------------------------------------------------------
def attr_domains(spark, sf_dir):
    return k2.attribute_domains(lineitem_matrix(spark, sf_dir)).select("pos", "r", F.array_join(F.col("vals").cast("array<string>"), ",").alias("vals"))


def alpha_counts(spark, sf_dir):
    """Counts of (parent value, child value) of all pairs of features, the parent being the earlier."""
    weighted = k2.compressed(lineitem_matrix(spark, sf_dir))
    pairs = spark.createDataFrame([(i, 0, j) for i in range(6) for j in range(i)], "child int, r int, p1 int")
    return k2.contingency(weighted, pairs, 1).select("child", "cand", "c1", "x", "a")


def k2_score_pairs(spark, sf_dir):
    matrix = k2.compressed(lineitem_matrix(spark, sf_dir))
    sizes = {p: r for p, r in k2.attribute_domains(matrix).select("pos", "r").collect()}
    pairs = spark.createDataFrame([(i, sizes[i], j) for i in range(6) for j in range(i)], "child int, r int, p1 int")
    return k2.scores(matrix, pairs, 1).withColumn("score", F.round("score", 4))


def head_query(spark, sf_dir):
    return bayes.head_per_class(reviews(spark, sf_dir))


def clean_text(spark, sf_dir):
    return bayes.labelled(reviews(spark, sf_dir)).select("doc_id", clean(F.col("text")).alias("text"))


def vocabulary_topk(spark, sf_dir):
    return _text(spark, sf_dir)[2]


def term_incidence(spark, sf_dir):
    return bayes.term_incidence(bayes.labelled(reviews(spark, sf_dir)))


def term_matrix(spark, sf_dir):
    return text_matrix(spark, sf_dir).select("doc_id", F.array_join(F.col("v").cast("array<string>"), "").alias("v"))


def _held(spark, sf_dir):
    docs, found, vocab = _text(spark, sf_dir)
    return docs, found.join(F.broadcast(vocab), "term").select("doc_id", "label", "idx"), vocab


def nb_predict(spark, sf_dir):
    return bayes.naive_bayes(*_held(spark, sf_dir))


def _rule(count):
    """A stored parent map: node j has none if 4 divides it, else j // 2, and j - 1 where two are kept."""
    def parents(j):
        found = [] if j % 4 == 0 else sorted({j // 2, *([j - 1] if count == 2 else [])})
        return (j, *(found + [None, None])[:2])

    return [parents(j) for j in range(200)]


def _k2nb(count):
    def query(spark, sf_dir):
        docs, held, _ = _held(spark, sf_dir)
        return bayes.naive_bayes_k2(docs, held, spark.createDataFrame(_rule(count), "node int, p1 int, p2 int"))

    return query


def k2nb_learnt(spark, sf_dir):
    """Reviews to predictions, with the parents that structure learning finds in them."""
    docs, held, vocab = _held(spark, sf_dir)
    n = vocab.count()
    matrix = bayes.term_matrix(docs, held.join(F.broadcast(vocab), "idx").select("doc_id", "term"), vocab, TERMS)
    parents = k2.parents_by_column(k2.k2(matrix, TERMS, u=1)).where(F.col("node") < n)
    return bayes.naive_bayes_k2(docs, held, parents)


def nb_accuracy(spark, sf_dir):
    return bayes.accuracy(nb_predict(spark, sf_dir))


def k2nb_accuracy(spark, sf_dir):
    return bayes.accuracy(_k2nb(1)(spark, sf_dir))


def k2nb_learnt_accuracy(spark, sf_dir):
    return bayes.accuracy(k2nb_learnt(spark, sf_dir))


def parent_map_text(spark, sf_dir):
    """Written as lines and parsed again."""
    rows = [(j, [p for p in ps if p is not None]) for j, *ps in _rule(2)]
    back = parse_parent_lines(parent_lines(spark.createDataFrame(rows, "node int, parents array<int>")))
    return back.select("node", F.array_join(F.col("parents").cast("array<string>"), ",").alias("parents"))


def snake_schedule(spark, sf_dir):
    return k2.snake_schedule(spark, 100, 7)


def matrix_synth(spark, sf_dir):
    return bernoulli_matrix(spark, 1000, 10, 0.7, seed=10).select("rid", F.array_join(F.col("v").cast("array<string>"), "").alias("v"))


_HELD = sql_terms(200) + ", hv AS (SELECT doc_id, label, idx FROM ti JOIN vo USING (term))"
_NB = f"""WITH {_HELD},
tot AS (SELECT label, count(*) AS t FROM hv GROUP BY label), sz AS (SELECT count(*) AS size FROM vo),
lp AS (SELECT l.label AS c, vo.idx, ln((coalesce(n, 0) + 1) / (t + size)) AS lp FROM vo CROSS JOIN (SELECT DISTINCT label FROM hd) l CROSS JOIN sz JOIN tot ON tot.label = l.label
  LEFT JOIN (SELECT label, idx, count(*) AS n FROM hv GROUP BY ALL) b ON b.label = l.label AND b.idx = vo.idx),
sc AS (SELECT doc_id, sum(lp) FILTER (c = 1) AS p1, sum(lp) FILTER (c = 0) AS p0 FROM hv JOIN lp USING (idx) GROUP BY doc_id),
pr AS (SELECT doc_id, label, CASE WHEN p1 > p0 + 1e-9 THEN 1 ELSE 0 END AS predicted FROM hd LEFT JOIN sc USING (doc_id))"""


def _k2nb_sql(count):
    rows = ", ".join(f"({j}, {'NULL' if a is None else a}, {'NULL' if b is None else b})" for j, a, b in _rule(count))
    return _k2nb_given(f"WITH {_HELD}", f"SELECT CAST(a AS INTEGER) AS node, CAST(b AS INTEGER) AS p1, CAST(c AS INTEGER) AS p2 FROM (VALUES {rows}) t(a, b, c)")


def _k2nb_given(tables, parents):
    return f"""{tables},
pm AS ({parents}),
bs AS (SELECT doc_id, label, node FROM hd CROSS JOIN (SELECT pm.* FROM pm JOIN vo ON vo.idx = node)
  WHERE (p1 IS NULL OR (doc_id, p1) IN (SELECT (doc_id, idx) FROM hv)) AND (p2 IS NULL OR (doc_id, p2) IN (SELECT (doc_id, idx) FROM hv))),
cp AS (SELECT label AS c, node, avg(CASE WHEN h.idx IS NULL THEN 0.0 ELSE 1.0 END) AS p FROM bs LEFT JOIN (SELECT doc_id, idx FROM hv) h ON h.doc_id = bs.doc_id AND h.idx = bs.node GROUP BY label, node),
sc AS (SELECT doc_id, coalesce(product(p) FILTER (c = 1), 1) AS p1, coalesce(product(p) FILTER (c = 0), 1) AS p0 FROM hv JOIN cp ON node = idx GROUP BY doc_id),
pr AS (SELECT doc_id, label, CASE WHEN coalesce(p1, 1) > coalesce(p0, 1) * (1 + 1e-12) THEN 1 ELSE 0 END AS predicted FROM hd LEFT JOIN sc USING (doc_id))"""


_ACC = " SELECT round(avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM pr"
_PAIRS = k2_sql(SQL_LINEITEM, list(range(6)), 1)
_ORDER = [5, 3, 0, 4, 2, 1]
_TEXT_ORDER = list(reversed(range(TERMS)))
_LEARN = k2_sql(SQL_TEXT_MATRIX, list(range(TERMS)), 1)
_LEARNT = _k2nb_given(
    _LEARN[: _LEARN.index("\nSELECT")] + ",\nhv AS (SELECT doc_id, label, idx FROM ti JOIN vo USING (term))",
    "SELECT CAST(t0.child AS INTEGER) AS node, CAST(p1 AS INTEGER) AS p1, CAST(NULL AS INTEGER) AS p2 FROM t0 LEFT JOIN t1 ON t1.child = t0.child WHERE t0.child < (SELECT count(*) FROM vo)",
)

QUERIES = {
    "attr_domains": attr_domains,
    "alpha_counts": alpha_counts,
    "k2_score_pairs": k2_score_pairs,
    "k2_score_empty": _k2(lineitem_matrix, 6, u=0),
    "k2_sample": _k2(_sample, 3),
    "k2_greedy_u1": _k2(text_matrix, TERMS, u=1),
    "k2_greedy_u2": _k2(text_matrix, TERMS, u=2),
    "k2_multivalued": _k2(lineitem_matrix, 6, u=2),
    "k2_node_order": _k2(text_matrix, TERMS, order=_TEXT_ORDER, u=2),
    "head_per_class": head_query,
    "clean_text": clean_text,
    "term_incidence": term_incidence,
    "vocabulary_topk": vocabulary_topk,
    "term_matrix": term_matrix,
    "nb_predict": nb_predict,
    "nb_accuracy": nb_accuracy,
    "k2nb_1parent": _k2nb(1),
    "k2nb_2parents": _k2nb(2),
    "k2nb_accuracy": k2nb_accuracy,
    "k2nb_learnt": k2nb_learnt,
    "k2nb_learnt_accuracy": k2nb_learnt_accuracy,
    "parent_map_text": parent_map_text,
    "snake_schedule": snake_schedule,
    "matrix_synth": matrix_synth,
}

ORACLE_SQL = {
    "attr_domains": f"WITH {SQL_LINEITEM}, c AS (SELECT DISTINCT CAST(i AS INTEGER) AS pos, v[i + 1] AS x FROM m, range(6) t(i)) SELECT pos, CAST(count(*) AS INTEGER) AS r, string_agg(x, ',' ORDER BY x) AS vals FROM c GROUP BY pos",
    "alpha_counts": f"WITH {SQL_LINEITEM} SELECT CAST(i AS INTEGER) AS child, CAST(j AS INTEGER) AS cand, v[j + 1] AS c1, v[i + 1] AS x, count(*) AS a FROM m, range(6) t(i), range(6) s(j) WHERE j < i GROUP BY ALL",
    "k2_score_pairs": _PAIRS[: _PAIRS.index("\nSELECT")] + " SELECT child, cand, round(score, 4) AS score FROM s1",
    "k2_score_empty": k2_sql(SQL_LINEITEM, list(range(6)), 0),
    "k2_sample": k2_sql(SQL_SAMPLE, [0, 1, 2], 2),
    "k2_greedy_u1": k2_sql(SQL_TEXT_MATRIX, list(range(TERMS)), 1),
    "k2_greedy_u2": k2_sql(SQL_TEXT_MATRIX, list(range(TERMS)), 2),
    "k2_multivalued": k2_sql(SQL_LINEITEM, list(range(6)), 2),
    "k2_node_order": k2_sql(SQL_TEXT_MATRIX, _TEXT_ORDER, 2),
    "head_per_class": f"WITH {SQL_REVIEWS} {SQL_HEAD}",
    "clean_text": f"WITH {sql_terms(200)} SELECT doc_id, text FROM cl",
    "term_incidence": f"WITH {sql_terms(200)} SELECT doc_id, label, term FROM ti",
    "vocabulary_topk": f"WITH {sql_terms(200)} SELECT term, df, idx FROM vo",
    "term_matrix": f"WITH {SQL_TEXT_MATRIX} SELECT doc_id, array_to_string(v, '') AS v FROM m",
    "nb_predict": _NB + " SELECT doc_id, label, predicted FROM pr",
    "nb_accuracy": _NB + _ACC,
    "k2nb_1parent": _k2nb_sql(1) + " SELECT doc_id, label, predicted FROM pr",
    "k2nb_2parents": _k2nb_sql(2) + " SELECT doc_id, label, predicted FROM pr",
    "k2nb_accuracy": _k2nb_sql(1) + _ACC,
    "k2nb_learnt": _LEARNT + " SELECT doc_id, label, predicted FROM pr",
    "k2nb_learnt_accuracy": _LEARNT + _ACC,
    "parent_map_text": "SELECT * FROM (VALUES " + ", ".join(f"({j}, '{','.join(str(p) for p in ps if p is not None)}')" for j, *ps in _rule(2)) + ") t(node, parents)",
    "matrix_synth": f"""SELECT i AS rid, string_agg(CASE WHEN substr(md5(concat('10:', i, ':', j // 4)), j % 4 * 8 + 1, 8) < '{int(0.7 * 16**8):08x}' THEN '1' ELSE '0' END, '' ORDER BY j) AS v
      FROM range(1000) t(i), range(10) s(j) GROUP BY i""",
    "snake_schedule": "SELECT i AS job, CASE WHEN (i // 7) % 2 = 0 THEN i % 7 ELSE 6 - i % 7 END AS rank FROM range(100) t(i)",
}
