"""Reviews to term incidence; Naive Bayes, plain and with parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import STOP_WORDS, clean, tokens


def labelled(reviews: DataFrame, *, classes: tuple[tuple[int, int], ...] = ((5, 1), (1, 0))) -> DataFrame:
    """(doc_id, text, label): all reviews of each (stars, label)."""
    label = F.coalesce(*[F.when(F.col("stars") == stars, label) for stars, label in classes])
    return reviews.select("doc_id", "text", label.alias("label")).where("label is not null")


def head_per_class(reviews: DataFrame, *, num: int = 100, classes: tuple[tuple[int, int], ...] = ((5, 1), (1, 0))) -> DataFrame:
    """(doc_id, text, label): the first num reviews, by doc_id, of each (stars, label)."""
    rows = labelled(reviews, classes=classes)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("doc_id"))).where(F.col("n") <= num).drop("n")


def term_incidence(docs: DataFrame, *, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(doc_id, label, term), each term once a document."""
    return docs.select("doc_id", "label", F.explode(tokens(clean(F.col("text")), stop_words)).alias("term"))


def vocabulary(incidence: DataFrame, *, min_df: int = 10, most: int = 200) -> DataFrame:
    """(term, df, idx): the most frequent terms, ties to the alphabet; idx counts them alphabetically."""
    top = incidence.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df).orderBy(F.desc("df"), "term").limit(most)
    return top.withColumn("idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))  # at most ``most`` rows


def term_matrix(docs: DataFrame, incidence: DataFrame, vocab: DataFrame, n: int) -> DataFrame:
    """(doc_id, v): 0/1 by vocabulary index; documents without any of its terms have only zeros."""
    held = incidence.join(F.broadcast(vocab), "term").groupBy("doc_id").agg(F.collect_set("idx").alias("t"))
    v = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.array_contains("t", i), F.lit(False)).cast("int"))
    return docs.select("doc_id").join(held, "doc_id", "left").select("doc_id", v.alias("v"))


def _decided(docs: DataFrame, sums: DataFrame, wins) -> DataFrame:
    return docs.select("doc_id", "label").join(sums, "doc_id", "left").select("doc_id", "label", F.when(wins, 1).otherwise(0).alias("predicted"))


def naive_bayes(docs: DataFrame, held: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, label, predicted): multinomial, smoothed by one, uniform prior, ties to 0.

    held: (doc_id, label, idx). A document without any known term is tied."""
    by = held.groupBy("label", "idx").agg(F.count(F.lit(1)).alias("n"))
    totals = held.groupBy("label").agg(F.count(F.lit(1)).alias("t"))
    grid = F.broadcast(vocab.select("idx")).join(docs.select("label").distinct(), how="cross")  # vocabulary x classes
    size = vocab.agg(F.count(F.lit(1)).alias("size"))
    logs = grid.join(by, ["label", "idx"], "left").join(totals, "label", "left").crossJoin(F.broadcast(size))
    logs = logs.select(F.col("label").alias("c"), "idx", F.log((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("t", F.lit(0)) + F.col("size"))).alias("lp"))
    sums = held.select("doc_id", "idx").join(F.broadcast(logs), "idx").groupBy("doc_id").agg(F.sum(F.when(F.col("c") == 1, F.col("lp"))).alias("p1"), F.sum(F.when(F.col("c") == 0, F.col("lp"))).alias("p0"))
    return _decided(docs, sums, F.col("p1") > F.col("p0") + 1e-9)


def naive_bayes_k2(docs: DataFrame, held: DataFrame, parents: DataFrame) -> DataFrame:
    """(doc_id, label, predicted) with each word's probability given that its parents are present.

    parents: (node, p1, p2), null where there is none. P(word | class) is the share of the class's
    documents that hold the word, among those that hold all its parents; where none does, the word is
    skipped. No smoothing. Ties go to 0, as do products that are both 0."""
    base = docs.groupBy("label").agg(F.count(F.lit(1)).alias("n_all"))
    free = parents.where("p1 is null").select("node")
    plain = held.join(F.broadcast(free), F.col("idx") == F.col("node")).groupBy("label", "node").agg(F.count(F.lit(1)).alias("n"))
    plain = F.broadcast(free).join(base, how="cross").join(plain, ["label", "node"], "left").select(F.col("label").alias("c"), "node", (F.coalesce("n", F.lit(0)) / F.col("n_all")).alias("p"))
    one = held.select("doc_id", "label", "idx").join(F.broadcast(parents.where("p1 is not null")), F.col("idx") == F.col("p1")).drop("idx")
    other = held.select("doc_id", F.col("idx").alias("q"))
    both = one.where("p2 is null").unionByName(one.join(other, (one["doc_id"] == other["doc_id"]) & (F.col("p2") == F.col("q")), "left_semi"))
    word = held.select("doc_id", F.col("idx").alias("node"), F.lit(1).alias("has"))
    given = both.join(word, ["doc_id", "node"], "left").groupBy("label", "node").agg(F.avg(F.coalesce("has", F.lit(0))).alias("p"))
    cpt = plain.unionByName(given.select(F.col("label").alias("c"), "node", "p"))
    prods = held.select("doc_id", F.col("idx").alias("node")).join(F.broadcast(cpt), "node").groupBy("doc_id").agg(F.product(F.when(F.col("c") == 1, F.col("p"))).alias("p1"), F.product(F.when(F.col("c") == 0, F.col("p"))).alias("p0"))
    return _decided(docs, prods, F.coalesce("p1", F.lit(1.0)) > F.coalesce("p0", F.lit(1.0)) * (1 + 1e-12))


def accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.round(F.avg((F.col("predicted") == F.col("label")).cast("double")), 9).alias("accuracy"), F.count(F.lit(1)).alias("n"))
