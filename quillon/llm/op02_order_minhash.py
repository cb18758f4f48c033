"""Order MinHash fingerprints of whole texts, and of texts edited with their neighbour's.

The k-mers of a text, here of words, are numbered by occurrence, so that a repeat is an element of
its own. A hash deals the numbered k-mers into bins; of each bin the ``least`` minimal ones are
selected, put back into text order, and hashed as a tuple. A bin with fewer takes the next ones in the
order of hashes, that is from the bins after it, so that every tuple carries order, also in short texts.
A tuple survives an edit only where both the k-mers and their order do, so that likeness follows edit
distance and not just the set of k-mers.
Only SQL expressions over arrays are used. Arrays of longs that pack (hash, position) stand for
arrays of pairs: they sort without an interpreted comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.settle import settle

WORDS_IN_KMER, BINS, LEAST = 5, 32, 2
#: A packed element has 37 bits of hash, of which the first 5 are the bin, over 26 bits of position.
POS, TOP, BIN_AT = 26, (1 << 37) - 1, 58


def signature(df: DataFrame, text: Column, out: str, *, k: int = WORDS_IN_KMER, least: int = LEAST) -> DataFrame:
    """df and ``out``: an array of BINS 32-bit hashes. Fewer words than k make one k-mer; no words, or a
    null text, make an array of nulls."""
    at = lambda c, i: F.get(c, i)
    pos = lambda x: x.bitwiseAND(F.lit((1 << POS) - 1))
    bin_of = lambda x: F.shiftright(x, BIN_AT)
    pack = lambda h, p: F.shiftleft(h.bitwiseAND(F.lit(TOP)), POS).bitwiseOR(p)
    df = df.withColumn("__w", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+"), F.lit(0)))
    starts = F.sequence(F.lit(1), F.greatest(F.size("__w") - (k - 1), F.lit(1)))
    packed = F.transform(starts, lambda i: pack(F.xxhash64(F.slice("__w", i, k)), i.cast("long")))
    df = df.withColumn("__s", F.when(F.size("__w") == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(packed))).drop("__w")
    df = df.withColumn("__k", F.transform("__s", lambda x: F.shiftright(x, POS)))
    # occurrence numbers: sorted, equal k-mers stand together in text order; each run is 0, 1, 2, ...
    runs = F.regexp_extract_all(F.array_join(F.transform("__k", lambda x, i: F.when((i > 0) & (at("__k", i - 1) == x), "1").otherwise("0")), ""), F.lit("01*"), F.lit(0))
    number = F.flatten(F.transform(runs, lambda r: F.sequence(F.lit(0), F.length(r) - 1)))
    renamed = lambda x, o: pack(F.xxhash64(F.shiftright(x, POS), o), pos(x))
    numbered = F.when(F.size(F.array_distinct("__k")) == F.size("__k"), F.transform("__s", lambda x: renamed(x, F.lit(0)))).otherwise(F.zip_with("__s", number, renamed))
    df = df.withColumn("__e", F.sort_array(numbered)).drop("__s", "__k")
    first = F.filter("__e", lambda x, i: (i < least) | (bin_of(at("__e", i - least)) != bin_of(x)))
    df = df.withColumn("__f", first).drop("__e")

    def tuple_of(start: Column) -> Column:
        """The ``least`` elements from ``start`` on, cyclically, as (position, hash) in text order, hashed as one."""
        picked = F.array(*[F.get("__f", (start + j) % F.size("__f")) for j in range(least)])
        placed = F.sort_array(F.transform(picked, lambda x: F.shiftleft(pos(x), 37).bitwiseOR(F.shiftright(x, POS))))
        return F.element_at(F.transform(F.array(placed), lambda o: F.xxhash64(*[F.get(o, j).bitwiseAND(F.lit(TOP)) for j in range(least)]).bitwiseAND(F.lit(0xFFFFFFFF))), 1)

    # __f stands here more than once: named once, within a lambda, it would be made inline and anew for each bin
    starts = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.size(F.filter("__f", lambda x: bin_of(x) < b)))
    none = F.array_repeat(F.lit(None).cast("bigint"), BINS)
    return df.withColumn(out, F.when(F.size("__f") == 0, none).otherwise(F.transform(starts, tuple_of))).drop("__f")


def likeness(a: str, b: str) -> Column:
    """The share of bins with equal tuples, of the bins that either has; 1 if neither has any."""
    both = lambda test: F.size(F.filter(F.zip_with(a, b, test), lambda x: x))
    any_of = both(lambda x, y: x.isNotNull() | y.isNotNull())
    return F.when(any_of == 0, 1.0).otherwise(both(lambda x, y: F.coalesce(x == y, F.lit(False))) / F.greatest(any_of, F.lit(1)))


def as_text(sig: str) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x), 8, "0")), F.lit("........"))), "")


def following(rows: DataFrame) -> DataFrame:
    """rows: distinct (doc_id, x, ...). Adds next_id, next_x, prev_id, prev_x and prev_chars, cyclically in ascending order.

    Ranges of ids are ordered each on its own; the first and last row of each range, as many as there
    are partitions, connect them.
    """
    spark = rows.sparkSession
    ranges = settle(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "x").withColumn("p", F.spark_partition_id()))
    edges = ranges.groupBy("p").agg(F.min(F.struct("doc_id", "x")).alias("first"), F.max(F.struct("doc_id", "x", "n_chars")).alias("last"))
    ring = Window.partitionBy(F.lit(0)).orderBy("p")  # one row a partition
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("p", F.coalesce(F.lead("first").over(ring), F.first("first").over(whole)).alias("after"), F.coalesce(F.lag("last").over(ring), F.last("last").over(whole)).alias("before"))
    inside = Window.partitionBy("p").orderBy("doc_id", "x")
    out = ranges.withColumns({"n": F.lead(F.struct("doc_id", "x")).over(inside), "c": F.lag(F.struct("doc_id", "x", "n_chars")).over(inside)}).join(F.broadcast(edges), "p")
    out = out.withColumn("n", F.coalesce("n", "after")).withColumn("c", F.coalesce("c", "before"))
    return settle(out.select("doc_id", "x", "n_chars", "copies", F.col("n.doc_id").alias("next_id"), F.col("n.x").alias("next_x"), F.col("c.doc_id").alias("prev_id"), F.col("c.x").alias("prev_x"), F.col("c.n_chars").alias("prev_chars")))


def order_minhash(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_text's sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    A null text counts as empty. The edited text has its last floor(n_chars / 2) code points replaced by
    the first as many (or all) of the next document, in ascending order of id, then of a hash of the
    text; after the last comes the first. Null ids come first. Rows that repeat both id and text are
    one document in that order and have equal results. A single document is its own next one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("x"), text.alias("text"))
    rows = base.select("doc_id", "x", F.char_length("text").cast("long").alias("n_chars")).groupBy("doc_id", "x").agg(F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    after = following(rows)

    own = base.join(after.select(F.col("doc_id").alias("i"), F.col("x").alias("y"), "n_chars", "copies", "next_id", "next_x", "prev_id", "prev_x", "prev_chars"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("x") == F.col("y"))).drop("i", "y")
    # the start of a text goes to the document before it, whose own text stays where it is
    start = own.select(F.col("prev_id").alias("of_id"), F.col("prev_x").alias("of_x"), F.expr("left(text, int(prev_chars div 2))").alias("start"), "copies")
    start = start.where("copies = 1").unionByName(start.where("copies > 1").dropDuplicates(["of_id", "of_x"])).drop("copies")
    paired = own.join(start, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("x") == F.col("of_x"))).drop("of_id", "of_x")
    half = F.expr("int(n_chars div 2)")
    edited = F.concat(F.expr("left(text, int(n_chars - n_chars div 2))"), F.substring("start", F.lit(1), half))
    paired = paired.select("doc_id", "x", "n_chars", "next_id", "next_x", "text", edited.alias("edited"))
    made = signature(signature(paired, F.col("text"), "sig"), F.col("edited"), "edited_sig")
    made = settle(made.select("doc_id", "x", "n_chars", "next_id", "next_x", F.sha2("edited", 256).alias("edited_sha256"), "sig", "edited_sig"))
    other = made.select(F.col("doc_id").alias("of_id"), F.col("x").alias("of_x"), F.col("sig").alias("next_sig"))
    other = other.join(after.where("copies > 1").select("doc_id", "x"), other["of_id"].eqNullSafe(F.col("doc_id")) & (F.col("of_x") == F.col("x")), "left_anti").unionByName(
        other.join(after.where("copies > 1").select("doc_id", "x"), other["of_id"].eqNullSafe(F.col("doc_id")) & (F.col("of_x") == F.col("x")), "left_semi").dropDuplicates(["of_id", "of_x"])
    )
    out = made.join(other, F.col("next_id").eqNullSafe(F.col("of_id")) & (F.col("next_x") == F.col("of_x")))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text("sig").alias("fingerprint"), as_text("edited_sig").alias("edited_fingerprint"), likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash(spark.read.parquet(f"{sf_dir}/documents.parquet"))
