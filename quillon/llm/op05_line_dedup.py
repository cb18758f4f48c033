"""Line dedup with levelled sorted runs of line hashes.

The index is a list of runs. A run is a table of line hashes with the document that keeps the line,
hash-bucketed and sorted by the hash, so that joins with it neither shuffle nor re-bucket it. Batches
come in descending order of document id. A batch is reduced to its distinct hashes, bucketed the same
way, and merge-anti-joined with the runs: what is left is new, belongs to the largest id that holds
it, and becomes a run of level 0. ``fanout`` runs of a level are merged into one of the next. Hashes
that the runs had already only add to the tally of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import routed
from quillon.plans.settle import discard, new_path, scratch, settle, writer

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
HEAVY = 4096


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, and nothing else; ``lower`` is much the faster and agrees on plain ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


class LineRuns:
    """Levelled runs (h1, h2, keep_id, n_docs); hashes are disjoint across runs."""

    def __init__(self, spark: SparkSession, *, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str, str]] = []  # level, table, path
        self.tallies: list[DataFrame] = []
        self.tables: list[tuple[str, str]] = []  # all that exist

    def _write(self, df: DataFrame) -> tuple[str, str]:
        name, path = f"run_{uuid.uuid4().hex}", new_path(self.spark)
        self.tables.append((name, path))
        writer(df).option("path", path).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name, path

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, path)
        self.tables.remove((name, path))

    def add(self, lines: DataFrame) -> None:
        """lines: (doc_id, h1, h2), each hash once per document, ids no larger than any added before."""
        own = lines.groupBy(*KEY).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_docs"))
        batch = self._write(own.repartition(self.buckets, *KEY))
        own = new = self.spark.table(batch[0])
        for _, run, _ in self.runs:
            new = new.join(self.spark.table(run).select(*KEY).hint("merge"), KEY, "left_anti")
        if self.runs:
            run = self._write(new)
            seen = own.join(self.spark.table(run[0]).select(*KEY).hint("merge"), KEY, "left_anti")
            self.tallies.append(settle(seen.select(*KEY, "n_docs")))
            self._drop(*batch)
        else:
            run = batch
        self.runs.append((0, *run))
        level = 0
        while len(full := [r for r in self.runs if r[0] == level]) >= self.fanout:
            merged = self._write(self._union([r[1] for r in full]).repartition(self.buckets, *KEY))
            self.runs = [r for r in self.runs if r[0] != level] + [(level := level + 1, *merged)]
            for _, name, path in full:
                self._drop(name, path)

    def _union(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    def at_least(self, n: int) -> DataFrame:
        """(h1, h2, keep_id, n) of the hashes that n or more documents hold."""
        all_runs = self._union([r[1] for r in self.runs])
        for t in self.tallies:
            all_runs = all_runs.unionByName(t, allowMissingColumns=True)
        total = all_runs.groupBy(*KEY).agg(F.max("keep_id").alias("keep_id"), F.sum("n_docs").alias("n"))
        return settle(total.where(F.col("n") >= n))

    def close(self) -> None:
        """Drops all runs."""
        for name, path in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, path)
        self.runs, self.tallies, self.tables = [], [], []


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """One row per row of docs: all its columns, and n_lines, n_dropped, kept_text.

    A line's key is the line without leading and trailing blanks (U+0009-000D and space), A-Z
    lower-cased. Keys of ``min_chars`` code points or more that ``min_docs`` or more documents hold
    lose all their lines but those of the largest id holding them; other lines stay, joined by
    newlines. A null or empty text is one empty line. Rows with a null id are no documents: they
    neither count nor lose lines. Every row counts as a document, also where
    ids repeat. An empty
    table gives no rows. Columns of docs that are named like the three new ones are replaced.

    Keys are compared by 128 bits of xxHash64 under two seeds. Only hashes, ids and line numbers are
    indexed; a text is shuffled once, to meet the numbers of the lines it loses, or not at all if it
    surely loses none.
    """
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / batches for i in range(1, batches)], 1000).alias("c")).head()["c"] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    batch = sum((F.when(F.col("doc_id") < c, 1).otherwise(0) for c in cuts), F.lit(0))

    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))
    keys = F.filter(F.transform(keys, lambda x, i: F.struct(x.alias("k"), i.alias("pos"))), lambda x: F.char_length(x["k"]) >= min_chars)
    low = F.transform(keys, lambda x: F.struct(ascii_lower(x["k"]).alias("k"), x["pos"].alias("pos")))
    hashed = F.sort_array(F.transform(low, lambda x: F.struct(F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit(1), x["k"]).alias("h2"), x["pos"].alias("pos"))))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row"), hashed.alias("l"))
    # sorted by hash: a line repeats within its row if the one before it has the same hash
    before = lambda i, h: F.get("l", i - 1)[h]
    marked = F.transform("l", lambda x, i: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), ((i == 0) | (before(i, "h1") != x["h1"]) | (before(i, "h2") != x["h2"])).alias("first")))
    rows = rows.select("doc_id", "row", batch.cast("int").alias("batch"), F.inline(marked))
    with scratch(spark):
        # one file a task, in which a batch's rows lie together, so that reading one batch skips the others' pages
        lines = settle(rows.sortWithinPartitions("batch"))

        runs = LineRuns(spark, fanout=fanout)
        try:
            for b in range(len(cuts) + 1):
                runs.add(lines.where((F.col("batch") == b) & F.col("first")).select("doc_id", *KEY))
            frequent = runs.at_least(min_docs)
        finally:
            runs.close()

        # keys that hold a 4096th of all lines of frequent keys, 4096 at most, are broadcast; the others are not hot
        total = frequent.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]
        heavy = F.broadcast(frequent.where(F.col("n") * HEAVY >= total).drop("n"))
        others = lines.join(heavy.select(*KEY), KEY, "left_anti").join(frequent.where(F.col("n") * HEAVY < total).drop("n"), KEY)
        lost = lines.join(heavy, KEY).unionByName(others).where(F.col("doc_id") != F.col("keep_id")).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("__lost"))
        lost = settle(lost.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "__lost"), outer=True)
    some, whole = routed(docs, [id_col, F.xxhash64(text)], lost.select("__id", "__row"))  # texts that lose nothing stay where they are
    some = some.join(lost, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text) == F.col("__row")), "left").drop("__id", "__row")
    out = some.unionByName(whole.withColumn("__lost", F.lit(None).cast("array<int>")))
    out = out.withColumn("__lines", F.split(text, "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")
    out = out.withColumns({
        "n_lines": F.size("__lines").cast("long"),
        "n_dropped": F.when(F.col("__lost").isNull(), 0).otherwise(F.size("__lost")).cast("long"),
        "kept_text": F.when(F.col("__lost").isNull(), text).otherwise(kept),
    })
    return out.drop("__lost", "__lines")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keys AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keep_id FROM keys WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, pos, line, f.k IS NOT NULL AND doc_id <> keep_id AS lost FROM keys LEFT JOIN frequent f USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
