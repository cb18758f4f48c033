"""Sources and sinks: observation matrices (rid, v array<int>), reviews, parent maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The ten observations of three features whose network is known.
SAMPLE = [[1, 0, 0], [1, 1, 1], [0, 0, 1], [1, 1, 1], [0, 0, 0], [0, 1, 1], [1, 1, 1], [0, 0, 0], [1, 1, 1], [0, 0, 0]]


def sample_matrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SAMPLE)), "rid long, v array<int>")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Numbers parted by white space, one observation a line; blank lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias("rid"), F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double").cast("int")).alias("v"))


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Numbers parted by blanks, one observation a line, as read_matrix reads them."""
    matrix.select(F.array_join(F.col("v").cast("array<string>"), " ").alias("value")).write.text(path)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, stars) of a CSV file with a header that names at least text and stars; quoted fields
    may span lines. doc_id is the file's own, or else counts the rows in the order of the file."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = {"text", "stars"} - set(rows.columns)
    if missing:
        raise ValueError(f"the reviews lack {', '.join(sorted(missing))}")
    own = F.col("doc_id").cast("long") if "doc_id" in rows.columns else F.monotonically_increasing_id()
    return rows.select(own.alias("doc_id"), "text", F.col("stars").try_cast("int").alias("stars"))


def bernoulli_matrix(spark: SparkSession, m: int, n: int, p: float = 0.7, seed: int | None = None) -> DataFrame:
    """m observations of n independent features, each 1 with probability p. A cell is 1 where its eight
    digits of the MD5 of ``seed:row:block`` (four cells a block) are below p as a share of 16^8, so that a
    lost partition comes back as it was and any other engine can make the same rows. No seed is seed 0. ValueError where n is less than 1."""
    if n < 1:
        raise ValueError("a matrix has at least one feature")
    below = f"{min(int(p * 16**8), 16**8 - 1):08x}" if p < 1 else "g"
    digest = lambda block: F.md5(F.concat_ws(":", F.lit(seed or 0), "id", F.lit(block)).cast("binary"))
    rows = spark.range(m).withColumn("h", F.concat(*[digest(block) for block in range((n + 3) // 4)]))
    return rows.select(F.col("id").alias("rid"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (F.substring("h", j * 8 + 1, F.lit(8)) < below).cast("int")).alias("v"))


def parent_lines(parents: DataFrame) -> DataFrame:
    """(node, parents) as text lines: ``7 [3, 5]``."""
    return parents.select(F.concat(F.col("node").cast("string"), F.lit(" ["), F.array_join(F.col("parents").cast("array<string>"), ", "), F.lit("]")).alias("value"))


def parse_parent_lines(lines: DataFrame) -> DataFrame:
    """The inverse of parent_lines; lines without a number are left out."""
    found = lines.select(F.regexp_extract_all("value", F.lit("[0-9]+"), F.lit(0)).cast("array<int>").alias("x")).where(F.size("x") > 0)
    return found.select(F.col("x")[0].alias("node"), F.slice("x", 2, 1 << 20).alias("parents"))


def read_parent_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_parent_lines(spark.read.text(path))


def read_parent_list(spark: SparkSession, path: str) -> DataFrame:
    """(node, parents) of a stored list: the parents of nodes 0, 1, ... as ``[3, 5]``, a line each, in one
    file; lines without brackets are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.regexp_extract_all("value", F.lit(r"\[([0-9, ]*)\]"), F.lit(1))).alias("node", "of"))
    return lines.select("node", F.regexp_extract_all("of", F.lit("[0-9]+"), F.lit(0)).cast("array<int>").alias("parents"))


def write_parent_map(parents: DataFrame, path: str, kind: str = "text") -> None:
    """kind: text (as parent_lines), parquet or json."""
    (parent_lines(parents).write.text if kind == "text" else getattr(parents.write, kind))(path)
