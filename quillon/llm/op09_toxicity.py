"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import ASCII_WORDS, map_texts

BITS = 20
#: (distance between the two words, multiplier); distance 0 stands for the word alone.
GRAMS = ((0, 0x9E3779B97F4A7C15), (1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (3, 0x27D4EB2F165667C5))


class WordHashes(dict):
    """crc32 by word; forgets all when it has ``most`` of them, so its memory is bounded."""

    def __init__(self, most: int = 1 << 17):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = zlib.crc32(word)
        return h


def features(data: bytes, hashes: WordHashes) -> np.ndarray:
    """Indices of the words, bigrams, and skip-grams over one and two words; repeats included."""
    words = data.translate(ASCII_WORDS).split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    parts = []
    for gap, multiplier in GRAMS:
        if gap < len(h):
            x = (h if gap == 0 else (h[:-gap] << np.uint64(32)) + h[gap:] + np.uint64(gap)) * np.uint64(multiplier)
            x ^= x >> np.uint64(29)
            parts.append((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS))
    return np.concatenate(parts).astype(np.int64)


class Ftrl:
    """Follow the regularised leader, proximal form: a rate for each coordinate, L1 for sparsity."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last is the bias

    def weights(self, at) -> np.ndarray:
        z, l1 = self.z[at], np.where(np.asarray(at) == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 16384, epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the weights that are not 0, and the bias.

    ``fit_rows`` bounds the sample that is learnt from: the labelled ids with the smallest hashes, one
    row of each (of an id that repeats, the text with the smallest hash). Its texts go to one task, which sees them ``epochs`` times; only the weights come to the
    driver, 2**20 at most and far fewer under L1. A document with several labels counts as toxic if
    any says so; null labels and null ids don't count. Without labelled rows everything scores 0.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__y")).where(F.col("__id").isNotNull())
    n = known.count()
    if n > fit_rows:  # somewhat more than the sample, by hash, so that little is sorted to cut it
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * fit_rows / n + 200 / n)))
    known = known.orderBy(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)), "__id").limit(fit_rows)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.join(F.broadcast(known), F.col(id_col) == F.col("__id")).groupBy("__id").agg(F.min_by(text, F.xxhash64(text)).alias("b"), F.max("__y").cast("int").alias("y"))
    rows = rows.select("b", "y", F.xxhash64("__id").alias("o"))

    def train(batches):
        """The features of a batch's rows are held in one array, which goes back to the system as a whole."""
        model, hashes, held = Ftrl(alpha, beta, l1, l2), WordHashes(), []
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [np.append(np.unique(features(data.as_py(), hashes)), 1 << BITS).astype(np.int32) for data in part.column(0)]
                held.append((np.concatenate(found), np.cumsum([len(f) for f in found]), part.column(1).to_pylist()))
        for _ in range(epochs):
            for found, ends, labels in held:
                for a, b, y in zip([0, *ends[:-1].tolist()], ends.tolist(), labels, strict=True):
                    model.update(found[a:b], y)
        every = np.arange((1 << BITS) + 1)
        w = model.weights(every)
        at = every[w != 0] if held else every[:0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at], pa.float64())], names=["i", "w"])

    got = rows.repartition(1).sortWithinPartitions("o", "b").mapInArrow(train, "i int, w double").toArrow()
    at, w = got.column("i").to_numpy(), got.column("w").to_numpy()
    bias = w[at == 1 << BITS]
    return at[at < 1 << BITS], w[at < 1 << BITS], float(bias[0]) if len(bias) else -np.inf


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, keep: list, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of docs, and score (0 to 1). A null or empty text has the bias alone.
    Rows stay as they are, repeated ones too; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        at, w, bias = shared.value
        dense = np.zeros(1 << BITS, np.float64)
        dense[at] = w
        hashes = WordHashes()

        def run(texts):
            for data in texts:
                found = features(data, hashes)
                found = np.unique(found[dense[found] != 0])
                x = bias + dense[found].sum()
                yield (0.0 if x < -700 else float(1 / (1 + np.exp(-x))),)

        return run

    return map_texts(docs, keep, "score double", make, text_col=text_col)


def held_out(id_col: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list | None = None, folds: int = 5, fold: int = 0, **fitting) -> DataFrame:
    """Learns from labelled rows outside the fold and scores every row: the columns ``keep`` (default:
    all of docs), held_out, score, predicted (1 if score >= 0.5). Columns of docs so named are replaced.
    A null id is not held out. An empty table gives no rows."""
    model = fit(docs, labels.where(~held_out(id_col, folds, fold)), id_col=id_col, text_col=text_col, **fitting)
    kept = keep or [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    out = score(docs, model, keep=[*kept, held_out(id_col, folds, fold).alias("held_out")], text_col=text_col)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
