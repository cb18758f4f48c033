"""LM scoring: a gated recurrent model, trained here, gives each whole document's log-likelihood.

Counts: words are known by a 64-bit hash of their lower-cased bytes and counted over all training
documents. The most frequent, at most HEAD, are broadcast, so that only the rest, of which each is rare,
is shuffled to meet its counts.
Model: the most frequent words have ids of their own; any other word is UNKNOWN, times the word's
share of the unknown words' smoothed counts, so that the probabilities of all words add up.
Training goes once over all training documents, in rounds: in each round a fixed number of copies of
the model each train on their documents of that round, and the copies' mean, weighted by tokens,
starts the next.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.llm import gru
from quillon.llm.common import Words, bytes_of, most_frequent, pieces
from quillon.plans.settle import settle

HEAD = 1 << 17  # words that are broadcast, at most: 2 MB
OWN = gru.VOCABULARY - 2  # words with an id of their own
LN10 = float(np.log(10))

class Index:
    """Where a hash stands in ``keys``, by a few tables that the hash addresses directly."""

    def __init__(self, keys: np.ndarray, bits: int = 19):
        self.keys, self.bits, self.tables = keys, bits, []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            table = np.full(1 << bits, -1, np.int32)
            at = self.slot(keys[left], len(self.tables))
            table[at] = left
            self.tables.append(table)
            left = left[table[at] != left]

    def slot(self, h: np.ndarray, level: int) -> np.ndarray:
        return (h * np.uint64(2 * level + 1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Places in keys, -1 for what is not there."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, table in enumerate(self.tables):
            found = table[self.slot(h[left], level)]
            hit = (found >= 0) & (self.keys[found] == h[left])
            out[left[hit]] = found[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


def count_words(docs: DataFrame, text_col: str = "text", most: int = 1 << 21) -> DataFrame:
    """(h, c) over all rows, h null for the end; each task adds up ``most`` words at a time."""

    def run(batches):
        words = Words()
        held, n, ends = [], 0, 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            keys = pa.concat_arrays([pa.array(h.view(np.int64)), pa.nulls(1, pa.int64())])
            return pa.RecordBatch.from_arrays([keys, pa.array(np.append(c, ends).astype(np.int64))], names=["h", "c"])

        for batch in batches:
            for _, _, texts in pieces(batch):
                h, _ = words(texts)
                held.append(h)
                n, ends = n + len(h), ends + len(texts)
                if n >= most:
                    yield flush()
                    held, n, ends = [], 0, 0
        if ends:
            yield flush()

    return docs.select(bytes_of(text_col)).mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def encode(docs: DataFrame, head: np.ndarray, counts: np.ndarray, c_end: int, keep: list, text_col: str) -> DataFrame:
    """keep, and: ids (uint16, in bytes), n_tokens, n_known, base_sum and unknown_sum (of log10(c + 1)
    over the tokens in the head, and over those of them that are UNKNOWN), n_unknown, rare (the hashes
    of the words that are not in the head)."""
    shared = docs.sparkSession.sparkContext.broadcast((head, np.log10(counts + 1.0)))
    log_end, known_end = float(np.log10(c_end + 1.0)), int(c_end > 0)
    given = docs.select(*keep, bytes_of(text_col).alias("__bytes"))
    kept = given.drop("__bytes").schema
    added = StructType.fromDDL("ids binary, n_tokens bigint, n_known bigint, base_sum double, unknown_sum double, n_unknown bigint, rare array<bigint>")
    schema = StructType([*kept.fields, *added.fields])

    def run(batches):
        words, find, logs = Words(), Index(shared.value[0]), np.append(shared.value[1], 0.0)
        for batch in batches:
            for a, b, texts in pieces(batch):
                h, n = words(texts)
                at, of = find(h), np.repeat(np.arange(b - a), n)
                missing, unknown = at < 0, (at < 0) | (at >= OWN)
                to = np.cumsum(n)
                ids = np.insert(np.where(unknown, gru.UNKNOWN, at + 2), to, gru.END).astype("<u2")
                sums = lambda w, of=of, size=b - a: np.bincount(of, weights=w, minlength=size)
                log = logs[at]  # -1 is the last, 0
                made = [
                    pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.concatenate([[0], 2 * (to + np.arange(1, b - a + 1))]).astype(np.int32)), pa.py_buffer(ids)]),
                    pa.array(n + 1), pa.array((n - sums(missing) + known_end).astype(np.int64)), pa.array(sums(log) + log_end), pa.array(sums(np.where(unknown, log, 0.0))), pa.array(sums(unknown).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sums(missing))]).astype(np.int32)), pa.array(h[missing].view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[:-1]] + made, names=schema.names)

    return given.mapInArrow(run, schema)


def _pools(batches, column: int, most_tokens: int):
    """(batches, documents) with about so many tokens at a time."""
    held, docs, n = [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            held.append(part)
            docs += [np.frombuffer(x.as_py(), "<u2") for x in part.column(column)]
            n += sum(len(d) for d in docs[-part.num_rows :])
            if n >= most_tokens:
                yield held, docs
                held, docs, n = [], [], 0
    if docs:
        yield held, docs


def fit(encoded: DataFrame, start: np.ndarray, bounds: np.ndarray, *, rounds: int = 4, slots: int = 256, length: int = 24, rate: float = 0.2, pool_tokens: int = 1 << 20, parts: int = 32, copies: int | None = None) -> np.ndarray:
    """Trained parameters. encoded: (rid, ids) of all training documents. ``copies`` of the model train
    side by side (two for each core that the cluster has, unless given), however many partitions there are."""
    spark = encoded.sparkSession
    copies = copies or 2 * spark.sparkContext.defaultParallelism
    flat, squares = start, np.full(gru.SIZE, 1e-3, np.float32)
    cuts = np.linspace(0, 2 * gru.SIZE, parts + 1).astype(int)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((flat, squares))

        def run(batches, shared=shared, k=k):
            f, q, n = shared.value[0].copy(), shared.value[1].copy(), 0
            for _, docs in _pools(batches, 0, pool_tokens):
                gru.train(f, q, bounds, docs, slots=slots, length=length, rate=rate, seed=k)
                n += sum(map(len, docs))
            if n:
                both = np.concatenate([f, q])
                yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([float(n)] * parts), pa.array([both[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.list_(pa.float32()))], names=["part", "n", "v"])

        def mean(batches):
            """Of each part, one at a time; a task holds no more than its parts' sums."""
            sums: dict[int, np.ndarray] = {}
            weights: Counter = Counter()
            for batch in batches:
                for part, n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) * n
                    sums[part] = sums[part] + x if part in sums else x
                    weights[part] += n
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(sums[i] / weights[i]).astype(np.float32) for i in sums], pa.list_(pa.float32()))], names=["part", "v"])

        share = encoded.where(F.pmod(F.xxhash64("rid"), F.lit(rounds)) == k).select("ids").coalesce(copies)
        got = share.mapInArrow(run, "part int, n double, v array<float>").repartition(parts, "part").mapInArrow(mean, "part int, v array<float>").toArrow()
        shared.unpersist()
        if got.num_rows:
            by = dict(zip(got.column("part").to_pylist(), got.column("v"), strict=True))
            both = np.concatenate([by[i].values.to_numpy(zero_copy_only=False) for i in range(parts)]).astype(np.float32)
            flat, squares = both[: gru.SIZE].copy(), both[gru.SIZE :].copy()
    return flat


def lm_score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, pool_tokens: int = 6 << 20, **fitting) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Held out are the rows with crc32(id as text) mod folds = fold; the others are learnt from. A null
    id is not held out. A null or empty text is the end token alone. Without training documents no token
    is known. Rows that repeat are scored and counted as often. An empty table gives no rows. Words
    whose 64-bit hashes are equal count as one. Other columns are ignored, whatever their names.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
    counts = settle(count_words(docs.where(~held), text_col))
    head, c, cut, n_words, distinct = most_frequent(counts, HEAD)
    c_end = (counts.where("h is null").head() or {"c": 0})["c"]
    all_n = n_words + c_end

    own = c[:OWN]
    unknown = n_words - int(own.sum())
    by_id = np.zeros(gru.VOCABULARY)
    by_id[gru.UNKNOWN], by_id[gru.END], by_id[2 : 2 + len(own)] = unknown + 1, c_end + 1, own
    log_unknown = float(np.log10(unknown + (distinct - len(own)) + 1))
    log_all = float(np.log10(all_n + distinct + (c_end > 0) + 1))

    encoded = encode(docs, head, c, c_end, [F.col(id_col).alias("doc_id"), held.alias("held_out")], text_col)
    encoded = settle(encoded.withColumn("rid", F.monotonically_increasing_id()))  # written once, so that it stays
    bounds = gru.classes(by_id)
    flat = fit(encoded.where(~F.col("held_out")).select("rid", "ids"), gru.start(by_id), bounds, **fitting)
    shared = docs.sparkSession.sparkContext.broadcast(flat)

    kept = encoded.drop("rare", "ids")
    names = [*kept.columns, "ln"]

    def run(batches):
        for held_batches, texts in _pools(batches, len(names) - 1, pool_tokens):
            ln, at = gru.score(shared.value, bounds, texts, slots=384, length=32), 0
            for b in held_batches:
                yield pa.RecordBatch.from_arrays(b.columns[:-1] + [pa.array(ln[at : at + b.num_rows])], names=names)
                at += b.num_rows

    scored = settle(encoded.select(*kept.columns, "ids").mapInArrow(run, kept.schema.add("ln", "double")))
    seldom = counts.where(f"h is not null and c <= {cut}")
    rare = encoded.select("rid", F.explode("rare").alias("h")).join(seldom, "h").groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1)).alias("rare_sum"), F.count(F.lit(1)).alias("n_rare"))
    out = scored.join(rare, "rid", "left").na.fill(0, ["rare_sum", "n_rare"])
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("n_rare")).alias("n_known"), F.lit(int(all_n)).cast("long").alias("train_tokens"),
        (F.col("base_sum") + F.col("rare_sum") - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("ln") / LN10 + F.col("unknown_sum") + F.col("rare_sum") - F.col("n_unknown") * log_unknown).alias("score"),
    )


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
