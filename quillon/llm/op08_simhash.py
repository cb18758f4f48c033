"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints link at ``tau`` or fewer differing bits. Correlated bits are grouped into m partitions.
If thresholds t_1..t_m of a probing fingerprint sum to tau - m + 1 (-1: the partition is skipped),
every fingerprint within tau is within t_i on some partition i. Each probing fingerprint gets the
thresholds with the fewest estimated candidates, by dynamic programming over the partitions; it then
probes the index of partition values, and candidates are verified.

Where the best thresholds would still give more than ``most_candidates``, as inside a dense group of
near copies, the fingerprint takes the plan of m = 1, t_1 = tau, split between the two sides: one emits
all values within floor(tau / 2) bits, the other all within the rest of tau. Fingerprints that meet in a
value are within tau of each other, and conversely. A value has no more fingerprints around it than the
ball of the greater radius holds, so no bucket is hot, no pair is lost, and the cost of a fingerprint is
bounded however large its group is.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import map_texts
from quillon.llm.components import components
from quillon.plans.settle import settle

TAU = 2
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def simhash(data: bytes, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = data.lower().split()
    if not words:
        return 0
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if n > 1 else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, max(n, 1)).view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(h[:, j], minlength=256) @ BYTE_BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, *, keep: list | None = None, text_col: str = "text", name: str = "fp", shingle: int = 3) -> DataFrame:
    kept = keep or [c for c in docs.columns if c != name]
    return map_texts(docs, kept, f"{name} bigint", lambda: lambda texts: ((simhash(t, shingle),) for t in texts), text_col=text_col)


def _ones(batches):
    """A partition's counts of bit pairs: row i has how often bits i and j are both set."""
    total, rows = np.zeros((64, 64), np.int64), 0
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        total += (bits.T @ bits).astype(np.int64)
        rows += len(fp)
    yield pa.RecordBatch.from_arrays([pa.array(range(65), pa.int32()), pa.array([*total.tolist(), [rows] * 64], pa.list_(pa.int64()))], names=["i", "n"])


def group_bits(fps: DataFrame, m: int) -> list[list[int]]:
    """m groups of equal size; bits that are set together (or apart) more than by chance share a group.

    From 64 x 64 counts over all fingerprints, whatever their number.
    """
    counts = fps.mapInArrow(_ones, "i int, n array<long>").select("i", F.posexplode("n").alias("j", "n")).groupBy("i", "j").agg(F.sum("n").alias("n"))
    both = np.zeros((65, 64))
    for i, j, n in counts.toArrow().to_pandas().itertuples(index=False):
        both[i, j] = n
    rows, both = max(both[64, 0], 1), both[:64]
    p = np.diag(both) / rows
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    likeness = np.abs(np.divide(both / rows - np.outer(p, p), spread, out=np.zeros((64, 64)), where=spread > 0))
    left, groups = set(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        group = [max(sorted(left), key=lambda b: sum(likeness[b, c] for c in left) - likeness[b, b])]
        left -= set(group)
        while len(group) < size:
            group.append(max(sorted(left), key=lambda b: likeness[b, group].sum()))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def ball_size(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def ball(bits: list[int], radius: int) -> list[int]:
    """The masks of at most ``radius`` of the bits, those of fewer bits first."""
    return [signed(sum(1 << b for b in some)) for k in range(radius + 1) for some in combinations(bits, k)]


def allocate(counts: np.ndarray, widths: np.ndarray, mean: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of counts (fingerprints with its value, by partition): its thresholds and their cost.

    cost[i][t]: probes and estimated candidates of partition i at threshold t; values that differ are
    taken to have the mean number of fingerprints. best[s]: the least cost of the partitions so far with
    thresholds that sum to s.
    """
    rows, m = counts.shape
    around = [np.array([float(ball_size(int(w), t)) for w in widths]) for t in range(tau + 1)]
    cost = np.stack([np.zeros((rows, m))] + [around[t] + counts - 1 + (around[t] - 1) * mean for t in range(tau + 1)])
    low, high = -m, tau
    best = np.full((high - low + 1, rows), np.inf)
    best[-low] = 0
    chosen = []
    for i in range(m):
        options = np.stack([np.concatenate([best[1:], np.full((1, rows), np.inf)]) + cost[0, :, i]] + [np.concatenate([np.full((t, rows), np.inf), best[: len(best) - t]]) + cost[t + 1, :, i] for t in range(tau + 1)])
        chosen.append(options.argmin(axis=0))
        best = options.min(axis=0)
    at = np.full(rows, tau - m + 1 - low)
    out, least = np.empty((rows, m), np.int64), best[tau - m + 1 - low]
    for i in reversed(range(m)):
        out[:, i] = chosen[i][at, np.arange(rows)] - 1
        at = at - out[:, i]
    return out, least


def links(fps: DataFrame, *, tau: int = TAU, most_candidates: int | None = None) -> DataFrame:
    """(a, b), a < b: all pairs that a probe finds, and enough of the pairs inside dense groups to
    connect whatever is within tau there. fps: distinct, in a column fp. most_candidates: what the dense
    plan costs a fingerprint, 130 at tau = 2, unless given. tau: 0 to 4, as the balls of the dense plan
    have 65 values within one bit, 2,081 within two and 43,745 within three."""
    if not 0 <= tau <= 4:
        raise ValueError("tau is 0 to 4")
    inner, outer = ball(range(64), tau // 2), ball(range(64), tau - tau // 2)
    most_candidates = len(inner) + len(outer) if most_candidates is None else most_candidates
    n = fps.count()
    m = 3 if n < 1 << 24 else 2  # three exact parts of 21 bits, or one of 32 exact and one of 32 within a bit
    groups = group_bits(fps, m)
    masks = [signed(sum(1 << b for b in g)) for g in groups]
    index = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x)) for x in masks])).alias("part", "value"))
    counts = settle(index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")))
    widths = np.array([float(len(g)) for g in groups])
    mean = n / 2.0**widths
    index = settle(index.join(counts, ["part", "value"]))
    own = index.groupBy("fp").agg(*[F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"n{i}") for i in range(m)])

    flips = [[np.array(ball(g, t), np.int64) for t in range(tau + 1)] for g in groups]

    def probes(batches):
        """(fp, part, value): what each fingerprint looks up; part -1: its dense plan."""
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            t, cost = allocate(np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(m)], axis=1).astype(float), widths, mean, tau)
            dense = cost > most_candidates
            out = [(fp[dense], -1, np.zeros(1, np.int64))] + [(fp[~dense & (t[:, i] == e)], i, flips[i][e]) for i in range(m) for e in range(tau + 1)]
            for some, part, flip in out:
                step = max((1 << 20) // len(flip), 1)
                for at in range(0, len(some), step):
                    who = some[at : at + step]
                    values = (who & (masks[part] if part >= 0 else 0))[:, None] ^ flip[None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who, values.shape[1])), pa.array(np.full(values.size, part, np.int32)), pa.array(values.ravel())], names=["fp", "part", "value"])

    looked = settle(own.mapInArrow(probes, "fp long, part int, value long"))
    # the estimate was for the neighbouring values; what they really hold decides
    priced = looked.where("part >= 0").join(counts, ["part", "value"])
    over = priced.groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") > most_candidates + m).select("fp")
    dense = settle(looked.where("part = -1").select("fp").unionByName(over))
    sparse = priced.join(over, "fp", "left_anti").select("part", "value", F.col("fp").alias("a"))
    cool = index.where(F.col("n") <= most_candidates + m).select("part", "value", F.col("fp").alias("b"))  # no sparse probe looks up a fuller value
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = sparse.join(cool, ["part", "value"]).where((F.col("a") != F.col("b")) & (near <= tau)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    around = F.transform(F.array(*[F.lit(x).cast("long") for x in outer]), lambda x: F.col("fp").bitwiseXOR(x))
    meets = dense.select("fp", F.posexplode(around).alias("at", "z")).groupBy("z").agg(F.min(F.when(F.col("at") < len(inner), F.col("fp"))).alias("a"), F.collect_list("fp").alias("f"))
    stars = meets.where((F.size("f") > 1) & F.col("a").isNotNull()).select("a", F.explode("f").alias("b")).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.unionByName(stars).distinct()


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = TAU) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, fp (64 bits, signed), component_id.

    Words are what lies between blanks (U+0009-000D and space), A-Z lower-cased; a bit is 1 where it
    is set in over half the XXH64 (seed 42) of the shingles, repeats included. A text of fewer words
    is one shingle; one without words, and a null text, has fingerprint 0 and links like any other.
    component_id is the smallest id reachable over links; null ids are reached but never the smallest
    (null only where a whole component has null ids). An empty table gives no rows.
    """
    prints = settle(with_fingerprint(docs, keep=[F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash")], text_col=text_col, shingle=shingle))
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    joined = components(links(classes.select("fp"), tau=tau))
    roots = classes.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = settle(roots.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs whose id is their component's smallest: one document of each group stays.
    Rows that repeat both id and text are one document."""
    stay = near_dedup(docs, id_col=id_col, text_col=text_col, **how).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__x"))
    return docs.join(stay, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__x")), "left_semi")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
