"""Near copies by SimHash: texts whose sets of word shingles have a Jaccard similarity of at least ``num / den``.

Fingerprints of the same shingles are linked by the generalised pigeonhole principle, as in op08_simhash, and
each link is verified on the sets. Copies and the nearer near copies are joined to components in this way.

What fingerprints keep apart is made whole by an exact join (but for collisions of 64-bit hashes), which only
looks at pairs of sets from different components: a similarity of 0.8 leaves some ten of 64 bits different,
too many to look up. If the shingles of all sets stand in one order, two near sets share a shingle among the
first n - ceil(n num / den) + 1 of the larger and the first n - ceil(2 n num / (num + den)) + 1 of the smaller
one (prefix filter). Any order is right; here shingles that many documents of a sample hold come last, so that
what is common is seldom looked up.

Sets that share such a shingle are candidates. Each set has a bitmap, of two to four bits a shingle, of the
parities of its shingles by hash; two bitmaps differ in no more bits than the sets differ in shingles, so that
a few bytes rule most candidates out. What is left is verified on the whole sets, and only those documents are
read again.

Shingles with more than ``most`` sets, as inside a dense group, are not paired off: their sets first meet a
few hubs each, which joins a group of near copies to one component. Only where sets of different components
are left under a shingle do their bitmaps meet, in pairs of chunks. Shingles that the sample has found to be
hot go this way at once, and are never brought together in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.llm.common import Words, bytes_of, most_frequent, pieces, routed
from quillon.llm.components import components
from quillon.llm.op08_simhash import links as fingerprint_links
from quillon.llm.op08_simhash import simhash
from quillon.plans.settle import scratch, settle

WORDS, NUM, DEN = 5, 4, 5
TAU = 4  # bits: the most that op08's links take
SAMPLE, COMMON = 16, 1 << 17  # one document in so many is sampled for common shingles; at most so many are broadcast
HOT = 64  # documents of the sample that hold a hot shingle
HUBS, SALTS = 4, 32
_MULTIPLIERS = np.random.default_rng(8).integers(1 << 62, 1 << 64, 64, np.uint64) | np.uint64(1)


class Shingles:
    """The distinct shingles' hashes of each text, ascending. Fewer words than k, or none, are one shingle."""

    def __init__(self, k: int = WORDS):
        self.k, self.words = k, Words()

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        h, n = self.words(texts)
        k, ends = self.k, np.cumsum(n)
        grams = np.zeros(max(len(h) - k + 1, 0), np.uint64)
        for j in range(k):
            grams += h[j : j + len(grams)] * _MULTIPLIERS[j]
        grams ^= grams >> np.uint64(32)
        out = []
        for end, size in zip(ends.tolist(), n.tolist(), strict=True):
            if size >= k:
                out.append(np.unique(grams[end - size : end - k + 1].view(np.int64)))
            else:
                few = (h[end - size : end] * _MULTIPLIERS[:size]).sum(dtype=np.uint64) ^ _MULTIPLIERS[size + 1]
                out.append(np.array([few], np.uint64).view(np.int64))
        return out


def prefix(h: np.ndarray, common: np.ndarray, counts: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, int]:
    """The first shingles of h, in order, and how many of them are not hot: those come before the others.
    common: ascending; counts: how common each of them is."""
    most = len(h) + (-len(h) * num) // den + 1
    if not len(common):
        return h[:most], most
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    rank = np.where(common[at] == h, counts[at], 0)
    order = np.argsort(rank, kind="stable")[:most]
    return h[order], int(np.searchsorted(rank[order], HOT))


def bitmap(h: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each bit; 128 bits at least, and a power of 2. A map of
    half the size is the exclusive or of the halves."""
    bits = max(128, 1 << (2 * len(h) - 1).bit_length())
    at = ((h.view(np.uint64) * _MULTIPLIERS[-1]) >> np.uint64(24)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def fold(bits: Column, size: Column) -> Column:
    """A bitmap in ``size`` words, if it has twice as many."""
    halved = F.zip_with(F.slice(bits, 1, size), F.slice(bits, size + 1, size), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > size, halved).otherwise(bits)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)), pa.array(np.concatenate(parts)))


def _with_sets(docs: DataFrame, keep: list, text_col: str, schema: str, make) -> DataFrame:
    """keep, and the columns of schema that ``make()`` gives for the sets of shingles of some texts."""
    given = docs.select(*keep, bytes_of(text_col).alias("__bytes"))
    kept = given.drop("__bytes").schema
    out = StructType([*kept.fields, *StructType.fromDDL(schema).fields])

    def run(batches):
        f = make()
        for batch in batches:
            for a, b, texts in pieces(batch):
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[:-1]] + f(texts), names=out.names)

    return given.mapInArrow(run, out)


def _whole(docs: DataFrame, keep: list, text_col: str, words: int) -> DataFrame:
    def make():
        shingles = Shingles(words)
        return lambda texts: [_lists(shingles(texts))]

    return _with_sets(docs, keep, text_col, "h array<bigint>", make)


def _common(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than one document of the sample holds, ascending, and their counts."""
    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE)) == 0)
    counts = settle(_whole(some, [], text_col, words).select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    h, c = most_frequent(counts, COMMON)[:2]
    by = np.argsort(h.view(np.int64))
    return h.view(np.int64)[by], c[by]


def _prints(docs: DataFrame, keep: list, text_col: str, words: int, num: int, den: int, most_seen: int = 1 << 18) -> DataFrame:
    """keep, key (of the set), n, fp (of the text), bits, first, cool (how many of first are not hot). A set that
    a task has met already comes without fp, bits and first."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, text_col, words))

    def make():
        shingles, seen = Shingles(words), set()

        def run(texts):
            keys, sizes, fps, bits, first, cool = [], [], [], [], [], []
            for text, h in zip(texts, shingles(texts), strict=True):
                key = xxhash.xxh64_intdigest(h.tobytes(), 7) - (1 << 63)
                new = key not in seen
                keys.append(key)
                sizes.append(len(h))
                fps.append(simhash(text, words) if new else None)
                bits.append(bitmap(h) if new else h[:0])
                of, n_cool = prefix(h, *common.value, num, den) if new else (h[:0], 0)
                first.append(of)
                cool.append(n_cool)
                if len(seen) >= most_seen:
                    seen.clear()
                seen.add(key)
            return [pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), _lists(bits), _lists(first), pa.array(cool, pa.int32())]

        return run

    return _with_sets(docs, keep, text_col, "key bigint, n int, fp bigint, bits array<bigint>, first array<bigint>, cool int", make)


def _may_be_near(num: int, den: int) -> Column:
    """Of columns n_a, n_b, bits_a, bits_b: false only where the sets can't be near. Sets that may be near
    have bitmaps of equal sizes, or one has twice the other's."""
    size = F.least(F.size("bits_a"), F.size("bits_b"))
    differ = F.aggregate(F.zip_with(fold(F.col("bits_a"), size), fold(F.col("bits_b"), size), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num) & (differ * (num + den) <= (F.col("n_a") + F.col("n_b")) * (den - num))


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(side if c == "key" else f"{c}_{side}") for c in df.columns])


def _across(num: int, den: int):
    """Of one pair of chunks: the pairs across it that may be near, and whose components differ."""

    def run(table: pa.Table) -> pa.Table:
        key, at = np.unique(table.column("key").to_numpy(), return_index=True)
        n, root, i = (table.column(c).to_numpy()[at].astype(np.int64) for c in ("n", "root", "i"))
        maps = [table.column("bits")[int(x)].values.to_numpy(zero_copy_only=False) for x in at]
        words = np.array([len(m) for m in maps])
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        one = i.min() == i.max()  # a chunk with itself; else only what is across
        # by size of the smaller bitmap: those of that size, and those of twice the size, folded
        for size in np.unique(words):
            here = np.flatnonzero((words == size) | (words == 2 * size))
            bits = np.stack([maps[x] if words[x] == size else maps[x][:size] ^ maps[x][size:] for x in here])
            for x, k in enumerate(here):
                y = here[x + 1 :]
                fits = (np.minimum(n[y], n[k]) * den >= np.maximum(n[y], n[k]) * num) & (root[y] != root[k]) & ((i[y] != i[k]) | one) & (np.minimum(words[y], words[k]) == size)
                at = np.flatnonzero(fits)
                if len(at):
                    differ = np.bitwise_count((bits[x + 1 :][at] ^ bits[x]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                    y = y[at[differ * (num + den) <= (n[y[at]] + n[k]) * (den - num)]]
                    out_a.append(np.full(len(y), key[k]))
                    out_b.append(key[y])
        return pa.table({"a": pa.array(np.concatenate(out_a)), "b": pa.array(np.concatenate(out_b))})

    return run


def _by_shingle(rows: DataFrame, of_h: DataFrame) -> DataFrame:
    """rows (h, key, ...) with the columns that of_h has for their h; a hot shingle's rows go to many tasks."""
    salted = of_h.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"]).drop("salt")


def _hubs() -> Column:
    """A few of a group's keys, chosen by hash."""
    return F.array_distinct(F.array(*[F.min_by("key", F.xxhash64("key", F.lit(t))) for t in range(HUBS)])).alias("hubs")


def _by_fingerprint(prints: DataFrame, tau: int, most: int) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints differ in tau bits or fewer. Of equal fingerprints, each set meets
    the one of the least key, which also stands for them all in links to other fingerprints; a fingerprint with
    more than ``most`` links meets a few of them."""
    of = prints.where("fp is not null").select(F.col("fp").alias("h"), "key").distinct()
    classes = settle(of.groupBy("h").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("c")))
    equal = _by_shingle(of, classes.where("c > 1").select("h", "first")).select(F.col("key").alias("a"), F.col("first").alias("b"))
    near = settle(fingerprint_links(classes.select(F.col("h").alias("fp")), tau=tau))
    both = near.select(F.col("a").alias("h"), F.col("b").alias("key")).unionByName(near.select(F.col("b").alias("h"), F.col("a").alias("key")))
    of_h = settle(both.groupBy("h").agg(F.count(F.lit(1)).alias("c"), _hubs()))
    linked = _by_shingle(both, of_h.where(F.col("c") <= most).select("h")).select("h", "key")
    linked = linked.unionByName(of_h.where(F.col("c") > most).select("h", F.explode("hubs").alias("key")))
    for end, to in (("h", "a"), ("key", "b")):
        linked = linked.join(classes.select(F.col("h").alias(end), F.col("first").alias(to)), end)
    pairs = linked.select("a", "b").unionByName(equal).where("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one component of joined (node, root)."""
    for end in "ab":
        pairs = pairs.join(joined.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN, tau: int = TAU, most: int = 32, chunk: int = 384) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, component_id: the smallest id reachable over pairs at num / den
    or more, whatever the bits of their fingerprints; tau says which of them SimHash links. Words are what lies
    between ASCII blanks, A-Z lower-cased. Texts without words, and null texts, are equal. Null ids are reached but
    never the smallest, unless a whole component has null ids. An empty table gives no rows. Other columns are
    ignored, whatever their names."""
    x = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keep = [F.col(id_col).alias("doc_id"), x.alias("text_hash")]
    prints = settle(_prints(docs, keep, text_col, words, num, den))
    sets = prints.where(F.size("bits") > 0).select("key", "n", "bits")
    # a row a set, so that no set of many copies is met as a hot key further on
    firsts = prints.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("of"), F.min("doc_id").alias("first_id"))

    with scratch(docs.sparkSession):
        near = _verified(docs, firsts, sets, _by_fingerprint(prints, tau, most), x, id_col, text_col, words, num, den)
        near = settle(near, outer=True)
        by_simhash = settle(components(near), outer=True)

    rows = prints.select("key", "n", "cool", F.posexplode("first").alias("pos", "h"))
    # one shuffle serves to drop what several tasks have given, and to count
    index = rows.where("pos < cool").drop("cool").repartition("h").dropDuplicates(["h", "key"])
    index = settle(index.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("c > 1"))
    in_small = F.col("pos_b") < F.col("n_b") - F.ceil(F.col("n_b") * (2 * num) / (num + den)) + 1
    larger = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") > F.col("b")))
    left = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))  # all they can share, if this is the first they do
    fits = (F.col("n_b") * den >= F.col("n_a") * num) & (left * (num + den) >= (F.col("n_a") + F.col("n_b")) * num)
    few = index.where(F.col("c") <= most).drop("c")
    pairs = _side(few.withColumnRenamed("h", "of"), "a").withColumnRenamed("of_a", "h").join(_side(few.withColumnRenamed("h", "of"), "b").withColumnRenamed("of_b", "h"), "h").where(in_small & larger & fits).select("a", "b")
    dense = index.where(F.col("c") > most).select("h", "key").unionByName(rows.where("pos >= cool").select("h", "key").distinct())
    hubs = dense.groupBy("h").agg(_hubs())
    to_hub = _by_shingle(dense, hubs).select(F.col("key").alias("a"), F.explode("hubs").alias("b")).where("a != b")
    links = near.unionByName(_verified(docs, firsts, sets, _apart(pairs.unionByName(to_hub).distinct(), by_simhash), x, id_col, text_col, words, num, den))
    joined = components(links)

    # shingles whose sets are still in different components
    root = joined.select(F.col("node").alias("key"), "root")
    open_ = dense.join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
    left_over = open_.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("c")).where("least != most").select("h", "c")
    open_ = settle(_by_shingle(open_, left_over).select("h", "key", "root", "c"))
    if not open_.isEmpty():
        # chunk i of a shingle meets every chunk j: as (lesser, greater)
        chunks = F.ceil(F.col("c") / chunk).cast("int")
        mine = F.pmod(F.xxhash64("key"), chunks).cast("int")
        own = sets.join(open_.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
        dealt = open_.withColumns({"i": mine, "j": F.explode(F.sequence(F.lit(0), chunks - 1))}).join(own, "key")
        dealt = dealt.select(F.col("h").alias("of"), F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "key", "root", "n", "bits")
        more = dealt.groupBy("of", "lo", "hi").applyInArrow(_across(num, den), "a long, b long").distinct()
        links = links.unionByName(_verified(docs, firsts, sets, more, x, id_col, text_col, words, num, den))
        joined = components(links)

    roots = firsts.drop("of").join(joined.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = roots.join(roots.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("key", "component_id")
    return prints.select("doc_id", "text_hash", "key").join(named, "key").select("doc_id", "text_hash", "component_id")


def _verified(docs: DataFrame, firsts: DataFrame, sets: DataFrame, pairs: DataFrame, x: Column, id_col: str, text_col: str, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are near: by their bitmaps first, then by the whole sets."""
    pairs = settle(pairs)
    met = sets.join(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key", "left_semi").dropDuplicates(["key"])
    close = settle(pairs.join(_side(met, "a"), "a").join(_side(met, "b"), "b").where(_may_be_near(num, den)).select("a", "b", "n_a", "n_b"))
    keys = close.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = firsts.join(keys, "key").select("key", F.col("of.doc_id").alias("__id"), F.col("of.text_hash").alias("__x"))
    texts, _ = routed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), x.alias("x")), ["doc_id", "x"], wanted.select("__id", "__x"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("x") == F.col("__x"))).dropDuplicates(["key"])
    whole = settle(_whole(texts, ["key"], "text", words))
    both = close.join(_side(whole, "a"), "a").join(_side(whole, "b"), "b")
    return settle(both.where(F.size(F.array_intersect("h_a", "h_b")) * (num + den) >= (F.col("n_a") + F.col("n_b")) * num).select("a", "b"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs whose id is their component's smallest. Rows that repeat both id and text are one document.
    Only the rows that may go, and not the texts of all, are shuffled."""
    with scratch(docs.sparkSession):
        gone = near_copies(docs, id_col=id_col, text_col=text_col, **how).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
        gone = settle(gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__x")).distinct(), outer=True)
    x = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    maybe, surely_not = routed(docs, [id_col, x], gone)
    return surely_not.unionByName(maybe.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (x == F.col("__x")), "left_anti"))
