"""What several operators share: walking over whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: For bytes.translate: ASCII letters lower-cased, digits and bytes from 0x80 kept, all else made a space.
ASCII_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def map_texts(docs: DataFrame, keep: list, schema: str, make: Callable[[], Callable[[list[bytes]], Iterable[tuple]]], *, text_col: str = "text", batch_rows: int = 256) -> DataFrame:
    """The columns ``keep`` of docs, untouched, and one tuple of ``schema`` for each row's text.

    ``make()`` is called once a task; what it returns gets the UTF-8 bytes of up to ``batch_rows``
    texts at once (null as empty) and gives a tuple for each.
    """
    given = docs.select(*keep, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("__bytes"))
    kept, added = given.drop("__bytes"), StructType.fromDDL(schema)
    fields = list(to_arrow_schema(added))
    names = [*kept.columns, *added.names]

    def run(batches):
        f = make()
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                rows = list(f(batch.columns[-1].to_pylist()))
                made = [pa.array([r[i] for r in rows], x.type) for i, x in enumerate(fields)]
                yield pa.RecordBatch.from_arrays(batch.columns[:-1] + made, names=names)

    return given.mapInArrow(run, StructType([*kept.schema.fields, *added.fields]))


PIECE = 1 << 17  # bytes of text that are hashed at a time, unless one text has more
EXACT = 4096  # counts below this have a row each in the histogram of counts

#: ASCII blanks.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A random value for each byte, the same for A-Z as for a-z, and an odd base with its inverse mod 2**64.
_VALUE = np.random.default_rng(20_240_501).integers(1 << 63, (1 << 64) - 1, 256, np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Words:
    """Splits and hashes texts without a step for each word.

    A word's hash is the sum of value[byte] * base**i over its bytes, taken from running sums over the
    whole buffer, then mixed.
    """

    def __init__(self):
        self.powers = self.inverses = np.empty(0, np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words, text after text, and how many words each text has."""
        whole = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        n = len(whole)
        if n > len(self.powers):
            size = max(n, 2 * PIECE)
            self.powers, self.inverses = (np.cumprod(np.full(size, x, np.uint64)) for x in (_BASE, _INVERSE))
        edges = np.flatnonzero(np.diff(~_BLANK[whole], prepend=False))  # the buffer ends with a blank
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[whole] * self.powers[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverses[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        if n > 8 * PIECE:
            self.powers = self.inverses = np.empty(0, np.uint64)  # one very long text doesn't keep its memory
        return h, np.diff(np.searchsorted(starts, bounds), prepend=0)


def pieces(batch, column: int = -1, rows: int = 64) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, texts): the rows of a batch, some PIECE bytes at a time."""
    start, texts, held = 0, [], 0
    for at in range(0, batch.num_rows, rows):
        texts += batch.columns[column].slice(at, rows).to_pylist()
        held = sum(map(len, texts))
        if held >= PIECE or at + rows >= batch.num_rows:
            yield start, start + len(texts), texts
            start, texts = start + len(texts), []


def bytes_of(text_col: str):
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """Of counts (h, c), h distinct hashes: the most frequent ones' hashes and counts, descending; the
    largest count that none of them has; the sum of all counts, and how many there are.

    A histogram of counts, whose size does not depend on the input's, tells the cut; all hashes above
    it, ``most`` at most, come to the driver.
    """
    bucket = F.when(F.col("c") < EXACT, F.col("c")).otherwise(F.floor(F.log2("c") * 64) + EXACT)
    rows = counts.where("h is not null").groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.max("c").alias("top")).collect()
    taken, cut = 0, 0
    for r in sorted(rows, key=lambda r: -r["b"]):
        taken += r["n"]
        if taken > most:
            cut = r["top"]
            break
    got = counts.where(f"h is not null and c > {cut}").toArrow()
    h, c = got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy()
    by = np.lexsort((h, -c))
    return h[by], c[by], cut, sum(r["c"] for r in rows), sum(r["n"] for r in rows)


def routed(rows: DataFrame, on: list, keys: DataFrame, bits: int = 22) -> tuple[DataFrame, DataFrame]:
    """(may match, can't match): rows by whether their values of ``on`` may be among those of keys' columns.

    A filter of 2**bits bits, whatever the number of keys, is broadcast as at most 2**(bits - 6) rows of 64.
    Where keys are few, a join of the first part shuffles little of ``rows``; where they are many more than
    bits, most rows are in the first part, and nothing is lost.
    """
    at = F.pmod(F.xxhash64(*keys.columns), F.lit(1 << bits))
    words = keys.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("__w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("__m"))
    words = F.broadcast(words)
    placed = rows.withColumn("__p", F.pmod(F.xxhash64(*on), F.lit(1 << bits)))
    met = placed.join(words, F.shiftright("__p", 6) == F.col("__w"), "left")
    hit = F.coalesce(F.expr("__m & shiftleft(1L, cast(__p & 63 as int)) != 0"), F.lit(False))
    return met.where(hit).drop("__p", "__w", "__m"), met.where(~hit).drop("__p", "__w", "__m")
