"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import map_texts

#: A long text is cut where no match of the split pattern can span the cut: between a character that
#: is no white space and a following white space, and between a letter and a digit.
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")

KINDS = {"ids": "array<int>", "decoded": "binary", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


@functools.lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str):
    """One a Python worker; the file is local to every machine."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, chunk: int):
    """Parts of about ``chunk`` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > chunk:
        cut = SAFE.search(text, at + chunk)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode_text(enc, text: str, chunk: int) -> np.ndarray:
    found = [enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text, chunk)]
    return (found[0] if len(found) == 1 else np.concatenate(found)).astype("<u4", copy=False)


def decode_ids(enc, ids: np.ndarray) -> bytes:
    """Raw bytes: an id may be part of a code point, so nothing is decoded to text here."""
    return enc.decode_bytes(ids.tolist())


def bpe(docs: DataFrame, *, rank_file: str, pattern: str, outputs: tuple[str, ...] = ("ids", "decoded"), keep: list[str] | None = None, text_col: str = "text", chunk: int = 1 << 16) -> DataFrame:
    """The columns ``keep`` of docs (default: all), and those of ``outputs``: ids (array<int>), decoded
    (binary, from the ids), n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers), decoded_sha256.

    Each match of ``pattern`` is merged separately; no special tokens exist, so their strings are
    ordinary text. A null or empty text has no ids. Bytes that are no UTF-8 count as U+FFFD. Texts of
    over ``chunk`` characters are encoded in parts cut at safe boundaries, with the same ids as the
    whole; a part without such a boundary stays whole. Columns of docs named like an output are replaced.
    An empty table gives no rows. Nothing is shuffled.
    """

    def make():
        enc = encoding(rank_file, pattern)
        of = {
            "ids": lambda ids, decoded: ids.astype(np.int32),
            "decoded": lambda ids, decoded: decoded,
            "n_tokens": lambda ids, decoded: len(ids),
            "ids_sha256": lambda ids, decoded: hashlib.sha256(ids.tobytes()).hexdigest(),
            "decoded_sha256": lambda ids, decoded: hashlib.sha256(decoded).hexdigest(),
        }
        wanted = [of[name] for name in outputs]
        decodes = any(name.startswith("decoded") for name in outputs)

        def run(texts):
            for data in texts:
                ids = encode_text(enc, data.decode("utf-8", "replace"), chunk)
                decoded = decode_ids(enc, ids) if decodes else b""
                yield tuple(f(ids, decoded) for f in wanted)

        return run

    kept = [F.col(c) for c in (keep or docs.columns) if c not in outputs]
    return map_texts(docs, kept, ", ".join(f"{name} {KINDS[name]}" for name in outputs), make, text_col=text_col, batch_rows=128)


def decode(df: DataFrame, *, rank_file: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The columns of df, and ``decoded`` (binary) of its array of ids; null ids give null."""
    kept = df.drop("decoded")
    names = [*kept.columns, "decoded"]

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            made = [None if x is None else enc.decode_bytes(x) for x in batch.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(made, pa.binary())], names=names)

    return df.select(*kept.columns, F.col(ids_col).alias("__ids")).mapInArrow(run, kept.schema.add("decoded", "binary"))


def vocabulary() -> dict[str, str]:
    import public_tokenizers

    return {"rank_file": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe(docs, **vocabulary(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])
