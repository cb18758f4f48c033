"""License scans: an Aho-Corasick automaton over words, and licence expressions by shunting-yard."""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import ASCII_WORDS, map_texts

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Phrases of common notices, as words, and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "the mit license": "mit",
    "licensed under the apache license": "apache",
    "apache license version": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "released into the public domain": "public-domain",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
}
TAG = "spdx license identifier"

#: How freely a licence lets its text be used again, from 0 to 1, by the start of its identifier.
FREEDOM = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "cc-by-nc": 0.2, "cc-by-nd": 0.3, "cc-by-sa": 0.6, "cc-by": 0.9, "mpl": 0.7, "epl": 0.6, "lgpl": 0.6, "agpl": 0.3, "gpl": 0.4}

#: What a notice of each kind adds to the score: 1 - the product of (1 - weight).
WEIGHTS = {"base": 0.6, "notice": 0.8, "expression": 0.95}

TOKEN = re.compile(rb"[ \t\x0b-\r]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BINDS = {"or": 1, "and": 2, "with": 3}


BY_LENGTH = sorted(FREEDOM.items(), key=lambda x: -len(x[0]))


def freedom(licence: str) -> float:
    return next((v for k, v in BY_LENGTH if licence.startswith(k)), 0.5)


def to_rpn(data: bytes, start: int = 0, end: int | None = None) -> list[str]:
    """The longest expression that stands at ``start``, in reverse Polish order; [] if there is none.

    Shunting-yard: WITH binds tightest, then AND, then OR; all from left to right. An expression ends
    at ``end`` or the end of its line, or where two licences follow each other without an operator.
    Nothing is copied for a token, so that time is linear in the expression.
    """
    end = len(data) if end is None else end
    out: list[str] = []
    ops: list[str] = []
    whole: tuple[int, list[str]] = (0, [])  # how much of out, and the operators that follow it
    want, at, depth = True, start, 0
    while m := TOKEN.match(data, at, end):
        t, at = m[1].decode().lower().rstrip(".:-"), m.end()
        if t == "(":
            if not want:
                break
            ops.append(t)
            depth += 1
        elif t == ")":
            if want or not depth:
                break
            while (o := ops.pop()) != "(":
                out.append(o)
            depth -= 1
        elif t in BINDS:
            if want:
                break
            while ops and ops[-1] != "(" and BINDS[ops[-1]] >= BINDS[t]:
                out.append(ops.pop())
            ops.append(t)
            want = True
            continue
        else:
            if not want:
                break
            out.append(t)
            want = False
        if not want and not depth:
            whole = len(out), ops[::-1]  # without brackets, three operators at most
    return out[: whole[0]] + whole[1]


def evaluate(rpn: list[str]) -> tuple[float, set[str]]:
    """Freedom of use and the licences named: of OR the freer side holds, of AND the stricter; an
    exception after WITH lifts its licence half-way to free."""
    stack: list[tuple[float, set[str]]] = []
    for t in rpn:
        if t not in BINDS:
            stack.append((freedom(t), {t}))
            continue
        (b, names_b), (a, names_a) = stack.pop(), stack.pop()
        if t == "with":
            stack.append(((a + 1) / 2, names_a))
        else:
            more, fewer = (names_a, names_b) if len(names_a) >= len(names_b) else (names_b, names_a)
            more |= fewer
            stack.append(((max if t == "or" else min)(a, b), more))
    return stack[0]


@functools.cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, what in [*((p, ("base", label)) for p, label in BASE.items()), *((p, ("notice", label)) for p, label in NOTICES.items()), (TAG, ("tag", ""))]:
        found.add_word(f" {phrase} ", (len(phrase) + 1, len(phrase.split()), what))
    found.make_automaton()
    return found


def scan(data: bytes) -> tuple:
    words = data.translate(ASCII_WORDS).split()
    line = b" ".join([b"", *words, b""])
    base: list[int] = []
    base_labels, labels, kinds, free, expressions = set(), set(), set(), [], []
    blanks: np.ndarray | None = None  # in line: as many stand before a phrase as words do
    ends: list[int] = []  # of the words in data
    newline = -1  # the first one after the last tag
    for end, (length, n, (kind, label)) in automaton().iter(line.decode("latin-1")):
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        word = int(np.searchsorted(blanks, end - length))
        if kind == "base":
            base.append(word)
            base_labels.add(label)
            free.append(freedom(label) if label != "reserved" else 0.0)
        elif kind == "notice":
            labels.add(label)
            free.append(freedom(label))
        else:
            if not ends:
                ends = [m.end() for m in WORD.finditer(data)]
            after = ends[word + n - 1]
            if newline < after:
                newline = data.find(b"\n", after)
                newline = len(data) if newline < 0 else newline
            rpn = to_rpn(data, after + 1, newline) if data[after : after + 1] == b":" else []
            if not rpn:
                continue
            value, names = evaluate(rpn)
            labels |= names
            free.append(value)
            expressions.append(" ".join(rpn))
            kind = "expression"
        kinds.add(kind)
    score = 1.0
    for k in kinds:
        score *= 1 - WEIGHTS[k]
    return (
        len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | labels)),
        round(1 - score, 6), min(free, default=None), ";".join(expressions),
    )


COLUMNS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, freedom double, expressions string"


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, and the columns of COLUMNS.

    Words are runs of ASCII letters, digits and all characters from U+0080, A-Z lower-cased. n_base,
    first_word, last_word and base_labels tell where the base phrases stand; labels adds those of
    other notices and of the licences in ``SPDX-License-Identifier:`` expressions; expressions has
    these in reverse Polish order. score (0 to 1) tells how surely the text carries a licence notice;
    freedom is the strictest use that any notice leaves (null without one). A null or empty text has
    no words, empty labels and score 0. Only ASCII blanks part the tokens of an expression. Rows stay as they are, repeated ones too; an empty table gives
    no rows. Nothing is shuffled.
    """
    return map_texts(docs, [F.col(id_col).alias("doc_id")], COLUMNS, lambda: lambda texts: map(scan, texts), text_col=text_col)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
