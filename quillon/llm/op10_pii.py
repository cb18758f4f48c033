"""PII: regular expressions propose spans, checksums confirm them, context words adjust their scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    pattern finds what ``find`` does, leftmost and without overlaps, in linear time: possessive
    quantifiers where nothing that follows could make use of a retreat, and a look-behind that bars
    starts inside a run whose own start has failed already.
    """

    name: str
    pattern: str
    may: str  # SQL over ``text``: false only where the pattern can't match
    valid: str  # SQL over ``t``, the text of a match
    prior: float
    context: str
    base: bool = True


DIGITS = "regexp_replace(t, '[^0-9]', '')"
# How many characters an IBAN has, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE BI", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BJ DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")"
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')", "true", 0.8, "mail|contact|write|address"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", "contains(text, '.')", "forall(split(t, '[.]', -1), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)", 0.6, "host|server|address|login|ip"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "true", f"length({DIGITS}) between 13 and 19 and luhn_check({DIGITS})", 0.7, "card|visa|credit|payment|account"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')", f"length({DIGITS}) between 9 and 15", 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Za-z]{{2}}[0-9]{{2}})(?i:{IBAN})(?![A-Za-z0-9])", "true", "mod97(t)", 0.7, "iban|bank|account|transfer", base=False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "contains(text, '-')", "true", 0.4, "ssn|social|security|insurance", base=False),
)

#: ISO 13616: the first four characters go to the end, letters count as 10 to 35, and the remainder by 97 is 1.
MOD97 = """aggregate(split(upper(concat(substr(replace({t}, ' ', ''), 5), substr(replace({t}, ' ', ''), 1, 4))), ''), 0,
  (a, c) -> case when c = '' then a when c between '0' and '9' then (a * 10 + cast(c as int)) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1"""

SPAN = "array<struct<kind:string,start:int,end:int,t:string,score:double>>"
RUN = 256  # matches that are added up in one array; code points in a block of text


def let(name: str, value: str, body: str) -> str:
    """SQL: body, in which ``name`` is a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def spans_of(kind: Kind, text: str, blocks: str, around: int) -> str:
    """SQL over the columns ``text`` and ``blocks`` (the text in blocks of RUN code points): the spans of a
    kind, those that fail its test left out.

    split() gives what lies between the matches that regexp_extract_all() gives, so that adding up
    the lengths gives every end, in code points. An array can only grow by being copied, so the lengths
    are added up in runs of RUN, each from the sum of the runs before it: linear for all practical texts.
    """
    p = "r'" + kind.pattern + "'"
    valid = kind.valid.replace("mod97(t)", MOD97.format(t="t"))
    found = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, t) -> struct(length(g) + coalesce(length(t), 0) as step, t))"
    runs = f"transform(sequence(0, (size(f) - 1) div {RUN}), i -> slice(f, i * {RUN} + 1, {RUN}))"
    offsets = "aggregate(transform(runs, r -> aggregate(r, 0, (a, x) -> a + x.step)), struct(0 as at, cast(array() as array<int>) as out), (a, n) -> struct(a.at + n as at, array_append(a.out, a.at) as out)).out"
    one = f"""aggregate(r, struct(o as at, cast(array() as array<struct<start:int,end:int,t:string>>) as out), (a, x) -> struct(a.at + x.step as at,
      case when x.t is not null and exists(array(x.t), t -> {valid}) then array_append(a.out, struct(a.at + x.step - length(x.t) as start, a.at + x.step as end, x.t as t)) else a.out end as out)).out"""
    placed = let("f", found, let("runs", runs, let("offsets", offsets, f"flatten(zip_with(runs, offsets, (r, o) -> {one}))")))
    part = lambda at, n: f"substr(concat(coalesce(get({blocks}, ({at}) div {RUN}), ''), coalesce(get({blocks}, ({at}) div {RUN} + 1), '')), ({at}) % {RUN} + 1, {n})"
    near = f"rlike(concat({part(f'greatest(x.start - {around}, 0)', f'least({around}, x.start)')}, ' ', {part('x.end', str(around))}), '(?i){kind.context}')"
    scored = f"transform({placed}, x -> struct('{kind.name}' as kind, x.start as start, x.end as end, x.t as t, cast({kind.prior} + if({near}, 0.2, 0) as double) as score))"
    return f"case when {kind.may.replace('text', text)} then {scored} else cast(array() as {SPAN}) end"


def pii_spans(docs: DataFrame, *, text_col: str = "text", around: int = 40, least_score: float = 0.5, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The columns of docs, and ``spans``: array<struct<kind, start, end, t, score>>, by kind as
    listed in ``kinds``, then by start. Offsets are code points from 0, the end exclusive.

    Matches are leftmost and don't overlap within a kind; those that fail their kind's test are
    dropped without another try. A context word within ``around`` code points (RUN at most) before or
    after a match adds 0.2 to its score. Base kinds stay whatever their score; others need ``least_score``.
    A null or empty text has no spans. Rows stay as they are, repeated ones too; columns of docs may have
    any names but those that start with ``__pii_``, and one named spans is replaced. An empty table gives
    no rows. Only SQL expressions are used, and nothing is shuffled.
    """
    if around > RUN:
        raise ValueError(f"around is {RUN} at most")
    kept = [F.col(c) for c in docs.columns if c != "spans"]
    made = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("__pii_text"))
    made = made.withColumn("__pii_blocks", F.regexp_extract_all("__pii_text", F.lit(f"(?s).{{1,{RUN}}}"), F.lit(0)))
    made = made.withColumns({f"__pii_{k.name}": F.expr(spans_of(k, "__pii_text", "__pii_blocks", around)) for k in kinds})
    low = F.lit(least_score)
    parts = [F.col(f"__pii_{k.name}") if k.base else F.filter(f"__pii_{k.name}", lambda x: x["score"] >= low) for k in kinds]
    return made.select(*kept, F.concat(*parts).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    names = [k.name for k in KINDS if k.base]
    of_kind = lambda name: F.filter("spans", lambda x: x["kind"] == name)
    counts = [F.size(of_kind(n)).cast("long").alias(f"n_{n}") for n in names]
    base = F.filter("spans", lambda x: x["kind"].isin(names))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.transform("spans", lambda x: x["score"]).alias("scores"))
