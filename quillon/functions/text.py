"""Text functions: cleaning, tokenising, stop words. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32 ASCII punctuation characters, and what cleaning removes, in this order.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
REMOVED = (r"https?://[^\n]*/[a-zA-Z0-9]*", r"&quot;|&amp&#39;", r"@[a-zA-Z0-9]*", r"\$[a-zA-Z0-9]*", r"[0-9]+")

#: English stop words; a parameter wherever they are used.
STOP_WORDS = tuple(
    "a about after all also an and any are as at be because been but by can could did do does for from had has have he her him his how i if in into is it its just like me more my no not now of on one only or other our out over she so some such than that the their them then there these they this to up us was we were what when which who will with would you your".split()
)


def clean(text: Column) -> Column:
    """Links, quote entities, citations, tickers, digits, then punctuation; a null text stays null."""
    for pattern in REMOVED:
        text = F.regexp_replace(text, pattern, "")
    return F.translate(text, PUNCTUATION, "")


def tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct lower-case tokens of two or more letters, digits or underscores, stop words left out."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in stop_words]).cast("array<string>"))
