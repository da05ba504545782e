"""Scalar functions on texts, numbers and labels, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DEVANAGARI_DIGITS = "०१२३४५६७८९"

# Category keywords, highest priority first, and their labels.
CATEGORIES = [
    ("शासन निर्णय", "government resolution", "government resolution (GR)"),
    ("शासन आदेश", "government order", "government order (GO)"),
    ("परिपत्रक", "circular", "circular"),
    ("अधिसूचना", "notification", "notification"),
    ("कार्यालयीन आदेश", "office order", "office order"),
]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs without white space, in order."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def tokenize(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits and Devanagari characters; anything else separates."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9ऀ-ॿ]+"), F.lit(0))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, DEVANAGARI_DIGITS, "0123456789")


def canonical_number(number: Column) -> Column:
    """Form of a printed order number for matching: digits in ASCII, lower case, no blanks or punctuation but single slashes; null if nothing is left."""
    noise = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.\-\x{2013}\x{2014}_,;:()\[\]]+"
    bare = F.regexp_replace(F.lower(ascii_digits(number)), noise, "")
    return F.nullif(F.btrim(F.regexp_replace(bare, "/+", "/"), F.lit("/")), F.lit(""))


def script_language(text: Column) -> Column:
    """mr where Devanagari characters are as many as Latin letters, en where fewer, null where neither occurs."""
    deva, latin = F.regexp_count(text, F.lit(r"[ऀ-ॿ]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(deva + latin == 0, F.lit(None)).when(deva >= latin, "mr").otherwise("en")


def category(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for mr, en, label in CATEGORIES:
        hit = text.contains(mr) | low.contains(en)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def token_estimate(text: Column, rate: float = 2.0) -> Column:
    """Estimated tokens: 1.33 for a run of Latin letters and digits, ``rate`` for a Devanagari character, rounded down."""
    latin, deva = F.regexp_count(text, F.lit(r"[A-Za-z0-9]+")), F.regexp_count(text, F.lit(r"[ऀ-ॿ]"))
    return F.floor(F.lit(1.33) * latin + F.lit(rate) * deva).cast("int")


def date_from_id(doc_id: Column) -> Column:
    """YYYY-MM-DD of the digits an id starts with; the calendar is not checked."""
    p = r"^(\d{4})(\d{2})(\d{2})"
    return F.when(doc_id.rlike(p), F.concat_ws("-", *[F.regexp_extract(doc_id, p, k) for k in (1, 2, 3)]))


def looks_like_number(text: Column) -> Column:
    """Whether a piece of text has the shape of an order number: a slash, a digit, at most 80 characters, no bare date."""
    plain = ascii_digits(text)
    parts = F.split(F.regexp_replace(plain, r"\.$", ""), "[/.-]")
    digits = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.length(p)).otherwise(0))
    bare_date = (F.size(parts) == 3) & F.get(digits, F.lit(0)).between(1, 4) & F.get(digits, F.lit(1)).between(1, 2) & F.get(digits, F.lit(2)).between(2, 4)
    return text.contains("/") & (F.length(text) <= 80) & plain.rlike("[0-9]") & ~bare_date


def short_title(text: Column, limit: int = 60) -> Column:
    """White space collapsed; cut to ``limit`` characters with an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…")))
