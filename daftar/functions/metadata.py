"""Header fields of an order's text: number, date, department, title, category, language and references.

A text is read as lines and as sections, which are cut where a line begins with
one of the stated words and a colon.  Fields are column expressions over them.
Only the printed references need one pass with a state, over the separators of
their section: what opens an item, ends a candidate or announces a date.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.functions import text as tx
from daftar.operators.timestamps import MONTHS

# Words of the header lines, and the state's name, which is no title.
ORDER_KINDS = ("शासन निर्णय", "शासन आदेश", "आदेश", "परिपत्रक", "अधिसूचना")
ENGLISH_NUMBER = ("Government Resolution No", "Government Order No", "G.R. No", "G. R. No", "GR No", "G.R.No", "GRNo")
NUMBER_WORDS = ("क्रमांक", "क्रमाक", "क्र", "Number", "No")
DATE_WORDS = ("दिनांक", "दिनाक", "तारीख", "दि", "Dated", "Date", "Dt")
REFERENCE_WORDS, SUBJECT_WORDS = ("वाचा", "संदर्भ", "Reference", "Read"), ("विषय", "Subject")
BODY_WORDS = ("प्रस्तावना", "शासन निर्णय", "Preamble")
DEPARTMENT_WORDS, STATE = ("विभाग", "Department"), "महाराष्ट्र शासन"
REPLACES = ("अधिक्रमित", "अधिक्रमीत", "supersed")

_YEARS = (1900, 2035)
_COLON, _SIGNS = "[:：ः]", r"[\s.:：ः–-]*"
_EDGES = " .,;:।-–"


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def _some(c: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def _rest_of_line(text: Column, label: str) -> Column:
    return _some(F.regexp_extract(text, label + _SIGNS + r"([^\n]+)", 1))


def section(text: Column, opens: tuple[str, ...], closes: tuple[str, ...], colon: bool) -> Column:
    """What follows the first of the words ``opens`` up to a line that begins with a word of ``closes`` and a colon; empty if there is none.

    ``colon`` asks for a colon after the opening word too.
    """
    label = _any(opens) + (rf"\s*{_COLON}" if colon else "") + _SIGNS
    parts = F.split(text, rf"\n\s*(?={_any(closes)}\s*{_COLON})")
    first = F.get(F.filter(parts, lambda p: p.rlike(label)), F.lit(0))
    return F.coalesce(F.regexp_extract(first, rf"(?s){label}(.*)", 1), F.lit(""))


def reference_block(text: Column) -> Column:
    """The section that lists what an order refers to; empty if it has none."""
    return section(text, REFERENCE_WORDS, SUBJECT_WORDS + BODY_WORDS, False)


def trim_number(raw: Column) -> Column:
    """A number without what follows a date word, a wide gap or a danda, and without punctuation around it."""
    end = rf"(?<![ऀ-ॿ]){_any(DATE_WORDS)}{_SIGNS}(?=[\d०-९])|\s{{2,}}|।"
    return F.nullif(F.btrim(F.regexp_replace(F.get(F.split(raw, end), F.lit(0)), r"\s+", " "), F.lit(_EDGES)), F.lit(""))


_MONTH_OF = {n: m for m, names in MONTHS.items() for n in names.split() if len(n) > 3 or not n.isascii() or n == "may"}


def _real_day(parts: Column) -> Column:
    """YYYY-MM-DD of [year, month, day] as numbers; null if the calendar or the span of years has no such day."""
    text = F.concat_ws("-", *[F.lpad(F.get(parts, F.lit(k)).cast("string"), n, "0") for k, n in enumerate((4, 2, 2))])
    return F.when(F.get(parts, F.lit(0)).between(*_YEARS), F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd"))


def _day_of_run(run: Column) -> Column:
    """The day that a run of digits and separators writes, told by how many digits its parts have: day first, or the year with dashes."""
    parts = F.transform(F.split(run, "[/.-]"), lambda p: p.try_cast("int"))

    def turned(p: Column) -> Column:
        short = F.get(p, F.lit(2))
        return F.array(F.when(short >= 100, short).when(short < 70, short + 2000).otherwise(short + 1900), F.get(p, F.lit(1)), F.get(p, F.lit(0)))

    return F.when(run.rlike(_YEAR_FIRST), tx.bound(parts, _real_day)).otherwise(tx.bound(tx.bound(parts, turned), _real_day))


_DAY_FIRST, _YEAR_FIRST = r"^[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}$", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"


def iso_date(raw: Column) -> Column:
    """The first real date of a line: day month-word year, else day/month/year, else year-month-day.

    Numeric dates are whole runs of digits and separators.  Two-digit years
    below 70 are 20xx.
    """
    months = F.create_map(*[F.lit(x) for pair in _MONTH_OF.items() for x in pair])

    def of_words(found: Column) -> Column:
        return _real_day(F.array(F.get(found, F.lit(2)).try_cast("int"), F.try_element_at(months, F.lower(F.get(found, F.lit(1)))), F.get(found, F.lit(0)).try_cast("int")))

    def read(s: Column) -> Column:
        spelled = F.regexp_extract(s, r"[0-9]{1,2}\s+[^\s,]+[,\s]+[0-9]{4}", 0)
        by_word = F.when(s.rlike(r"[0-9]\s+[^\s,]+[,\s]+[0-9]"), tx.bound(F.split(spelled, r"[\s,]+"), of_words))
        runs = F.regexp_extract_all(s, F.lit(r"[0-9][0-9/.-]*[0-9]"), F.lit(0))
        first = lambda shape: F.get(F.filter(runs, lambda r: r.rlike(shape)), F.lit(0))
        return F.coalesce(by_word, tx.bound(first(_DAY_FIRST), _day_of_run), tx.bound(first(_YEAR_FIRST), _day_of_run))

    return F.when(raw.rlike("[0-9०-९]"), tx.bound(tx.ascii_digits(raw), read))


_REFS = T.ArrayType(T.StructType([T.StructField("number", T.StringType()), T.StructField("dated", T.StringType())]))
# What ends a candidate: a numbered item, an announced date, a wide gap (which also mutes what follows), or a stop.
_SEPARATOR = re.compile(
    rf"(?P<item>\n\s*(?:[(\[]?\s*\d\d?\s*[)\].])?|(?<![^\s.।])[(\[]?\d\d?[)\]](?=\s))|(?P<date>(?<![ऀ-ॿ]){_any(DATE_WORDS)}{_SIGNS}(?=\d))|(?P<gap>[^\S\n]{{2,}})|(?P<stop>[,;।])"
)
_LABEL = re.compile(_any(NUMBER_WORDS) + _SIGNS)
_DAY = re.compile("[/.-]".join((r"\d{1,4}", r"\d{1,2}", r"\d{2,4}")) + r"(?!\d)\.?\s*")
_DATE_REACH = 40  # characters after a date word in which its date stands


def _as_number(candidate: str) -> str | None:
    """The order number that a stretch between separators prints: what follows the last label before its first slash, else all of it."""
    if lead := _DAY.match(candidate.lstrip()):
        candidate = candidate.lstrip()[lead.end() :]
    head, slash, tail = candidate.partition("/")
    if not slash:
        return None
    for text in dict.fromkeys((_LABEL.split(head)[-1] + slash + tail, candidate)):
        text = " ".join(text.split()).strip(_EDGES)
        if "/" in text and len(text) <= 80 and any(c.isdecimal() for c in text):
            return text
    return None


def _read_references(block: str | None) -> list[tuple[str, str | None]]:
    numbers: list[tuple[str, int]] = []
    dated: dict[int, list[str]] = {}
    item = start = 0
    muted = False
    text = "\n" + (block or "")
    for sep in [*_SEPARATOR.finditer(text), None]:
        candidate = text[start : sep.start() if sep else len(text)]
        if not muted and (number := _as_number(candidate)):
            numbers.append((number, item))
        if sep is None:
            break
        start, muted = sep.end(), sep.lastgroup == "gap"
        item += sep.lastgroup == "item"
        if sep.lastgroup == "date":
            dated.setdefault(item, []).append(text[start : start + _DATE_REACH].split("\n")[0])
    return [(n, " | ".join(dated[i]) if i in dated else None) for n, i in numbers]


@F.pandas_udf(_REFS)
def printed_references(block: pd.Series) -> pd.Series:
    """(number, dated) of each reference in a section; ``dated`` is the text after the item's date words, to be read as a date."""
    return block.map(_read_references)


def fields(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gr_number, date, department, title, category, language): what a header says without its references, all on the JVM side."""
    t = F.col(text)
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))  # one argument, or the index would be taken for the characters to trim
    opening = F.get(F.filter(lines, lambda x: (F.length(x) > 25) & ~x.startswith("#") & ~x.contains(STATE)), F.lit(0))
    number = F.coalesce(_rest_of_line(t, rf"{_any(ORDER_KINDS)}\s*{_any(NUMBER_WORDS[:1] + NUMBER_WORDS[2:3])}"), _rest_of_line(t, _any(ENGLISH_NUMBER)))
    office = lambda all_: F.coalesce(*[F.get(F.filter(all_, ends_with(w)), F.lit(0)) for w in DEPARTMENT_WORDS])
    ends_with = lambda w: lambda x: x.endswith(w) & (F.length(x) <= 60 + len(w))
    subject = _some(section(t, SUBJECT_WORDS, REFERENCE_WORDS + BODY_WORDS, True))
    return df.select(
        key,
        F.substring(trim_number(number), 1, 80).alias("gr_number"),
        iso_date(_rest_of_line(t, _any(tuple(w for w in DATE_WORDS if len(w) > 2)))).alias("date"),
        F.regexp_replace(tx.bound(lines, office), r"\s+", " ").alias("department"),
        F.substring(F.regexp_replace(F.coalesce(subject, opening), r"\s+", " "), 1, 300).alias("title"),
        tx.category(t).alias("category"), tx.script_language(t).alias("language"), *[c for c in df.columns if c not in _FIELDS + (key,)],
    )


_FIELDS = ("gr_number", "date", "department", "title", "category", "language", "refs", "supersedes")


def extract(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with gr_number, date, department, title, category, language, refs and supersedes read from each text.

    Columns of these names in ``df`` are replaced, all others stay; rows are
    neither joined nor moved.  What a header does not say is null.  ``refs``
    holds (number, date) of each cited order once, in order, without the order
    itself; a date is read only from its own reference.  Null texts give nulls.
    """
    out = fields(df, key, text).withColumn("__refs", printed_references(reference_block(F.col(text))))
    out = out.withColumn("__own", tx.canonical_number(F.col("gr_number")))
    canons = F.transform("__refs", lambda r: tx.canonical_number(r["number"]))

    def once(known: Column) -> Column:
        first = lambda r, i: F.get(known, i).isNotNull() & ~F.coalesce(F.get(known, i) == F.col("__own"), F.lit(False)) & (F.array_position(known, F.get(known, i)) == i + 1)
        return F.filter("__refs", first)

    out = out.withColumn("refs", F.transform(tx.bound(canons, once), lambda r: F.struct(r["number"].alias("number"), iso_date(r["dated"]).alias("date"))))
    replaces = F.lower(F.col(text)).rlike(_any(REPLACES))
    return out.withColumn("supersedes", F.coalesce((F.size("refs") > 0) & replaces, F.lit(False))).drop("__refs", "__own")
