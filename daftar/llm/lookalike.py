"""One consistent form for text that looks the same.

Two forms of a value are made, each once per distinct value:

* ``look``: the compatibility composed form (NFKC) wherever that keeps the look
  (width, fonts, ligatures, letter-like numerals, contextual shapes), with white
  space mapped, default-ignorable characters removed, and letters of other
  alphabets of the same shape, short hyphens and the ways to compose a letter
  brought to one.  Case, accents, digit scripts, superscripts, fractions, visible
  spaces and punctuation stay apart.  The steps run until nothing changes, so
  ``look(look(x)) == look(x)``.
* ``fold``: NFKC under full case folding of ``look``, for comparisons that
  disregard case too.

Values look the same if their ``look`` is equal.  Equal looks have equal folds,
so ``fold`` may only group: case tells values apart here.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other alphabets drawn like Latin letters (Greek, Cyrillic, Armenian, Cherokee, Lisu).
_SHAPES = {
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϳοανυριϲ": "ABEZHIKMNOPTYXCJjoavupic",
    "АВЕЅІЈКМНОРСТУХԌԚԜаеѕіјорсухԁԛԝһӀӏҮүѴѵҺ": "ABESIJKMHOPCTYXGQWaesijopcyxdqwhIlYyVvh",
    "ՍՕԼհոսօց": "UOLhnuog",
    "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃᏀ": "ABCDEHJKLMPRSTVWZG",
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPDTGKJCZFMNLSRVHWXYAEIOU",
}

# Sequences of Devanagari characters drawn like one sign or letter.
_COMPOSED = {
    "ाे": "ो", "ाै": "ौ", "ाॅ": "ॉ", "ाॆ": "ॊ", "अॆ": "ऄ", "अा": "आ", "अो": "ओ", "अौ": "औ", "अॉ": "ऑ", "अॊ": "ऒ", "अॅ": "ॲ",
    "आे": "ओ", "आै": "औ", "आॅ": "ऑ", "आॆ": "ऒ", "एे": "ऐ", "एॅ": "ऍ", "एॆ": "ऎ", "उु": "ऊ", "र्इ": "ई",
    "अऺ": "ॳ", "अऻ": "ॴ", "आऺ": "ॴ", "अॏ": "ॵ", "अॖ": "ॶ", "अॗ": "ॷ",
}

# Short hyphens other than the hyphen-minus (hyphen, non-breaking, bullet, small).
_HYPHENS = (0x2010, 0x2011, 0x2043, 0xFE63)

# Ranges of Unicode's Default_Ignorable_Code_Point.
_IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)


# Kinds of compatibility mapping that keep the look; others (super, sub, fraction, circle, square, small, vertical) change it.
_SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")
# Letters whose compatibility mapping is drawn otherwise (long s, Greek symbol forms, letter with apostrophe).
_DRAWN_OTHERWISE = "ŉſϐϑϒϓϔϕϖϰϱϴϵẚẛ"
# White space other than the blank that is no line feed.
_WHITE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\u2028\u2029"


class _Shapes:
    """The mappings of ``look``, built once per process from the character database and the fixed values above."""

    def __init__(self):
        table: dict[str, str] = {c: " " for c in _WHITE}
        # Compatibility mappings go by kind; ligatures and numerals have none but map to letters alone.
        for code in (*range(0xA0, 0x3400), *range(0xA640, 0xA7FF), *range(0xFB00, 0x10000), *range(0x1D400, 0x1EF00), *range(0x1FBF0, 0x1FBFA)):
            c = chr(code)
            kind = unicodedata.decomposition(c).split(" ")[0]
            if unicodedata.category(c) == "Zs":
                table[c] = " "
            elif kind in _SAME_LOOK or (kind == "<compat>" and c not in _DRAWN_OTHERWISE and unicodedata.normalize("NFKC", c).isalpha()):
                table[c] = unicodedata.normalize("NFKC", c)
        for other, latin in _SHAPES.items():
            table.update(zip(other, latin, strict=True))
        table.update((chr(h), "-") for h in _HYPHENS)
        self.table = {c: "".join(table.get(x, x) for x in to) for c, to in table.items()}
        self.ignorable = re.compile("\r(?=\n)|[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _IGNORABLE if b < 0x10000) + "]+")
        self.odd = re.compile("[" + "".join(re.escape(c) for c in sorted(table) if ord(c) < 0x10000) + "]")
        composed = (chr(c) for c in (*range(0xA0, 0x530), *range(0x1E00, 0x2000)) if unicodedata.normalize("NFD", chr(c))[0] in table)
        self.alien = re.compile("[" + "".join(re.escape(c) for c in sorted({*composed, *(c for c in table if ord(c) < 0x10000)})) + "]")
        # Sets beyond the basic plane are slow to search, so those characters have their own patterns.
        self.far = re.compile("[\U00010000-\U0010ffff]")
        self.far_ignorable = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _IGNORABLE if b >= 0x10000) + "]+")
        by_first: dict[str, str] = {}
        for p in _COMPOSED:
            if len(p) == 2:
                by_first[p[0]] = by_first.get(p[0], "") + p[1]
        self.pairs = re.compile("|".join(f"{a}[{b}]" for a, b in by_first.items()))
        self.longer = [p for p in _COMPOSED if len(p) > 2]

    def once(self, text: str) -> str:
        text = self.ignorable.sub("", text)
        if self.far.search(text):
            text = self.far.sub(lambda m: self.table.get(m[0], m[0]), self.far_ignorable.sub("", text))
        if self.alien.search(text):
            # Letters are mapped apart from their signs, as one may come composed and the other not.
            text = self.odd.sub(lambda m: self.table[m[0]], unicodedata.normalize("NFD", text))
        text = unicodedata.normalize("NFC", text)
        for p in self.longer:
            text = text.replace(p, _COMPOSED[p])
        return self.pairs.sub(lambda m: _COMPOSED[m[0]], text)


_shapes = lru_cache(maxsize=1)(_Shapes)


def look(text: str) -> str:
    """The form in which texts that look the same are the same characters; lines stay lines."""
    shapes = _shapes()
    if text.isascii() and not shapes.odd.search(text):
        return text
    while (made := shapes.once(text)) != text:
        text = made
    return text


def fold(text: str) -> str:
    """Compatibility composed form under full case folding of ``look(text)``, to a fixed point."""
    seen = look(text)
    while True:
        was = seen
        seen = look(unicodedata.normalize("NFKC", seen.casefold()))
        if seen == was:
            return seen


def _per_distinct(values: pd.Series, form) -> pd.Series:
    codes, distinct = pd.factorize(values)
    made = pd.Series([form(x) for x in distinct], dtype=object)
    return pd.Series(made.reindex(codes).where(codes >= 0, None).to_numpy(dtype=object), index=values.index)


@F.pandas_udf(T.StringType())
def look_column(values: pd.Series) -> pd.Series:
    return _per_distinct(values, look)


def normalise(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with each of ``columns`` in its ``look`` form; nulls stay null, empty texts empty, nothing else changes."""
    return df.withColumns({c: look_column(F.col(c)) for c in columns})


_KEYS = T.StructType([T.StructField(c, T.BinaryType()) for c in ("fold", "look", "raw")])


@F.pandas_udf(_KEYS)
def keys_column(values: pd.Series) -> pd.DataFrame:
    """128-bit digests of the three forms; the texts themselves stay behind."""
    from hashlib import blake2b

    codes, distinct = pd.factorize(values)
    digest = lambda x: blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    made = []
    for x in distinct:
        seen = look(x)
        made.append((digest(fold(seen)), digest(seen), digest(x)))
    none = (None, None, None)
    return pd.DataFrame([made[c] if c >= 0 else none for c in codes], columns=["fold", "look", "raw"])


def keyed(df: DataFrame, owner: str, value: str) -> DataFrame:
    """Distinct (owner, fold, look, raw) digests of a column of long texts, read where they lie; null owners and values are left out."""
    rows = df.select(F.col(owner).cast("string").alias("owner"), F.col(value).alias("v")).where("owner is not null and v is not null")
    return rows.select("owner", keys_column("v").alias("k")).select("owner", "k.fold", "k.look", "k.raw").distinct()


def spelled(values: DataFrame, value: str) -> DataFrame:
    """(fold, look, raw) of a column of short values, made once per distinct value of the whole table; ``raw`` is the value itself."""
    rows = values.select(F.col(value).alias("raw")).where("raw is not null").distinct()
    return rows.select("raw", keys_column("raw").alias("k")).select("k.fold", "k.look", "raw")


def owners(df: DataFrame, owner: str, value: str) -> DataFrame:
    """Distinct (owner, raw) of a column of short values."""
    return df.select(F.col(owner).cast("string").alias("owner"), F.col(value).alias("raw")).where("owner is not null and raw is not null").distinct()


def twins(spellings: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(owner_a, owner_b), a < b: owners of values of equal look and different characters.

    ``spellings`` has fold, look and raw, ``left`` and ``right`` owner and raw.
    Folds that hold one spelling only cannot give a pair and leave first.  The
    join then runs over (look, spelling) pairs, so its work is that of its
    output and a spelling shared by many owners meets no copy of itself.
    Repeated rows count once; empty tables give no pair.
    """
    s = spellings.select("fold", "look", "raw").distinct()
    several = s.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fold")
    s = s.join(several, "fold", "left_semi")
    pair = s.select("look", F.col("raw").alias("raw_a")).join(s.select("look", F.col("raw").alias("raw_b")), "look").where("raw_a <> raw_b").select("raw_a", "raw_b")
    a = left.select(F.col("owner").alias("x"), F.col("raw").alias("raw_a"))
    b = right.select(F.col("owner").alias("y"), F.col("raw").alias("raw_b"))
    met = a.join(pair, "raw_a").join(b, "raw_b").where("x <> y")
    return met.select(F.least("x", "y").alias("owner_a"), F.greatest("x", "y").alias("owner_b")).distinct()
