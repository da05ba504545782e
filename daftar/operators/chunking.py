"""Pages and word windows of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.functions.text import words

PAGE = r"(?m)^#\s*Page\s*(\d+)\s*$"
MARK = r"^#\s*Page\s*(\d+)\s*$"  # the same, of one line


def pages(df: DataFrame, text: str) -> DataFrame:
    """``df`` plus ``page_no`` and ``page_text``, one row per page.

    Without page marks the text is page 1; text before the first mark belongs
    to no page and is dropped.  Null texts give no rows.
    """
    t = F.col(text)
    numbers = F.regexp_extract_all(t, F.lit(PAGE), F.lit(1))
    bodies = F.split(t, PAGE)
    marked = F.zip_with(F.slice(bodies, 2, F.size(numbers)), numbers, lambda b, n: F.struct(n.cast("int").alias("page_no"), b.alias("page_text")))
    single = F.array(F.struct(F.lit(1).alias("page_no"), t.alias("page_text")))
    rows = df.where(t.isNotNull()).withColumn("__pages", F.when(F.size(numbers) > 0, marked).otherwise(single))
    return rows.select("*", F.posexplode("__pages").alias("page_pos", "__page")).select(*df.columns, "page_pos", "__page.page_no", "__page.page_text")


def window_array(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words over all pages of a text, as (page_start, page_end, chunk_text, n_words); null texts and texts without words have none.

    A window begins every ``size - overlap`` words, so the last may lie inside
    the one before it.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    numbers = F.regexp_extract_all(text, F.lit(PAGE), F.lit(1))
    bodies = F.when(F.size(numbers) > 0, F.slice(F.split(text, PAGE), 2, F.size(numbers))).otherwise(F.array(text))
    at = F.when(F.size(numbers) > 0, F.transform(numbers, lambda n: n.cast("int"))).otherwise(F.array(F.lit(1)))
    tagged = F.flatten(F.zip_with(bodies, at, lambda b, n: F.transform(words(b), lambda w: F.struct(w.alias("w"), n.alias("p")))))

    def cut(all_: Column) -> Column:
        starts = F.when(F.size(all_) > 0, F.sequence(F.lit(0), F.size(all_) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        window = lambda w: F.struct(
            F.element_at(w, 1)["p"].alias("page_start"), F.element_at(w, -1)["p"].alias("page_end"),
            F.array_join(F.transform(w, lambda x: x["w"]), " ").alias("chunk_text"), F.size(w).alias("n_words"),
        )
        return F.transform(F.transform(starts, lambda s: F.slice(all_, s + 1, F.lit(size))), window)

    # The words are bound once, as the variable of a transform over one element.
    return F.flatten(F.transform(F.array(tagged), cut))


def windows(df: DataFrame, text: str, size: int = 250, overlap: int = 50) -> DataFrame:
    """``df`` plus chunk_index, page_start, page_end, chunk_text and n_words: ``window_array``, one row per window.

    One row of ``df`` is worked on in one place; no rows are shuffled.
    """
    rows = df.where(F.col(text).isNotNull()).select("*", F.posexplode(window_array(F.col(text), size, overlap)).alias("chunk_index", "__win"))
    return rows.select(*df.columns, "chunk_index", "__win.*")
