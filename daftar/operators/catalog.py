"""Reads of the register: listings, look-ups, facets and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from daftar.operators.search import containing


def matches(query: str | None, *columns: str) -> Column:
    """Whether a query occurs in any of the columns, case disregarded; its % and _ are wildcards."""
    if not query:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return hit


def facets(departments: list[str] | None = None, date_from: str | None = None, date_to: str | None = None, language: str | None = None) -> Column | None:
    """The filter of the given facets; none if none is given, which is not the same as a filter that nothing meets."""
    parts = []
    if departments is not None:
        parts.append(F.col("department").isin(departments))
    if date_from:
        parts.append(F.col("date") >= date_from)
    if date_to:
        parts.append(F.col("date") <= date_to)
    if language:
        parts.append(F.col("language") == language)
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def listing(docs: DataFrame, query: str | None = None, departments: list[str] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the register, newest first; undated orders come last."""
    hit = matches(query, "title", "gr_number", "doc_id")
    if departments is not None:
        hit = hit & F.col("department").isin(departments)
    return docs.where(hit).orderBy(F.desc_nulls_last("date"), F.desc("doc_id")).offset(offset).limit(limit)


def find(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, doc_id): the order that each asked text names.

    An exact id or number comes first, else the shortest number that contains
    it (case disregarded), ties to the smaller id.  Exact names are an
    equi-join; only what stays open is searched in the numbers, once each.
    """
    ids = docs.select(F.col("doc_id").alias("asked"), "doc_id", F.lit(0).alias("class"), F.lit(0).alias("len"))
    numbers = docs.where("gr_number is not null").groupBy("gr_number").agg(F.min("doc_id").alias("doc_id"))
    exact = asked.join(ids.unionByName(numbers.select(F.col("gr_number").alias("asked"), "doc_id", F.lit(1).alias("class"), F.length("gr_number").alias("len"))), "asked")
    open_ = asked.join(exact.select("asked"), "asked", "left_anti")
    met = containing(numbers.select(F.col("doc_id").alias("row_id"), F.lower("gr_number").alias("text")), open_.select(F.lower("asked").alias("pattern")))
    part = open_.join(met, F.lower("asked") == F.col("pattern")).join(numbers, F.col("row_id") == F.col("doc_id")).select("asked", "doc_id", F.lit(2).alias("class"), F.length("gr_number").alias("len"))
    return exact.unionByName(part).groupBy("asked").agg(F.min(F.struct("class", "len", "doc_id")).alias("m")).select("asked", "m.doc_id")


def totals(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Orders, pieces, departments and the span of dates, in one row."""
    d = docs.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("department").alias("departments"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return d.crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))  # one row each


def by_department(docs: DataFrame) -> DataFrame:
    return docs.groupBy("department").agg(F.count(F.lit(1)).alias("documents"))


def joined_text(chunks: DataFrame) -> DataFrame:
    """(doc_id, text): the pieces of each order in order, overlap included."""
    g = chunks.groupBy(F.col("gr_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "faiss_id", "text"))).alias("p"))
    return g.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def recent(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The last ``n`` rows of each group with ``place`` 1 .. n, oldest first; ``order`` is newest first."""
    w = W.partitionBy(group)
    last = df.withColumn("__k", F.row_number().over(w.orderBy(*order))).where(F.col("__k") <= n)
    return last.withColumn("place", F.max("__k").over(w) - F.col("__k") + 1).drop("__k")


def by_id(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The orders of the asked ids (doc_id), one row each."""
    return docs.join(asked.select("doc_id").distinct(), "doc_id", "left_semi")


def from_pieces(chunks: DataFrame) -> DataFrame:
    """(doc_id, content_type, page_start, n_pieces): the orders that a store of pieces knows, with the metadata of their first piece."""
    first = F.min_by(F.struct("content_type", "page_start"), F.struct("chunk_index", "faiss_id"))
    return chunks.groupBy(F.col("gr_id").alias("doc_id")).agg(first.alias("m"), F.count(F.lit(1)).alias("n_pieces")).where("doc_id is not null").select("doc_id", "m.content_type", "m.page_start", "n_pieces")


def hay(*names: Column) -> Column:
    """All names of an order in one text, in which an expected name is looked for."""
    return F.concat_ws(" ", *names)


def doc_key(*names: Column) -> Column:
    """The first name that is not empty."""
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names])


def table_info(df: DataFrame) -> DataFrame:
    """(cid, name, type): the columns of a table."""
    return df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "cid int, name string, type string")


def merged(core: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """``core`` with the columns of ``extra`` it lacks; where both have one, the core's stands, null or not."""
    more = [c for c in extra.columns if c != key and c not in core.columns]
    return core.join(extra.select(key, *more), key, "left")
