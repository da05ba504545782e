"""Fusion of rankings, caps per document, score gates and floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from daftar.functions.text import tokenize
from daftar.operators.search import best


def reciprocal_rank(dense: DataFrame, sparse: DataFrame, k: int = 60, digits: int = 9) -> DataFrame:
    """(query_id, row_id, fused, dense_rank, sparse_rank, fused_rank) of two ranked lists.

    Each list gives 1 / (k + rank); ties keep the order of the dense list, then
    of the sparse one.
    """
    a = dense.select("query_id", "row_id", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("sparse_rank"))
    b = sparse.select("query_id", "row_id", F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("sparse_rank"))
    both = a.unionByName(b).groupBy("query_id", "row_id").agg(F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    both = both.withColumn("fused", F.round(part("dense_rank") + part("sparse_rank"), digits))
    order = [F.desc("fused"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.asc("row_id")]
    return both.withColumn("fused_rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def cap_per_document(hits: DataFrame, cap: int = 2, by: str = "fused_rank") -> DataFrame:
    """The first ``cap`` hits of each document and query; hits without a document have been dropped by the join before."""
    return best(hits, ["query_id", "doc_id"], [by], cap, "doc_rank").drop("doc_rank")


def gate(hits: DataFrame, queries: DataFrame, passes: Column, keep: int = 12, floor: int = 2) -> DataFrame:
    """Hits that pass, at most ``keep``; a query where none passes keeps its first ``floor`` with ``low_confidence``.

    ``hits`` has query_id, row_id, score.  A query without any hit comes out as
    one row of nulls with ``low_confidence``: it abstains.
    """
    w = W.partitionBy("query_id")
    order = [F.desc("score"), F.asc("row_id")]
    h = hits.withColumn("passes", F.coalesce(passes, F.lit(False))).withColumn("any", F.max(F.col("passes").cast("int")).over(w) == 1)
    kept = h.where("passes or not any").withColumn("rank", F.row_number().over(w.orderBy(*order)))
    kept = kept.where((F.col("any") & (F.col("rank") <= keep)) | (~F.col("any") & (F.col("rank") <= floor)))
    kept = kept.select("query_id", "row_id", "score", "rank", (~F.col("any")).alias("low_confidence"))
    return queries.select("query_id").distinct().join(kept, "query_id", "left").withColumn("low_confidence", F.coalesce("low_confidence", F.lit(True)))


def lexical_scores(pairs: DataFrame, rows: DataFrame, queries: DataFrame, terms: DataFrame, n_rows: int, digits: int = 6) -> DataFrame:
    """``pairs`` plus ``rerank``: the idf-weighted share of the query's distinct terms that the row has, 0 to 1.

    The default scorer; any other that gives a score per (query, row) pair can
    take its place.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).join(terms, "term", "left")
    q = q.withColumn("w", F.log(1 + F.lit(float(n_rows)) / (1 + F.coalesce("n", F.lit(0)))))
    total = q.groupBy("query_id").agg(F.sum("w").alias("total"))
    r = pairs.select("query_id", "row_id").join(rows.select("row_id", F.array_distinct(tokenize(F.col("text"))).alias("has")), "row_id")
    met = r.join(q, "query_id").where(F.array_contains("has", F.col("term"))).groupBy("query_id", "row_id").agg(F.sum("w").alias("met"))
    return pairs.join(met, ["query_id", "row_id"], "left").join(total, "query_id", "left").withColumn(
        "rerank", F.round(F.coalesce(F.col("met") / F.col("total"), F.lit(0.0)), digits)
    ).drop("met", "total")


def merge_extra(hits: DataFrame, extra: DataFrame) -> DataFrame:
    """Hits of two collections in one ranking by score; queries with extra hits are no longer of low confidence.

    Both have query_id, row_id, score, low_confidence.
    """
    both = hits.select("query_id", "row_id", "score", "low_confidence", F.lit(0).alias("extra")).unionByName(extra.select("query_id", "row_id", "score", "low_confidence", F.lit(1).alias("extra")))
    w = W.partitionBy("query_id")
    both = both.withColumn("low_confidence", F.col("low_confidence") & (F.max("extra").over(w) == 0))
    return both.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "extra", "row_id")))
