"""Checks that the stored tables agree with each other, and repairs of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.functions.vectors import dot


def id_space(df: DataFrame, key: str) -> DataFrame:
    """(n_rows, n_ids, first_id, last_id, dense): whether the ids are 0 .. n-1, each once."""
    a = df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_ids"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
    return a.withColumn("dense", F.coalesce((F.col("n_rows") == F.col("n_ids")) & (F.col("first_id") == 0) & (F.col("last_id") == F.col("n_rows") - 1), F.lit(True)))


def orphans(children: DataFrame, parents: DataFrame, on: str, key: str) -> DataFrame:
    """Rows of ``children`` whose ``on`` names no ``key`` of ``parents``; a null names none."""
    return children.join(parents.select(F.col(key).alias(on)).distinct(), on, "left_anti")


def missing(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` not stored yet: what a resumed run has still to do."""
    return new.join(stored.select(key).distinct(), key, "left_anti")


def cut_back(chunks: DataFrame, docs: DataFrame, first_bad: int) -> tuple[DataFrame, DataFrame]:
    """(chunks, docs) without pieces from ``first_bad`` on, and without orders left with no piece: the state of the last whole checkpoint."""
    kept = chunks.where(F.col("faiss_id") < first_bad)
    return kept, docs.join(kept.select(F.col("gr_id").alias("doc_id")).distinct(), "doc_id", "left_semi")


def rebuilt(df: DataFrame, path: str) -> DataFrame:
    """``df`` written over whatever stands at ``path``, and read again: the same rows however often it runs."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alignment(stored: DataFrame, made: DataFrame, digits: int = 4) -> DataFrame:
    """(n, worst): the least inner product of a stored vector with the one made anew for its id; both have row_id and vec."""
    both = stored.select("row_id", F.col("vec").alias("__a")).join(made.select("row_id", F.col("vec").alias("__b")), "row_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.min(dot(F.col("__a"), F.col("__b"))), digits).alias("worst"))
