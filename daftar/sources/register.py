"""Reading texts of orders from folders and keeping the register's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from daftar.functions.metadata import extract
from daftar.functions.text import date_from_id
from daftar.operators import chunking
from daftar.operators.citations import latest


def order_files(spark: SparkSession, root: str, suffix: str = ".mr.txt") -> DataFrame:
    """(doc_id, department, source_file, text) of ``root/<department>/<id><suffix>``, one row per file.

    The id is the file's name up to its first dot, the department its folder
    with blanks for underscores.  Bytes that are no UTF-8 become replacement
    characters.
    """
    files = spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).text(root, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    name, folder = F.element_at(parts, -1), F.url_decode(F.element_at(parts, -2))
    return files.select(
        F.element_at(F.split(name, r"\."), 1).alias("doc_id"), F.replace(folder, F.lit("_"), F.lit(" ")).alias("department"),
        F.concat_ws("/", folder, name).alias("source_file"), F.col("value").alias("text"),
    )


def documents(files: DataFrame) -> DataFrame:
    """Rows of gr_documents from order files, one per file: header fields, the folder's department, dates and titles from the id where the header has none.

    Header and file columns come from one pass over the text, without a join, so
    two files of one id give two rows.
    """
    named = extract(files.withColumn("__folder", F.col("department")), "doc_id", "text").drop("department").withColumnRenamed("__folder", "department")
    return named.withColumn("date", F.coalesce("date", date_from_id(F.col("doc_id")))).withColumn("title", F.coalesce("title", "doc_id"))


def pieces(docs: DataFrame, first_id: int = 0) -> DataFrame:
    """Rows of gr_chunks: word windows of each text with ids from ``first_id`` on, in the order of (doc_id, chunk_index).

    Ids come from per-partition counts of range-sorted rows, so no task sees all
    of them.
    """
    w = chunking.windows(docs.select("doc_id", "text"), "text").select(F.col("doc_id").alias("gr_id"), "chunk_index", "page_start", "page_end", F.lit("text").alias("content_type"), F.col("chunk_text").alias("text"))
    ordered = w.repartitionByRange("gr_id", "chunk_index").sortWithinPartitions("gr_id", "chunk_index").withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    sizes = ordered.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    offsets = sizes.select("__p", before.alias("__before"))
    numbered = ordered.withColumn("__p", part).join(F.broadcast(offsets), "__p")
    return numbered.select((F.lit(first_id) + F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).alias("faiss_id"), *w.columns)


def upsert(new: DataFrame, stored: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The stored rows with the new ones in their place, the latest of each key by ``order``."""
    return latest(stored.unionByName(new, allowMissingColumns=True), key, order)


def as_text(docs: DataFrame) -> DataFrame:
    """(doc_id, value): each order as the text a reader downloads, header lines over its text."""
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.col(c)) for label, c in (("Number", "gr_number"), ("Date", "date"), ("Department", "department"), ("Title", "title"))])
    return docs.select("doc_id", F.concat_ws("\n\n", head, "text").alias("value"))
