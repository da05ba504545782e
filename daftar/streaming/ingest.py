"""Order files taken in as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from daftar.functions.text import date_from_id
from daftar.session import exists
from daftar.sources.register import documents


def watch(spark: SparkSession, root: str, suffix: str = ".mr.txt", max_files: int = 10_000) -> DataFrame:
    """A stream of (doc_id, department, source_file, text) of the files under ``root``, at most ``max_files`` a batch."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(root)
    parts = F.split(F.col("_metadata.file_path"), "/")
    name, folder = F.element_at(parts, -1), F.url_decode(F.element_at(parts, -2))
    return files.select(
        F.element_at(F.split(name, r"\."), 1).alias("doc_id"), F.replace(folder, F.lit("_"), F.lit(" ")).alias("department"),
        F.concat_ws("/", folder, name).alias("source_file"), F.col("value").alias("text"),
    )


def ingest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's orders that ``table`` (a folder of Parquet) does not hold yet; ends when all files are in.

    A batch that is run again after a failure finds its own orders stored and
    leaves them out, so every order is stored once.
    """

    def store(batch: DataFrame, number: int) -> None:
        rows = documents(batch.dropDuplicates(["doc_id"])).withColumn("day", date_from_id(F.col("doc_id")))
        if exists(batch.sparkSession, table):
            rows = rows.join(batch.sparkSession.read.parquet(table).select("doc_id"), "doc_id", "left_anti")
        rows.write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
