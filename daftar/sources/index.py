"""Stored indexes: postings for term search, and vectors with their metadata.

Both are parquet folders that are appended to and deleted from without touching
what stays.  Rows taken out are remembered in a small table until ``compact``
writes the rest anew.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.functions.text import tokenize
from daftar.operators.citations import BROADCAST_ROWS
from daftar.operators.search import BLOCK, best, read_files
from daftar.session import Scratch, exists

BUCKETS = 64  # folders of postings by hash of the term: a search reads only those of its terms
STRETCH = 1 << 18  # postings of whole rows scored together
TASK = 1 << 21  # postings a task scores; each task shuffles its best k per query, so tasks are few and large
HELD = 64  # files of queries whose best rows a task keeps to its end
_TOKEN = re.compile("[a-z0-9ऀ-ॿ]+")  # as ``tokenize``, of texts in lower case
_POSTING = "row_id bigint, length int, term string, tf int"


def _posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Postings of each text, and one of the empty term, which says that the row is there."""
    for b in batches:
        for lo in range(0, len(b), 1024):
            part = b.iloc[lo : lo + 1024]
            found = [_TOKEN.findall(t) for t in part["t"]]
            counts = [Counter(x) for x in found]
            per_row = [len(c) + 1 for c in counts]
            yield pd.DataFrame({
                "row_id": np.repeat(part["row_id"].to_numpy(), per_row), "length": np.repeat(np.array([len(x) for x in found], np.int32), per_row),
                "term": [t for c in counts for t in ("", *c)], "tf": np.array([n for c in counts for n in (0, *c.values())], np.int32),
            })


def _whole_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Postings sorted by row, about ``STRETCH`` at a time; the postings of a row stay together."""
    held: list[pd.DataFrame] = []
    n = 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= STRETCH:
            p = pd.concat(held, ignore_index=True)
            cut = int(np.searchsorted(p["row_id"].to_numpy(), p["row_id"].iloc[-1]))
            if cut:
                yield p.iloc[:cut]
            held, n = [p.iloc[cut:]], len(p) - cut
    if n:
        yield pd.concat(held, ignore_index=True)


class _Stretch:
    """Rows with what each asked term adds to their score."""

    def __init__(self, p: pd.DataFrame):
        self.ids, row = np.unique(p["row_id"].to_numpy(), return_inverse=True)
        p = pd.DataFrame({"term_id": p["term_id"].to_numpy(), "row": row, "part": p["part"].to_numpy()}).groupby(["term_id", "row"], as_index=False)["part"].sum()
        terms, start = np.unique(p["term_id"].to_numpy(), return_index=True)
        rows, parts = p["row"].to_numpy(), p["part"].to_numpy()
        self.of: dict[int, tuple[np.ndarray | None, np.ndarray]] = {}
        for t, lo, hi in zip(terms.tolist(), start, np.append(start[1:], len(p))):
            if (hi - lo) * 4 > len(self.ids):  # a frequent term has a place for every row
                whole = np.zeros(len(self.ids))
                whole[rows[lo:hi]] = parts[lo:hi]
                self.of[t] = None, whole
            else:
                self.of[t] = rows[lo:hi], parts[lo:hi]

    def best(self, terms: list[int], weights: list[float], k: int, digits: int, rounded: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k rows, ties by smaller id; ``rounded``: a score must not round to nothing."""
        s = np.zeros(len(self.ids))
        for t, w in zip(terms, weights):
            if t in self.of:
                rows, parts = self.of[t]
                if rows is None:
                    s += w * parts
                else:
                    s[rows] += w * parts
        if len(s) > k:
            # What lies further below the k-th than rounding reaches cannot be among the best.
            edge = max(np.partition(s, len(s) - k)[len(s) - k] - 1.1 * 10.0**-digits, 0.0)
            near = np.flatnonzero((s >= edge) & (s > 0))
        else:
            near = np.flatnonzero(s > 0)
        score = np.round(s[near], digits)
        if rounded:
            near, score = near[score > 0], score[score > 0]
        order = np.lexsort((near, -score))[:k]
        return self.ids[near[order]], score[order]


def _best_of_task(stretches: Iterator[pd.DataFrame], uri: str, k: int, digits: int, rounded: bool) -> Iterator[pd.DataFrame]:
    """(bag_id, row_id, score): the best k of all stretches of a task for each bag of the first ``HELD`` files, the best k of each stretch for the others."""
    held: dict[int, pd.DataFrame] = {}
    for p in stretches:
        rows = _Stretch(p)
        for i, t in enumerate(read_files(uri)):
            hits = [rows.best(x, w, k, digits, rounded) for x, w in zip(t["terms"].to_pylist(), t["weights"].to_pylist())]
            found = pd.DataFrame({"bag_id": np.repeat(t["bag_id"].to_numpy(), [len(x) for x, _ in hits]), "row_id": np.concatenate([x for x, _ in hits]), "score": np.concatenate([x for _, x in hits])})
            if i >= HELD:
                yield found
            elif i in held:
                both = pd.concat([held[i], found], ignore_index=True)
                both = both.iloc[np.lexsort((both["row_id"], -both["score"], both["bag_id"]))]
                held[i] = both[both.groupby("bag_id").cumcount() < k]
            else:
                held[i] = found
    yield from held.values()


class PostingIndex:
    """Term postings of a table of texts: (term, row_id, tf, length), one folder per hash bucket of the term.

    Every row has a posting of the empty term, which no text contains, in a
    folder of its own: the table of all rows.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, rows: DataFrame) -> None:
        """Index ``rows`` (row_id, text); texts are read once and not moved. Null texts and ids are not indexed."""
        t = rows.where("row_id is not null and text is not null").select(F.col("row_id").cast("bigint").alias("row_id"), F.lower("text").alias("t"))
        self._write(t.mapInPandas(_posted, _POSTING).withColumn("bucket", self._bucket(F.col("term"))), "append", self.root)

    @staticmethod
    def _write(postings: DataFrame, mode: str, root: str) -> None:
        # Sorted, equal terms stand together and take hardly any room, and zstd finds the like beginnings of neighbouring ids.
        postings.sortWithinPartitions("bucket", "term", "row_id").write.mode(mode).option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/postings")

    def delete(self, rows: DataFrame) -> None:
        """Take rows (row_id) out; their postings stay unread until ``compact``."""
        rows.select(F.col("row_id").cast("bigint").alias("row_id")).distinct().write.mode("append").parquet(f"{self.root}/gone")

    @staticmethod
    def _bucket(term):
        return F.when(term == "", -1).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int"))

    def _read(self) -> DataFrame:
        path, gone = f"{self.root}/postings", f"{self.root}/gone"
        schema = _POSTING + ", bucket int"
        stored = self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)
        if not exists(self.spark, gone):
            return stored
        out = self.spark.read.parquet(gone).distinct()
        return stored.join(F.broadcast(out) if out.count() <= BROADCAST_ROWS else out, "row_id", "left_anti")

    def rows(self) -> DataFrame:
        return self._read().where("bucket = -1").select("row_id", "length")

    def postings(self) -> DataFrame:
        return self._read().where("bucket >= 0")

    def compact(self, to: str) -> PostingIndex:
        """The index without what was taken out, written to another folder."""
        self._write(self._read(), "overwrite", to)
        return PostingIndex(self.spark, to)

    def search(self, queries: DataFrame, k: int, form: str = "fts", digits: int = 6) -> DataFrame:
        """(query_id, row_id, score, rank) by BM25, as ``search.bm25_topk``, from the postings of the asked terms only.

        Queries are a table of any size, and those of equal terms are scored
        once.  The postings of asked terms are brought together by row, once
        whatever the number of queries; a task scores stretches of whole rows
        against files of queries in the shared folder, and only the best k per
        query of all its stretches are shuffled.  What passes the driver are
        three numbers of the corpus and the buckets; asked terms go to all tasks up to
        ``BROADCAST_ROWS``, and are joined by shuffle beyond it.
        """
        work = Scratch(self.spark, "asked")
        few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
        n_rows, mean = self.rows().agg(F.count(F.lit(1)), F.avg("length")).first()
        asked = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))
        asked = work.write(asked, "queries")
        terms = work.write(asked.select("term").distinct().withColumn("bucket", self._bucket(F.col("term"))), "terms")
        stored = self.postings()
        mine = stored.where(F.col("bucket").isin([r[0] for r in terms.select("bucket").distinct().collect()])).join(few(terms.select("term")), "term", "left_semi")
        plain = F.log(F.lit(float(n_rows)) - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)
        if form == "fts":
            df, floor = mine.groupBy("term").agg(F.count(F.lit(1)).alias("n")), 1e-6
        else:
            every = work.write(stored.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "every")
            df, floor = every.join(few(terms.select("term")), "term", "left_semi"), 0.25 * (every.agg(F.avg(plain)).first()[0] or 0.0)
        k1, b = (1.2, 0.75) if form == "fts" else (1.5, 0.75)
        idf = F.when(plain > 0 if form == "fts" else plain >= 0, plain).otherwise(floor)
        idf = work.write(df.select("term", idf.alias("idf"), F.monotonically_increasing_id().alias("term_id"), "n"), "idf")

        weighted = asked.join(idf, "term").select("query_id", "qn", "term_id", "idf").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term_id", (F.col("qn") * F.col("idf")).alias("weight")))).alias("bag"))
        weighted = work.write(weighted, "weighted")
        bags = work.write(weighted.groupBy("bag").agg(F.count(F.lit(1)).alias("n")).select("bag", F.monotonically_increasing_id().alias("bag_id")), "bags")
        bags.select("bag_id", F.col("bag.term_id").alias("terms"), F.col("bag.weight").alias("weights")).write.option("maxRecordsPerFile", BLOCK).parquet(work.path("blocks"))
        uri = work.path("blocks")

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in _whole_rows(batches):
                tf, length = p["tf"].to_numpy(np.float64), p["length"].to_numpy(np.float64)
                yield p.assign(part=tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / (mean or 1))))

        n_tasks = self.spark.sparkContext.defaultParallelism
        n_tasks *= max(1, math.ceil((idf.agg(F.sum("n")).first()[0] or 0) / (TASK * n_tasks)))
        together = mine.join(few(idf.select("term", "term_id")), "term").select("row_id", "term_id", "tf", "length").repartition(n_tasks, "row_id").sortWithinPartitions("row_id")
        found = best(together.mapInPandas(lambda batches: _best_of_task(score(batches), uri, k, digits, form != "fts"), "bag_id bigint, row_id bigint, score double"), ["bag_id"], [F.desc("score"), "row_id"], k)
        return weighted.join(bags, "bag").select("query_id", "bag_id").join(found, "bag_id").select("query_id", "row_id", "score", "rank")


class VectorStore:
    """Vectors of one length with their metadata, appended and read back."""

    def __init__(self, spark: SparkSession, root: str, size: int):
        self.spark, self.root, self.size = spark, root.rstrip("/"), size

    def add(self, rows: DataFrame) -> None:
        """Append rows (row_id, vec and metadata); a vector of another length fails the write, nothing is dropped in silence."""
        n = F.size("vec")
        sound = F.when(n == self.size, F.col("vec")).otherwise(F.raise_error(F.concat(F.lit(f"a vector of this store has {self.size} numbers, not "), n.cast("string"))))
        rows.withColumn("vec", sound).write.mode("append").parquet(f"{self.root}/vectors")

    def load(self) -> DataFrame:
        """All rows; none if nothing was saved yet."""
        path = f"{self.root}/vectors"
        return self.spark.read.parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], "row_id bigint, vec array<double>")

    def check(self) -> None:
        """Raise if ids repeat, or vectors and metadata are not as many."""
        n, ids = self.load().agg(F.count(F.lit(1)), F.countDistinct("row_id")).first()
        if n != ids:
            raise ValueError(f"{n} vectors but {ids} ids: the store was cut off between two writes")
