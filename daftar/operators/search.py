"""Exact dense and term-based search of a query set against all rows, in blocks.

Queries are taken in blocks of bounded size.  For vectors the blocks are files in
the shared folder: a task reads its rows once, in stretches of bounded size, and
scores each stretch against one block after the other; queries never pass the
driver, and the plan is the same for any number of them.  For terms a block's
term table goes to all tasks.  Each task keeps its best k per query, and only
those are shuffled.  No row pairs are written, and a term that stands in every
row costs no more than its rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from daftar.functions.text import tokenize
from daftar.functions.vectors import dot
from daftar.session import Scratch

BLOCK = 2048  # queries scored together
_HITS = "query_id bigint, row_id bigint, score double"


def best(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row positions of the best k scores of each column, ties by smaller id; scores of -inf are no hits."""
    if len(ids) <= k:
        return np.argsort(-scores, axis=0, kind="stable")
    edge = -np.partition(-scores, k - 1, axis=0)[k - 1]
    out = np.full((k, scores.shape[1]), 0, np.int64)
    for q in range(scores.shape[1]):
        near = np.flatnonzero(scores[:, q] >= edge[q])
        out[:, q] = near[np.lexsort((ids[near], -scores[near, q]))][:k]
    return out


def _emit(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], scores[order]
    at = _top(scores, ids, k)
    q = np.broadcast_to(np.arange(len(query_ids)), at.shape)
    hit = pd.DataFrame({"query_id": query_ids[q.ravel()], "row_id": ids[at.ravel()], "score": scores[at.ravel(), q.ravel()]})
    return hit[np.isfinite(hit["score"])]


def _blocks(queries: DataFrame, columns: list[str]) -> Iterator[list]:
    block: list = []
    for r in queries.select("query_id", *columns).toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


STRETCH = 65_536  # rows scored together


def _query_files(queries: DataFrame) -> str:
    """Where the queries are written, at most ``BLOCK`` to a file."""
    work = Scratch(queries.sparkSession, "queries")
    queries.where("vec is not null").select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vec").cast("array<double>").alias("vec")).write.option("maxRecordsPerFile", BLOCK).parquet(work.path("blocks"))
    return work.path("blocks")


def read_files(uri: str) -> Iterator:
    """The Arrow table of each file of a folder that holds rows, in the order of their names."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    for f in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda x: x.path):
        if f.path.endswith(".parquet") and f.size:
            t = pq.read_table(f.path, filesystem=system)
            if t.num_rows:
                yield t


def _read_blocks(uri: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of each file of queries."""
    for t in read_files(uri):
        yield t["query_id"].to_numpy(), np.array(t["vec"].to_pylist(), np.float64)


def _stretches(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the rows of a task, in stretches of about ``STRETCH``."""
    held: list[pd.DataFrame] = []
    n = 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= STRETCH:
            yield np.concatenate([x["row_id"].to_numpy() for x in held]), np.concatenate([np.stack(x["vec"].to_numpy()) for x in held if len(x)]).astype(np.float64)
            held, n = [], 0
    if n:
        yield np.concatenate([x["row_id"].to_numpy() for x in held]), np.concatenate([np.stack(x["vec"].to_numpy()) for x in held if len(x)]).astype(np.float64)


def dense_topk(rows: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, row_id, score, rank): the ``k`` rows of greatest inner product with each query.

    ``rows`` has row_id and vec, ``queries`` query_id and vec.  Filter ``rows``
    before the call and the ranking is exact over what is left; no rows left
    means no hits.  Scores are rounded to ``digits``, ties go to the smaller id,
    rows of null or other length are left out.
    """
    spark = rows.sparkSession
    uri = _query_files(queries)
    size = spark.read.parquet(uri).agg(F.max(F.size("vec"))).first()[0]
    if size is None:
        return spark.createDataFrame([], _HITS + ", rank int")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, m in _stretches(batches, size):
            for qid, q in _read_blocks(uri):
                yield _emit(qid, ids, np.round(m @ q.T, digits), k)

    sound = rows.where(F.size("vec") == size).select("row_id", "vec")
    return best(sound.mapInPandas(score, _HITS), ["query_id"], [F.desc("score"), "row_id"], k)


def containing(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(row_id, pattern): the distinct patterns that occur in each row's text, as characters stand.

    ``rows`` has row_id and text, ``patterns`` pattern; nulls and empty patterns
    match nothing.  Blocks of patterns become one automaton each, which reads a
    text once whatever the number of patterns.
    """
    kind = rows.schema["row_id"].dataType.simpleString()
    out = None
    distinct = patterns.select("pattern").where("pattern <> ''").distinct().select(F.col("pattern").alias("query_id"))
    for block in _blocks(distinct, []):
        words = [r["query_id"] for r in block]

        def find(batches: Iterator[pd.DataFrame], words=words) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for w in words:
                automaton.add_word(w, w)
            automaton.make_automaton()
            for b in batches:
                hits = [(k, w) for k, t in zip(b["row_id"].tolist(), b["text"].tolist()) for w in {w for _, w in automaton.iter(t)}]
                yield pd.DataFrame(hits, columns=["row_id", "pattern"])

        met = rows.select("row_id", "text").where("text is not null").mapInPandas(find, f"row_id {kind}, pattern string")
        out = met if out is None else out.unionByName(met)
    return out if out is not None else rows.sparkSession.createDataFrame([], f"row_id {kind}, pattern string")


def statistics(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, n) with the rows a term stands in, and one row (n_rows, mean_length) of the non-empty rows.

    ``rows`` has row_id and text.
    """
    tokens = rows.select("row_id", tokenize(F.col("text")).alias("tokens"))
    terms = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms, tokens.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.size("tokens")).alias("mean_length"))


def bm25_topk(rows: DataFrame, queries: DataFrame, k: int, form: str = "fts", digits: int = 6) -> DataFrame:
    """(query_id, row_id, score, rank) by BM25.

    ``form`` fts: k1 1.2, b 0.75, an idf of at least 1e-6.  okapi: k1 1.5, b
    0.75, a negative idf replaced by a quarter of the mean idf of all terms, and
    no hits at or below 0.  A term that a query repeats counts as often.  A
    query without tokens has no hits.
    """
    terms, size = statistics(rows)
    n_rows, mean_length = size.first()
    if not n_rows or not mean_length:
        return rows.sparkSession.createDataFrame([], _HITS + ", rank int")
    plain = F.log(F.lit(float(n_rows)) - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)
    floor = 1e-6 if form == "fts" else 0.25 * (terms.agg(F.avg(plain)).first()[0] or 0.0)
    k1, b = (1.2, 0.75) if form == "fts" else (1.5, 0.75)
    out = None
    for block in _blocks(queries.select("query_id", tokenize(F.col("text")).alias("tokens")), ["tokens"]):
        qid = np.array([r["query_id"] for r in block], np.int64)
        asked: dict[str, Counter] = defaultdict(Counter)
        for j, r in enumerate(block):
            for t in r["tokens"] or ():
                asked[t][j] += 1
        known = terms.where(F.col("term").isin(list(asked))).collect()  # at most the terms of one block
        table = {}
        for r in known:
            idf = math.log(n_rows - r["n"] + 0.5) - math.log(r["n"] + 0.5)
            idf = idf if (idf > 0 if form == "fts" else idf >= 0) else floor
            at = np.array(sorted(asked[r["term"]]), np.int64)
            table[r["term"]] = (at, idf * np.array([asked[r["term"]][j] for j in at], np.float64))

        def score(batches: Iterator[pd.DataFrame], qid=qid, table=table) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for lo in range(0, len(batch), 512):
                    part = batch.iloc[lo : lo + 512]
                    s = np.full((len(part), len(qid)), -np.inf)
                    for i, tokens in enumerate(part["tokens"]):
                        norm = k1 * (1 - b + b * len(tokens) / mean_length)
                        for t, tf in Counter(tokens).items():
                            if t in table:
                                at, weight = table[t]
                                s[i, at] = np.where(np.isneginf(s[i, at]), 0, s[i, at]) + weight * tf * (k1 + 1) / (tf + norm)
                    s = np.round(s, digits)
                    if form == "okapi":
                        s[s <= 0] = -np.inf
                    yield _emit(qid, part["row_id"].to_numpy(), s, k)

        hits = rows.select("row_id", tokenize(F.col("text")).alias("tokens")).where(F.size("tokens") > 0).mapInPandas(score, _HITS)
        found = best(hits, ["query_id"], [F.desc("score"), "row_id"], k)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.sparkSession.createDataFrame([], _HITS + ", rank int")


def scores_for(pairs: DataFrame, rows: DataFrame, queries: DataFrame, digits: int = 6) -> DataFrame:
    """``pairs`` (query_id, row_id, …) plus ``cosine``, the exact inner product of each stated pair; null where a vector is missing."""
    joined = pairs.join(rows.select("row_id", F.col("vec").alias("__a")), "row_id", "left").join(queries.select("query_id", F.col("vec").alias("__b")), "query_id", "left")
    return joined.withColumn("cosine", F.round(dot(F.col("__a"), F.col("__b")), digits)).drop("__a", "__b")


def centroids(rows: DataFrame, n_cells: int, sample: int = 20_000, seed: int = 11) -> np.ndarray:
    """Directions of ``n_cells`` cells, by spherical k-means on at most ``sample`` vectors: those whose id hashes smallest."""
    n = rows.select("row_id").count()
    cut = min(int(-(2**63) + 2**64 * min(1.0, 1.2 * sample / max(n, 1))), 2**63 - 1)
    few = rows.where((F.xxhash64("row_id") < cut) & F.col("vec").isNotNull()).select("row_id", "vec").orderBy(F.xxhash64("row_id"), "row_id").limit(sample).collect()
    if not few:
        return np.zeros((0, 0))
    size = len(few[0]["vec"])
    m = np.array([r["vec"] for r in few if len(r["vec"]) == size], np.float64)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    c = m[np.random.default_rng(seed).choice(len(m), min(n_cells, len(m)), replace=False)]
    for _ in range(15):
        own = (m @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, m)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


def cell_topk(rows: DataFrame, queries: DataFrame, k: int, n_cells: int = 16, probes: int = 12, digits: int = 6) -> DataFrame:
    """``dense_topk`` over the rows in the ``probes`` cells nearest to each query.

    An approximate search: cells are fitted on a bounded sample, every row is in
    one, and rows of the probed cells are scored exactly.  With as many probes
    as cells it is exact.
    """
    spark = rows.sparkSession
    cells = centroids(rows, n_cells)
    if not len(cells):
        return spark.createDataFrame([], _HITS + ", rank int")
    uri = _query_files(queries)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, m in _stretches(batches, cells.shape[1]):
            own = (m @ cells.T).argmax(1)
            for qid, q in _read_blocks(uri):
                near = np.argsort(-(q @ cells.T), axis=1, kind="stable")[:, :probes]
                for c in np.unique(own):
                    asks = np.flatnonzero((near == c).any(1))
                    if len(asks):
                        in_cell = own == c
                        yield _emit(qid[asks], ids[in_cell], np.round(m[in_cell] @ q[asks].T, digits), k)

    sound = rows.where(F.size("vec") == cells.shape[1]).select("row_id", "vec")
    return best(sound.mapInPandas(score, _HITS), ["query_id"], [F.desc("score"), "row_id"], k)
