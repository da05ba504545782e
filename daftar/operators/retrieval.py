"""Retrieval from the register: candidates of two kinds, fused, capped, scored, gated.

Embedder and scorer are arguments.  An embedder turns (query_id, text) into
(query_id, vec); a scorer turns pairs (query_id, row_id) into pairs with
``score``.  Without a scorer the cosine decides, made up for hits that only the
term search found.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.operators import fusion, search

Embedder = Callable[[DataFrame], DataFrame]
Scorer = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Limits:
    """Sizes and thresholds of a retrieval."""

    dense: int = 60
    sparse: int = 20
    overfetch: int = 4
    pool: int = 120
    per_document: int = 2
    rerank: int = 40
    keep: int = 12
    floor: int = 2
    score: float = 0.5  # of a scorer
    text: float = 0.55  # cosine of a text
    table: float = 0.50  # cosine of a table


def _gated(hits: DataFrame, questions: DataFrame, limits: Limits, scored: bool) -> DataFrame:
    least = F.lit(limits.score) if scored else F.when(F.col("content_type") == "table", limits.table).otherwise(limits.text)
    return fusion.gate(hits, questions, F.col("score") >= least, limits.keep, limits.floor)


def _scores(pool: DataFrame, rows: DataFrame, vectors: DataFrame, asked: DataFrame, questions: DataFrame, scorer: Scorer | None) -> DataFrame:
    if scorer is not None:
        return scorer(pool, rows, questions)
    return search.scores_for(pool, vectors, asked).withColumnRenamed("cosine", "score")


def retrieve(questions: DataFrame, rows: DataFrame, vectors: DataFrame, embed: Embedder, scorer: Scorer | None = None, allowed: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """(query_id, row_id, score, rank, low_confidence): the evidence of each question.

    ``rows`` has row_id, doc_id, content_type and text, ``vectors`` row_id and
    vec.  ``allowed`` (doc_id) is the outcome of a filter: none means no filter,
    an empty one that every question abstains, as one row of nulls.  The dense
    search runs on allowed rows only; the term search fetches ``overfetch``
    times as much and filters after it.
    """
    asked = embed(questions)
    wide = limits.sparse * (1 if allowed is None else limits.overfetch)
    sparse = search.bm25_topk(rows, questions, wide)
    if allowed is not None:
        mine = rows.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi").select("row_id")
        vectors = vectors.join(mine, "row_id", "left_semi")
        kept = sparse.drop("rank").join(mine, "row_id", "left_semi")
        sparse = search.best(kept, ["query_id"], [F.desc("score"), "row_id"], limits.sparse)
    dense = search.dense_topk(vectors, asked, limits.dense)
    pool = fusion.reciprocal_rank(dense, sparse).where(F.col("fused_rank") <= limits.pool).join(rows.select("row_id", "doc_id", "content_type"), "row_id")
    pool = search.best(fusion.cap_per_document(pool, limits.per_document), ["query_id"], ["fused_rank"], limits.rerank if scorer else limits.pool, "place")
    scored = _scores(pool.select("query_id", "row_id", "content_type"), rows, vectors, asked, questions, scorer)
    return _gated(scored, questions, limits, scorer is not None)


def retrieve_flat(questions: DataFrame, rows: DataFrame, vectors: DataFrame, embed: Embedder, scorer: Scorer | None = None, limits: Limits = Limits(), texts: int = 20, tables: int = 10) -> DataFrame:
    """As ``retrieve`` over one small store: texts and tables searched apart, terms by Okapi, no cap per document and no filter."""
    asked = embed(questions)
    kinds = vectors.join(rows.select("row_id", "content_type"), "row_id")
    both = search.dense_topk(kinds.where("content_type = 'text'"), asked, texts).unionByName(search.dense_topk(kinds.where("content_type = 'table'"), asked, tables))
    dense = search.best(both.drop("rank"), ["query_id"], [F.desc("score"), "row_id"], texts + tables)
    pool = fusion.reciprocal_rank(dense, search.bm25_topk(rows, questions, limits.sparse, "okapi")).join(rows.select("row_id", "content_type"), "row_id")
    scored = _scores(pool.select("query_id", "row_id", "content_type"), rows, vectors, asked, questions, scorer)
    return _gated(scored, questions, limits, scorer is not None)


def lexical_scorer(statistics: tuple[DataFrame, DataFrame]) -> Scorer:
    """The default scorer: the idf-weighted share of the question's terms that a row has. Takes ``search.statistics`` of the rows."""
    terms, size = statistics

    def score(pairs: DataFrame, rows: DataFrame, questions: DataFrame) -> DataFrame:
        return fusion.lexical_scores(pairs, rows, questions, terms, size.first()["n_rows"]).withColumnRenamed("rerank", "score")

    return score


def related(vectors: DataFrame, probes: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` documents nearest to each probe, other than its own.

    ``probes`` has query_id, own (a document id or null) and vec; ``k`` x 6
    pieces are looked at, a document scores as its best piece.
    """
    hits = search.dense_topk(vectors, probes.select("query_id", "vec"), 6 * k).join(rows.select("row_id", "doc_id"), "row_id")
    other = hits.join(probes.select("query_id", "own"), "query_id", "left").where("own is null or doc_id <> own").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return search.best(other, ["query_id"], [F.desc("score"), "doc_id"], k).select("query_id", "doc_id", F.round("score", 3).alias("score"), "rank")


BACKENDS: dict[str, Callable[..., DataFrame]] = {"corpus": retrieve, "flat": retrieve_flat}


def retriever(backend: str) -> Callable[..., DataFrame]:
    """The retrieval of a named store."""
    if backend not in BACKENDS:
        raise ValueError(f"no such store: {backend}; one of {', '.join(BACKENDS)}")
    return BACKENDS[backend]
