"""Quality of rankings and answers against known cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.operators.grounding import prose

# The wordings of a refusal, by intent.
NOT_THERE = ("found", "available", "contained", "mentioned", "covered")
DOES_NOT = ("cover", "contain", "provide", "include", "mention", "have")
NONE_OF = ("information", "relevant")
UNABLE = ("cannot", "could not", "unable to")
NOT_IN_MARATHI = ("माहिती नाही", "माहिती उपलब्ध नाही", "उपलब्ध नाही", "समाविष्ट नाही", "नमूद नाही", "आढळत नाही", "आढळली नाही", "आढळले नाही", "आढळला नाही", "सापडली नाही")
REFUSAL = (
    f"(?i)not (?:{'|'.join(NOT_THERE)})|no (?:{'|'.join(NONE_OF)})|(?:{'|'.join(UNABLE)}) (?:answer|find)|nothing (?:about|on)"
    f"|(?:does|do) not (?:appear to |seem to )?(?:{'|'.join(DOES_NOT)})|{'|'.join(NOT_IN_MARATHI)}"
)


def ranking_quality(hits: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """(n_queries, hit1, hit5, mrr). ``hits`` has query_id, doc_id, rank; ``relevant`` query_id, doc_id; a miss counts 0."""
    first = hits.join(relevant.distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("top"))
    q = queries.select("query_id").distinct().join(first, "query_id", "left")
    return q.agg(
        F.count(F.lit(1)).alias("n_queries"), F.count(F.when(F.col("top") == 1, 1)).alias("hit1"), F.count(F.when(F.col("top") <= 5, 1)).alias("hit5"),
        F.round(F.avg(F.coalesce(1 / F.col("top"), F.lit(0.0))), 9).alias("mrr"),
    )


def separation(scored: DataFrame) -> DataFrame:
    """(kind, n, p10, p50, p90) of the scores of relevant and other top hits. ``scored`` has kind and score."""
    p = F.percentile("score", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return scored.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), p.alias("p")).select("kind", "n", *[F.round(F.get("p", F.lit(i)), 6).alias(a) for i, a in enumerate(("p10", "p50", "p90"))])


def threshold(scored: DataFrame) -> DataFrame:
    """(threshold, gap): between the lower quartile of ``keep`` and the upper quartile of ``reject``; a negative gap is an overlap."""
    q = lambda kind, at: F.percentile(F.when(F.col("kind") == kind, F.col("score")), F.lit(at))
    s = scored.agg(q("keep", 0.25).alias("lo"), q("reject", 0.75).alias("hi"))
    return s.select(F.round((F.col("lo") + F.col("hi")) / 2, 4).alias("threshold"), F.round(F.col("lo") - F.col("hi"), 4).alias("gap"))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(n_queries, recall): the mean share of the true first ``k`` that was found. Both have query_id, row_id, rank."""
    t = truth.where(F.col("rank") <= k).select("query_id", "row_id")
    hit = t.join(found.where(F.col("rank") <= k).select("query_id", "row_id", F.lit(1).alias("hit")), ["query_id", "row_id"], "left")
    per = hit.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("r"))
    return per.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("r"), 6).alias("recall"))


def answer_flags(log: DataFrame) -> DataFrame:
    """``log`` plus cited, grounded, degenerate, refused and ``labels``.

    ``log`` has answer, sources (numbers cited that exist), phantom, correct and
    in_corpus.  A phantom citation is always named; of the others the first of
    DEGENERATE, WRONG-SOURCE, UNCITED; outside the corpus NO-ABSTAIN.
    """
    df = log.withColumn("cited", F.size("sources") > 0).withColumn("grounded", F.size("phantom") == 0)
    df = df.withColumn("degenerate", F.length(prose(F.col("answer"))) < 15).withColumn("refused", F.col("answer").rlike(REFUSAL))
    main = F.when(F.col("degenerate"), "DEGENERATE").when(~F.col("correct"), "WRONG-SOURCE").when(~F.col("cited"), "UNCITED")
    inside = F.array(F.when(~F.col("grounded"), "PHANTOM"), main)
    labels = F.when(F.col("in_corpus"), inside).otherwise(F.array(F.when(~F.col("refused"), "NO-ABSTAIN")))
    return df.withColumn("labels", F.filter(labels, lambda x: x.isNotNull()))


def first_match(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, top): the first rank whose names contain one of the expected ones; null for a miss.

    ``hits`` has query_id, rank and hay, ``expected`` query_id and name; an empty
    name matches nothing.
    """
    names = expected.where("name <> ''").groupBy("query_id").agg(F.collect_set("name").alias("names"))
    met = hits.join(names, "query_id").where(F.exists("names", lambda e: F.col("hay").contains(e))).groupBy("query_id").agg(F.min("rank").alias("top"))
    return expected.select("query_id").distinct().join(met, "query_id", "left")


def latencies(log: DataFrame, stage: str, seconds: str, slow: float = 10.0) -> DataFrame:
    """(stage, n, p50, longest, n_slow) of a log of timed steps."""
    return log.where(F.col(seconds).isNotNull()).groupBy(stage).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.percentile(seconds, F.lit(0.5)), 3).alias("p50"), F.round(F.max(seconds), 3).alias("longest"), F.count(F.when(F.col(seconds) > slow, 1)).alias("n_slow")
    )


def verified(tops: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, passed): known questions against what retrieval gave.

    ``tops`` has query_id, hay, text and low_confidence of the best hit;
    ``expected`` query_id, name, number (what the text must contain, or null)
    and outside.  A question outside the corpus passes if nothing was confident.
    """
    j = expected.join(tops, "query_id", "left")
    inside = F.col("hay").contains(F.col("name")) & (F.col("number").isNull() | F.col("text").contains(F.col("number")))
    return j.select("query_id", F.when(F.col("outside"), F.coalesce("low_confidence", F.lit(True))).otherwise(F.coalesce(inside, F.lit(False))).alias("passed"))
