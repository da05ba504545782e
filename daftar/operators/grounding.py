"""Evidence for answers: budgets, numbered blocks, prompts, citations and refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from daftar.functions.text import token_estimate


def trim(hits: DataFrame, budget: int | str, rate: float = 2.0) -> DataFrame:
    """``hits`` plus ``block_no`` and ``dropped``: the longest ranked prefix within the budget of tokens, one block at least.

    ``hits`` has query_id, rank and text; ``budget`` is a number or a column
    name.  ``dropped`` counts the blocks left out of the query.
    """
    limit = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    w = W.partitionBy("query_id")
    cost = token_estimate(F.col("text"), rate)
    h = hits.withColumn("block_no", F.row_number().over(w.orderBy("rank"))).withColumn("spent", F.sum(cost).over(w.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    h = h.withColumn("kept", (F.col("block_no") == 1) | (F.col("spent") <= limit))
    return h.withColumn("dropped", F.sum((~F.col("kept")).cast("int")).over(w)).where("kept").drop("kept")


def history(turns: DataFrame, window: int = 4, budget: int = 800, rate: float = 2.0) -> DataFrame:
    """The latest turns of each conversation: at most ``window``, then the oldest go while all exceed ``budget``; all may go.

    ``turns`` has conversation_id, turn_no and content.
    """
    w = W.partitionBy("conversation_id").orderBy(F.desc("turn_no"))
    t = turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= window)
    t = t.withColumn("tokens", token_estimate(F.col("content"), rate)).withColumn("spent", F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return t.where(F.col("spent") <= budget)


def block(n: Column, title: Column, number: Column, date: Column, first: Column, last: Column, kind: Column, text: Column) -> Column:
    """A numbered block: ``[n] (title — number — date, pages, kind)`` over its text; parts that are empty are left out."""
    pages = F.when(first == F.coalesce(last, first), F.concat(F.lit("page "), first.cast("string"))).otherwise(F.concat(F.lit("pages "), first.cast("string"), F.lit("-"), last.cast("string")))
    name = F.concat_ws(" — ", *[F.nullif(c, F.lit("")) for c in (title, number, date)])
    return F.concat(F.lit("["), n.cast("string"), F.lit("] ("), F.concat_ws(", ", F.nullif(name, F.lit("")), pages, kind), F.lit(")\n"), text)


def numbers_cited(answer: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))))


def cited(answer: Column, n_blocks: Column) -> tuple[Column, Column]:
    """(valid, phantom): distinct block numbers an answer cites, in order; phantom ones name no block."""
    found = numbers_cited(answer)
    return F.filter(found, lambda x: (x >= 1) & (x <= n_blocks)), F.filter(found, lambda x: (x < 1) | (x > n_blocks))


def numbered_sources(raw: Column) -> Column:
    """Sources stored as JSON text, as (n, gr_number) structs; text that is no such list, and entries without a number, give none."""
    shape = "array<struct<n:int,gr_number:string>>"
    return F.coalesce(F.filter(F.from_json(raw, shape), lambda s: s["n"].isNotNull()), F.array().cast(shape))


def cited_sources(answer: Column, sources: Column) -> tuple[Column, Column]:
    """(valid, phantom): as ``cited``, the blocks being the answer's own ``numbered_sources``."""
    numbers = F.transform(sources, lambda s: s["n"])
    found = numbers_cited(answer)
    return F.filter(found, lambda x: F.array_contains(numbers, x)), F.filter(found, lambda x: ~F.array_contains(numbers, x))


def prose(answer: Column) -> Column:
    return F.trim(F.regexp_replace(answer, r"\[\d+\]", ""))


def abstains(top_score: Column, floor: float = 0.10) -> Column:
    """Whether to refuse: the best score is under the floor, or there is none; a floor of 0 never refuses."""
    return F.lit(False) if floor <= 0 else F.coalesce(top_score, F.lit(0.0)) < floor


def refusal_language(asked: Column, question: Column) -> Column:
    """The language asked for, else mr if the question has Devanagari, else en."""
    return F.coalesce(F.nullif(asked, F.lit("auto")), F.when(question.rlike(r"[ऀ-ॿ]"), "mr").otherwise("en"))


def prompts(blocks: DataFrame, questions: DataFrame, system: str, reminder: str) -> DataFrame:
    """(query_id, messages): system text, and the blocks with question and reminder.

    ``blocks`` has query_id, block_no and block; ``questions`` query_id and
    text.  A question without blocks gets an empty context.
    """
    context = blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "block"))), lambda x: x["block"]), "\n\n").alias("context"))
    user = F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), "text", F.lit("\n" + reminder))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return questions.join(context, "query_id", "left").select("query_id", F.array(message("system", F.lit(system)), message("user", user)).alias("messages"))


def first_sentences(blocks: DataFrame) -> DataFrame:
    """(query_id, answer): the default answerer, the first sentence of every block with its number."""
    said = F.concat(F.regexp_extract("text", r"(?s)^\s*(.*?[.?!।](?=\s|$)|.*)", 1), F.lit(" ["), F.col("block_no").cast("string"), F.lit("]"))
    g = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("block_no", said.alias("s")))).alias("a"))
    return g.select("query_id", F.array_join(F.transform("a", lambda x: x["s"]), " ").alias("answer"))


def over_context(prompts: DataFrame, context: int, reply: int, rate: float = 1.2) -> DataFrame:
    """(query_id, tokens, over): estimated size of each prompt, and whether it leaves no room for the reply."""
    size = F.aggregate(F.transform("messages", lambda m: token_estimate(m["content"], rate)), F.lit(0), lambda a, x: a + x)
    return prompts.select("query_id", size.alias("tokens")).withColumn("over", F.col("tokens") > context - reply)
