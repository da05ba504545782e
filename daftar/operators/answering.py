"""Questions to answers: budgets, prompts, generation, citations, and what stands around them.

A generator is an argument: it turns (query_id, messages) and the blocks into
(query_id, answer).  The default one quotes the first sentence of every block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.functions.text import token_estimate
from daftar.operators import grounding

Generator = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class GenerationConfig:
    """Budgets of a model: context and reply in tokens, tokens per Devanagari character, and the prompt family."""

    context: int = 6000
    reply: int = 768
    rate: float = 1.2
    compact: bool = True
    history_turns: int = 4
    history_budget: int = 800
    max_images: int = 3
    abstain_below: float = 0.10

    @staticmethod
    def of(provider: str) -> GenerationConfig:
        """The budgets of a provider: a local small model, or a hosted large one."""
        known = {"local": GenerationConfig(), "hosted": GenerationConfig(4000, 1024, 2.0, False)}
        if provider not in known:
            raise ValueError(f"no such provider: {provider}; one of {', '.join(known)}")
        return known[provider]


# The four rules every system text holds: only the blocks, cite, conflicts, refuse.
SYSTEM_FULL = (
    "You assist officers who work with government orders. Use nothing but the numbered blocks.\n"
    "Say what an order provides, with its amounts, dates and conditions, and put the number of the block behind each fact, as in [1].\n"
    "Write numbers, dates and amounts as they stand.\n"
    "Where blocks conflict, as one replaces another, say so, cite both and name the one in force.\n"
    "Where the blocks do not answer, say that and cite nothing.\n"
    "Answer in the language of the question."
)
SYSTEM_COMPACT = (
    "Answer from the numbered blocks only and cite each fact as [1]. Copy numbers and dates. "
    "If blocks conflict, cite both and name the one in force. If they do not answer, say so and cite nothing. Use the question's language."
)
WEAK = "\nThe blocks match the question weakly. If they do not answer it, say so first, then what they are about, with their numbers."
# Names of the languages that can be asked for.
LANGUAGES = {"en": "English", "mr": "Marathi (मराठी)", "hi": "Hindi (हिंदी)"}
REFUSALS = {"en": "The orders at hand do not cover this question.", "mr": "उपलब्ध आदेशांमध्ये या प्रश्नाचे उत्तर नाही."}


def language_directive(language: Column) -> Column:
    """A line that pins the answer's language; empty for none and ``auto``; unknown names are passed on."""
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.lower(F.trim(language))), language)
    return F.when(F.coalesce(language, F.lit("")).isin("", "auto"), "").otherwise(F.concat(F.lit("\nWrite the answer in "), name, F.lit(".")))


def reminder(n_blocks: Column, weak: Column, compact: bool) -> Column:
    """What is said last: the range of block numbers that may be cited, and what to do with a weak match."""
    to = F.lit("-" if compact else " to ")
    span = F.when(n_blocks == 1, "[1]").otherwise(F.concat(F.lit("[1]"), to, F.lit("["), n_blocks.cast("string"), F.lit("]")))
    if compact:
        return F.when(weak, F.concat(F.lit("Weak matches: say if they do not answer, then describe them, citing "), span, F.lit("."))).otherwise(F.concat(F.lit("Answer in full in the question's language, citing "), span, F.lit(" after each fact.")))
    rules = F.concat(F.lit("Rules:\n1. There are "), n_blocks.cast("string"), F.lit(" blocks: "), span, F.lit(". Cite no others.\n2. Give the provision itself.\n3. Copy numbers and dates.\n4. If the blocks do not answer, say so."))
    return F.concat(rules, F.when(weak, "\n5. The match is weak: rule 4 is likely to apply.").otherwise(""))


def build_prompts(questions: DataFrame, blocks: DataFrame, config: GenerationConfig = GenerationConfig(), history: DataFrame | None = None) -> DataFrame:
    """(query_id, messages, n_blocks): system text, earlier turns, and the blocks with the question.

    ``questions`` has query_id, text, and may have language and low_confidence;
    ``blocks`` query_id, block_no, block; ``history`` query_id, turn_no, role,
    content as ``grounding.history`` keeps it.  The compact family says its
    reminder after the question, the full one before it.  A question without
    blocks gets an empty context.
    """
    context = blocks.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "block"))), lambda x: x["block"]), "\n\n").alias("__context"), F.count(F.lit(1)).alias("n_blocks")
    )
    q = questions.join(context, "query_id", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0).cast("bigint")))
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    if history is not None:
        turns = F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "role", "content"))), lambda t: message(t["role"], t["content"]))
        q = q.join(history.groupBy("query_id").agg(turns.alias("__turns")), "query_id", "left")
    weak = F.coalesce(F.col("low_confidence"), F.lit(False)) if "low_confidence" in questions.columns else F.lit(False)
    directive = language_directive(F.col("language")) if "language" in questions.columns else F.lit("")
    system = F.concat(F.lit(SYSTEM_COMPACT if config.compact else SYSTEM_FULL), F.when(weak, WEAK).otherwise(""), directive)
    said, asked = F.concat(F.lit("Context:\n"), F.coalesce("__context", F.lit(""))), F.concat(F.lit("Question: "), "text")
    last = reminder(F.col("n_blocks"), weak, config.compact)
    user = F.concat_ws("\n\n", said, asked, last) if config.compact else F.concat_ws("\n\n", said, last, asked)
    none = F.array().cast("array<struct<role:string,content:string>>")
    turns = F.coalesce("__turns", none) if history is not None else none
    return q.select("query_id", F.concat(F.array(message(F.lit("system"), system)), turns, F.array(message(F.lit("user"), user))).alias("messages"), "n_blocks")


def with_images(blocks: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, images, image_blocks): at most ``most`` pictures of each question's blocks, best blocks first, and the numbers of those blocks.

    ``blocks`` has query_id, block_no and image_url; null and empty addresses are none.
    """
    some = blocks.where(F.coalesce("image_url", F.lit("")) != "").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "image_url"))).alias("a"))
    first = F.slice("a", 1, most)
    return some.select("query_id", F.transform(first, lambda x: x["image_url"]).alias("images"), F.transform(first, lambda x: x["block_no"]).alias("image_blocks"))


def quote(prompts: DataFrame, blocks: DataFrame) -> DataFrame:
    """The default generator: the first sentence of every block with its number."""
    return grounding.first_sentences(blocks)


def rewrite(questions: DataFrame, history: DataFrame, rewriter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, text): questions that stand for themselves.

    A question without history stays as it is.  ``rewriter`` takes (query_id,
    text, earlier) and gives (query_id, text); an empty or missing outcome
    leaves the question.  The default puts the last earlier user turn before it.
    """
    last = history.where("role = 'user'").groupBy("query_id").agg(F.max_by("content", "turn_no").alias("earlier"))
    q = questions.select("query_id", "text").join(last, "query_id", "left")
    if rewriter is None:
        return q.select("query_id", F.when(F.col("earlier").isNull(), F.col("text")).otherwise(F.concat("earlier", F.lit(" "), "text")).alias("text"))
    made = rewriter(q.where("earlier is not null")).select("query_id", F.col("text").alias("__made"))
    return q.join(made, "query_id", "left").select("query_id", F.coalesce(F.nullif(F.trim("__made"), F.lit("")), "text").alias("text"))


def answer(questions: DataFrame, evidence: DataFrame, config: GenerationConfig = GenerationConfig(), generate: Generator = quote, history: DataFrame | None = None) -> DataFrame:
    """One row per question: query_id, answer, language, abstained, low_confidence, n_blocks, dropped, valid, phantom.

    ``evidence`` is what a retrieval gave, with text: query_id, row_id, rank,
    score, low_confidence, text.  The tokens of the history that fits are taken
    from the budget of the blocks.  A question whose best score is under
    ``config.abstain_below``, or without any evidence, is refused in its
    language without asking the generator.
    """
    q = questions.select("query_id", "text", *[c for c in ("language",) if c in questions.columns])
    kept_turns = None
    if history is not None:
        turns = history.withColumnRenamed("query_id", "conversation_id")
        kept_turns = grounding.history(turns, config.history_turns, config.history_budget, config.rate).withColumnRenamed("conversation_id", "query_id")
        spent = kept_turns.groupBy("query_id").agg(F.max("spent").alias("__spent"))
        room = F.greatest(F.lit(config.context) - F.coalesce("__spent", F.lit(0)), F.lit(0))
        evidence = evidence.join(spent, "query_id", "left").withColumn("__room", room).drop("__spent")
    state = evidence.where("row_id is not null").groupBy("query_id").agg(F.max("score").alias("__top"), F.max("low_confidence").alias("low_confidence"))
    judged = q.join(state, "query_id", "left").withColumn("low_confidence", F.coalesce("low_confidence", F.lit(True))).withColumn("abstained", grounding.abstains(F.col("__top"), config.abstain_below))
    open_ = judged.where("not abstained")
    found = evidence.where("row_id is not null").join(open_.select("query_id"), "query_id", "left_semi")
    blocks = grounding.trim(found, "__room" if history is not None else config.context, config.rate)
    numbered = blocks.select("query_id", "block_no", "text", "dropped", F.concat(F.lit("["), F.col("block_no").cast("string"), F.lit("] "), "text").alias("block"))
    prompts = build_prompts(open_, numbered, config, kept_turns)
    said = generate(prompts, numbered).select("query_id", "answer")
    size = numbered.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_blocks"), F.max("dropped").alias("dropped"))
    language = grounding.refusal_language(F.col("language") if "language" in q.columns else F.lit("auto"), F.col("text"))
    refusal = F.try_element_at(F.create_map(*[F.lit(x) for kv in REFUSALS.items() for x in kv]), F.col("__language"))
    out = judged.withColumn("__language", language).join(said, "query_id", "left").join(size, "query_id", "left")
    text = F.coalesce("answer", refusal, F.lit(REFUSALS["en"]))
    valid, phantom = grounding.cited(F.col("answer"), F.col("n_blocks"))
    out = out.withColumn("answer", text).withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0))).withColumn("dropped", F.coalesce("dropped", F.lit(0).cast("bigint")))
    return out.select("query_id", "answer", F.col("__language").alias("language"), "abstained", "low_confidence", "n_blocks", "dropped", valid.alias("valid"), phantom.alias("phantom"))


def sources(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, block_no, ...): each valid citation of an answer with what its block says of itself. ``blocks`` has query_id, block_no and more."""
    return answers.select("query_id", F.explode("valid").alias("block_no")).join(blocks, ["query_id", "block_no"])


def document_blocks(chunks: DataFrame, asked: DataFrame, budget: int, per_document: int | None = None, rate: float = 2.0) -> DataFrame:
    """(query_id, doc_id, row_id, text, block_no, dropped): the pieces of the asked documents in order, cut to the budget.

    What summaries and comparisons read.  ``asked`` has query_id, doc_id and
    side (0, 1, …, the order of the documents), ``chunks`` doc_id, row_id,
    chunk_index and text; ``per_document`` keeps the first pieces of each.
    """
    from daftar.operators.search import best

    mine = asked.join(chunks.where("text is not null").select("doc_id", "row_id", "chunk_index", "text"), "doc_id")
    if per_document is not None:
        mine = best(mine, ["query_id", "side"], ["chunk_index", "row_id"], per_document, "__k").drop("__k")
    ordered = mine.withColumn("rank", F.struct("side", "chunk_index", "row_id"))
    return grounding.trim(ordered, budget, rate).select("query_id", "doc_id", "row_id", "text", F.col("block_no").cast("int").alias("block_no"), "dropped")


def prompt_tokens(prompts: DataFrame, rate: float) -> DataFrame:
    """(query_id, tokens) of (query_id, messages)."""
    return prompts.select("query_id", F.aggregate(F.transform("messages", lambda m: token_estimate(m["content"], rate)), F.lit(0), lambda a, x: a + x).alias("tokens"))
