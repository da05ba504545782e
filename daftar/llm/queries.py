"""Queries of the training-data problems on texts, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from daftar.llm import conversations, languages, lookalike, mixing, ocr, packing, pieces, subjects, tokens
from daftar.operators.citations import latest_in_place
from daftar.session import Scratch, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    work = Scratch(spark, "lookalike")
    docs, edges = table(spark, d, "gr_documents"), table(spark, d, "gr_edges")
    held, cited = lookalike.owners(docs, "doc_id", "gr_number"), lookalike.owners(edges, "src_id", "dst_number")
    numbers = work.write(lookalike.spelled(held.select("raw").unionByName(cited.select("raw")), "raw"), "numbers")
    texts = work.write(lookalike.keyed(docs, "doc_id", "text"), "texts")
    found = [("gr_number", lookalike.twins(numbers, held, held)), ("text", lookalike.twins(texts, texts, texts)), ("dst_number", lookalike.twins(numbers, cited, held))]
    pairs = [t.select(F.lit(f).alias("field"), F.col("owner_a").alias("doc_id_a"), F.col("owner_b").alias("doc_id_b")) for f, t in found]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2])


def p1_normalised(spark: SparkSession, d: str) -> DataFrame:
    """How many spellings each field has before and after, and how many values changed."""
    docs, edges = table(spark, d, "gr_documents"), table(spark, d, "gr_edges")
    values = (
        docs.select(F.lit("gr_number").alias("field"), F.col("gr_number").alias("v")).unionByName(docs.select(F.lit("text").alias("field"), F.col("text").alias("v")))
        .unionByName(edges.select(F.lit("dst_number").alias("field"), F.col("dst_number").alias("v"))).where("v is not null")
    )
    keys = values.select("field", lookalike.keys_column("v").alias("k"))
    return keys.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_values"), F.countDistinct("k.raw").alias("n_spellings"), F.countDistinct("k.look").alias("n_looks"),
        F.countDistinct("k.fold").alias("n_folds"), F.count(F.when(F.col("k.raw") != F.col("k.look"), 1)).alias("n_changed"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "gr_documents").select("doc_id", "text")
    chunks = table(spark, d, "gr_chunks").select("faiss_id", "gr_id", "text")
    return ocr.noisy_lines(docs, chunks, ocr.fit(docs, "text"))


def _once(t: DataFrame, *columns: str) -> DataFrame:
    """Rows once each by ``columns``; texts stay where they lie and are told apart by digests."""
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.row_index")).alias("__at")
    told = F.concat_ws("\0", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])
    return latest_in_place(t.select("*", F.sha2(told, 256).alias("__key"), place), "__key", "__at", ()).drop("__key")


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    docs = _once(table(spark, d, "gr_documents"), "doc_id", "text").select("doc_id", "text")
    chunks = _once(table(spark, d, "gr_chunks"), "faiss_id", "text").select("faiss_id", "gr_id", "text")
    return ocr.repaired(docs, chunks, ocr.fit(docs, "text"))


PIECE_CHARS, OVERLAP_CHARS = 1200, 150


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    docs, chunks = table(spark, d, "gr_documents"), table(spark, d, "gr_chunks")
    work = Scratch(spark, "pieces")
    seen = work.write(pieces.survey(docs.select("doc_id", "text"), "doc_id", "text", PIECE_CHARS, OVERLAP_CHARS).where("doc_id is not null").distinct(), "survey")
    over = [("text_over", F.col("n_pieces") > 1), *((f"{u}_over", F.col(u) > PIECE_CHARS) for u in ("paragraph", "sentence", "word"))]
    of_texts = seen.select("doc_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in over]), lambda x: x.isNotNull())).alias("fault"))

    stored = chunks.select(F.col("gr_id").alias("doc_id"), "faiss_id", "chunk_index", "page_start", "page_end", (F.length("text") > PIECE_CHARS).alias("long")).where("doc_id is not null")
    exists = docs.select("doc_id").distinct()
    stored = stored.distinct().join(exists, "doc_id", "left_semi")
    index = stored.groupBy("doc_id", "faiss_id", "chunk_index").agg(F.max("long").alias("long")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_index").alias("distinct"), F.min("chunk_index").alias("lo"), F.max("chunk_index").alias("hi"), F.max("long").alias("long")
    )
    gap = (F.col("n") != F.col("distinct")) | (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1)
    of_index = index.select("doc_id", F.explode(F.filter(F.array(F.when(gap | F.col("hi").isNull(), F.lit("index_gap")), F.when(F.col("long"), F.lit("chunk_over"))), lambda x: x.isNotNull())).alias("fault"))
    page = lambda c: F.coalesce(~F.array_contains("pages", F.col(c)), F.lit(False))
    spans = stored.select("doc_id", "page_start", "page_end").distinct().join(seen.select("doc_id", "pages").distinct(), "doc_id", "left")
    wrong = page("page_start") | page("page_end") | F.coalesce(F.col("page_start") > F.col("page_end"), F.lit(False))
    of_pages = spans.where(wrong).select("doc_id", F.lit("page_span").alias("fault"))
    return of_texts.unionByName(of_index).unionByName(of_pages).distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "gr_documents").select("doc_id", "text").distinct()
    return pieces.split(docs, "doc_id", "text", PIECE_CHARS, OVERLAP_CHARS)


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Each text put together again from its pieces without their overlap, and how many of its pieces are too long or wrongly numbered."""
    p = p3_pieces(spark, d).where("doc_id is not null")
    own = F.when(F.col("chunk_index") == 0, F.col("piece")).otherwise(F.substring("piece", OVERLAP_CHARS + 1, PIECE_CHARS))
    g = p.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", own.alias("own")))).alias("a"), F.count(F.when(F.length("piece") > PIECE_CHARS, 1)).alias("n_over"),
        (F.count(F.lit(1)) - F.countDistinct("chunk_index") + F.max("chunk_index") + 1 - F.count(F.lit(1))).alias("n_gaps"),
    )
    return g.select("doc_id", F.md5(F.array_join(F.transform("a", lambda x: x["own"]), "")).alias("digest"), "n_over", "n_gaps")


def _languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "gr_documents").select("doc_id", "language", "text")
    profiles = languages.fit(languages.sample(docs, "doc_id", "language", "text"))
    return Scratch(spark, "languages").write(languages.assign(docs.where("doc_id is not null"), "doc_id", "language", "text", profiles), "assigned")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    seen = _languages(spark, d)
    whole = seen.where("block_no = -1")
    mislabelled = whole.where("label is null or label <> lang").select("doc_id", "block_no", "lang")
    main = whole.select("doc_id", F.col("lang").alias("main")).distinct()
    foreign = seen.where(f"block_no >= 0 and n_words >= {languages.LEAST_WORDS}").join(main, "doc_id").where("lang <> main").select("doc_id", "block_no", "lang")
    return mislabelled.unionByName(foreign).distinct()


def p5_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every document and of every running block."""
    return _languages(spark, d).select("doc_id", "block_no", "label", "lang", F.round("confidence", 4).alias("confidence")).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    verdicts = conversations.judge(conversations.stretches(conversations.turns(table(spark, d, "messages"), False)))
    ids = table(spark, d, "conversations").select(F.col("id").alias("conversation_id")).where("conversation_id is not null").distinct()
    return ids.join(verdicts.where("verdict = 'kept'"), "conversation_id", "left_anti")


def p7_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild(table(spark, d, "messages"))[0]


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "title", "text")
    return subjects.subjects(docs, table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).where(F.col("n_sentences") >= subjects.LEAST_SENTENCES).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject: documents that deal with each area, and sentences given to it."""
    given = _subjects(spark, d)
    return given.groupBy("subject").agg(
        F.count(F.when(F.col("n_sentences") >= subjects.LEAST_SENTENCES, 1)).alias("n_documents"), F.sum("n_sentences").alias("n_sentences")
    )


def _sizes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", *columns, "text")
    return Scratch(spark, "tokens").write(tokens.measured(docs, "text"), "sizes")


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, int]]:
    sizes = _sizes(spark, d)
    rows = table(spark, d, "pack_capacities").distinct().collect()
    usable = {r["container"]: r["capacity_tokens"] - (r["reserved_tokens"] or 0) for r in rows}
    out = None
    for name, room in sorted(usable.items()):
        part = packing.items(sizes, "doc_id", room, name)
        out = part if out is None else out.unionByName(part)
    return out, usable


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or part of a text larger than the container, with the container it stands in."""
    items, usable = _items(spark, d)
    return packing.pack(items, "doc_id", usable)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used of each size, how full they are, and how many any packing needs at least."""
    items, usable = _items(spark, d)
    bins = packing.pack(items, "doc_id", usable).groupBy("container", "bin_no").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_items"))
    room = F.create_map(*[F.lit(x) for kv in usable.items() for x in kv])[F.col("container")]
    return bins.groupBy("container").agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum("n_items").alias("n_items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
        F.ceil(F.sum("tokens") / F.max(room)).alias("least_bins"), F.round(F.sum("tokens") / F.sum(room), 6).alias("fill"),
    )


def p8_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The optimal length buckets of each container size, with their batches and padding."""
    items, usable = _items(spark, d)
    batches = packing.bucket_batches(items, "doc_id", usable)
    return batches.groupBy("container", "bucket").agg(
        F.count(F.lit(1)).alias("n_items"), F.countDistinct("batch_no").alias("n_batches"), F.sum("tokens").alias("tokens"),
        F.sum(F.col("bucket") - F.col("tokens")).alias("padding"),
    )


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, float]:
    """Sizes, targets and the tokens of all wanted sources, the total of the mixture."""
    sizes, targets = _sizes(spark, d, "source", "lang"), table(spark, d, "source_targets").distinct()
    return sizes, targets, mixing.held(sizes, targets)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The drawn documents, once per epoch, in a mixture as large as all wanted sources together; rare ones stop at their repetitions."""
    drawn, _ = mixing.mix(*_mixed(spark, d))
    return drawn.select("doc_id", "source", "lang", "epoch", "n_tokens")


def p9_largest_exact(spark: SparkSession, d: str) -> DataFrame:
    """The drawn documents, once per epoch, in the largest mixture that gives every source its share."""
    drawn, _ = mixing.mix(_sizes(spark, d, "source", "lang"), table(spark, d, "source_targets"))
    return drawn.select("doc_id", "source", "lang", "epoch", "n_tokens")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached shares of each source: in the largest exact mixture, and in p9_mixture, as large as all wanted sources together."""
    sizes, targets, held = _mixed(spark, d)
    out = None
    for name, total in (("largest_exact", None), ("one_epoch", held)):
        drawn, _ = mixing.mix(sizes, targets, total)
        got = drawn.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_texts"), (F.max("epoch") + 1).alias("most_repeats"))
        part = targets.join(got, "source", "left").select(F.lit(name).alias("mixture"), "source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "n_texts", "most_repeats")])
        out = part if out is None else out.unionByName(part)
    return out.withColumn("share", F.round(F.try_divide(F.col("tokens"), F.sum("tokens").over(W.partitionBy("mixture"))), 6))


QUERIES = {
    "p1_found": p1_found,
    "p1_normalised": p1_normalised,
    "p2_found": p2_found,
    "p2_repaired": p2_repaired,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_coverage": p3_coverage,
    "p5_found": p5_found,
    "p5_languages": p5_languages,
    "p7_found": p7_found,
    "p7_conversations": p7_conversations,
    "p8_packing": p8_packing,
    "p8_fill": p8_fill,
    "p8_buckets": p8_buckets,
    "p9_mixture": p9_mixture,
    "p9_largest_exact": p9_largest_exact,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
}

_TURNS = """
WITH m AS (
  SELECT DISTINCT conversation_id, id, content, created_at,
    coalesce(CASE WHEN lower(trim(role, ' ' || chr(9) || chr(10))) IN ('system', 'user', 'assistant') THEN lower(trim(role, ' ' || chr(9) || chr(10))) END, 'other') AS role
  FROM messages WHERE conversation_id IS NOT NULL AND trim(coalesce(content, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) <> ''),
r AS (SELECT *, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS rk FROM m),
t AS (
  SELECT *, lag(role) OVER w AS pr, lag(content) OVER w AS pc FROM r WHERE role <> 'system'
  WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, rk, content, id)),
u AS (SELECT * FROM t WHERE pr IS NULL OR pr <> role OR pc <> content),
n AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, rk, content, id) AS k FROM u),
kept AS (
  SELECT conversation_id FROM n GROUP BY conversation_id
  HAVING bool_and(role = CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END) AND count(*) % 2 = 0)
"""

# Sizes in characters; sentences and runs as TESTDATA.md defines them.
_FAULTS = """
WITH t AS (SELECT DISTINCT doc_id, text FROM gr_documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
par AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\x{00A0}]*\\n\\s*\\n')) AS p FROM t),
sen AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(p, '([.?!।])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM par),
pg AS (SELECT doc_id, CASE WHEN len(n) > 0 THEN list_transform(n, lambda x: x::INT) ELSE [1] END AS pages
  FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^#[ \\t]*Page[ \\t]*(\\d+)[ \\t]*$', 1) AS n FROM t)),
c AS (SELECT DISTINCT gr_id AS doc_id, faiss_id, chunk_index, page_start, page_end, length(text) AS n FROM gr_chunks
  WHERE gr_id IN (SELECT doc_id FROM gr_documents WHERE doc_id IS NOT NULL)),
i AS (SELECT DISTINCT doc_id, faiss_id, chunk_index FROM c)
"""

ORACLE = {
    "p3_found": _FAULTS
    + """SELECT doc_id, 'text_over' AS fault FROM t WHERE length(text) > 1200
UNION SELECT doc_id, 'paragraph_over' FROM par WHERE length(trim(p, ' ' || chr(10))) > 1200
UNION SELECT doc_id, 'sentence_over' FROM sen WHERE length(trim(s, ' ' || chr(10))) > 1200
UNION SELECT doc_id, 'word_over' FROM t WHERE regexp_matches(text, '\\S{1000}\\S{201}')
UNION SELECT doc_id, 'chunk_over' FROM c WHERE n > 1200
UNION SELECT doc_id, 'index_gap' FROM i GROUP BY doc_id
  HAVING count(*) <> count(DISTINCT chunk_index) OR min(chunk_index) <> 0 OR max(chunk_index) <> count(*) - 1 OR max(chunk_index) IS NULL
UNION SELECT c.doc_id, 'page_span' FROM c LEFT JOIN pg ON c.doc_id = pg.doc_id
  WHERE coalesce(NOT list_contains(pages, page_start), FALSE) OR coalesce(NOT list_contains(pages, page_end), FALSE) OR coalesce(page_start > page_end, FALSE)""",
    "p3_coverage": "SELECT DISTINCT doc_id, md5(text) AS digest, 0::BIGINT AS n_over, 0::BIGINT AS n_gaps FROM gr_documents WHERE doc_id IS NOT NULL AND text <> ''",
    "p7_found": _TURNS + "SELECT DISTINCT id AS conversation_id FROM conversations WHERE id IS NOT NULL AND id NOT IN (SELECT conversation_id FROM kept)",
    "p7_conversations": _TURNS
    + """SELECT conversation_id, k::INT AS turn_no, role, content, created_at FROM n WHERE conversation_id IN (SELECT conversation_id FROM kept)
UNION ALL SELECT conversation_id, 0, role, content, created_at FROM r WHERE role = 'system' AND conversation_id IN (SELECT conversation_id FROM kept)""",
}
