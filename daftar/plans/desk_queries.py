"""Queries of the desk around the register: answers, graph records, stored indexes, look-ups and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.functions import text as tx
from daftar.functions.metadata import reference_block
from daftar.functions.vectors import hashed_embedding
from daftar.operators import answering, catalog, citations, evaluation, fusion, grounding, integrity, portal, retrieval, search, tables
from daftar.plans import register_queries as r
from daftar.plans import register_sql as q
from daftar.session import Scratch, table
from daftar.sources.index import PostingIndex, VectorStore
from daftar.sources.register import as_text


def asked_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose id is divisible by 100 as a number."""
    return r.docs(spark, d).where("doc_id rlike '00$'").select("doc_id")


# --- look-ups ----------------------------------------------------------------


def table_info(spark, d):
    return catalog.table_info(table(spark, d, "gr_edges")).select("cid", "name")


def get_document(spark, d):
    got = catalog.by_id(r.docs(spark, d, "gr_number", "date", "refs"), asked_orders(spark, d))
    return got.select("doc_id", "gr_number", "date", F.coalesce(F.size("refs"), F.lit(0)).alias("n_refs"))


def list_documents_flat(spark, d):
    return catalog.from_pieces(r.chunks(spark, d))


def document_download(spark, d):
    got = as_text(r.docs(spark, d, "gr_number", "date", "department", "text").where("text is not null"))
    return got.select("doc_id", F.md5("value").alias("digest"))


def document_keys(spark, d):
    names = [F.col(c) for c in ("gr_number", "doc_id", "source_file")]
    return r.docs(spark, d, "gr_number", "source_file").select("doc_id", F.md5(catalog.hay(*names)).alias("hay_digest"), catalog.doc_key(*names).alias("doc_key"))


def source_paths(spark, d):
    """Id and department that a stored path of an order gives."""
    files = table(spark, d, "gr_documents").select("source_file").where("source_file is not null").distinct()
    parts = F.split("source_file", "/")
    return files.select("source_file", F.element_at(F.split(F.element_at(parts, -1), r"\."), 1).alias("doc_id"), F.replace(F.element_at(parts, 1), F.lit("_"), F.lit(" ")).alias("department"))


def core_metadata(spark, d):
    """Pieces with what their order says, where they do not say it themselves."""
    core = r.chunks(spark, d).select(F.col("gr_id").alias("doc_id"), "faiss_id", "content_type", F.lit(None).cast("string").alias("title"))
    return catalog.merged(core, r.docs(spark, d, "gr_number", "date").select("doc_id", "title", "gr_number", "date"), "doc_id")


# --- tables -------------------------------------------------------------------


def _tables(spark, d):
    return tables.rows_of(r.docs(spark, d, "text"), "doc_id", "text")


def tables_real(spark, d):
    """Which tables of the texts are tables of data."""
    return _tables(spark, d).select("doc_id", "first_line", tables.looks_real(F.col("rows")).alias("real"))


def tables_signature(spark, d):
    """Each different table of a text once, at its first place."""
    return tables.first_of_equal(_tables(spark, d), "rows", ["doc_id"], ["first_line"]).select("doc_id", "first_line", F.array_join(tables.signature(F.col("rows")), "|").alias("signature"))


def tables_cleaned(spark, d):
    """Every table with its header rows merged, its caption and prose rows dropped."""
    clean = _tables(spark, d).withColumn("clean", tables.clean_rows(F.col("rows")))
    said = F.array_join(F.transform("clean", lambda x: F.array_join(x, "|")), "\n")
    return clean.select("doc_id", "first_line", F.size("clean").alias("n_rows"), F.md5(said).alias("digest"))


def markdown_stripped(spark, d):
    t = r.docs(spark, d, "text").where("text is not null").select("doc_id", tables.without_markdown_tables(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


# --- graph ---------------------------------------------------------------------


def graph_nodes(spark, d):
    return citations.nodes(r.docs(spark, d, "gr_number", "date", "department"))


_EDGE = ["src_id", "dst_id", "dst_number", "dst_date", "kind", "resolution"]


def outgoing_edges(spark, d):
    return citations.outgoing(r.edges(spark, d), asked_orders(spark, d)).select(*_EDGE).distinct()


def incoming_edges(spark, d):
    return citations.incoming(r.edges(spark, d), asked_orders(spark, d)).select(*_EDGE).distinct()


def _around(spark, d):
    e = r.edges(spark, d)
    return citations.neighbour_edges(e, citations.neighbourhood(e, asked_orders(spark, d).withColumnRenamed("doc_id", "root_id"), 1), 1)


def neighbourhood_edges(spark, d):
    return _around(spark, d)[0]


def neighbourhood_dangling(spark, d):
    return _around(spark, d)[1]


def supersession_records(spark, d):
    """The record of the orders whose id ends in 00, and of one id that no order has."""
    docs = r.docs(spark, d, "gr_number", "date", "supersedes")
    asked = asked_orders(spark, d).unionByName(spark.createDataFrame([("none",)], "doc_id string"))
    got = citations.supersession(docs, r.edges(spark, d), r.supersede_chain(spark, d), asked)
    return got.withColumn("chain", F.array_join("chain", " > "))


def held_numbers(spark, d):
    asked = table(spark, d, "gr_edges").where("edge_id % 100 = 0 and dst_number <> ''").select(F.col("dst_number").alias("asked")).distinct()
    return citations.held_numbers(r.docs(spark, d, "gr_number"), asked)


def _cited(spark, d):
    blocks = r.docs(spark, d, "text").where("text is not null").select("doc_id", reference_block(F.col("text")).alias("block"))
    names = table(spark, d, "gr_documents").where("department <> ''").select("department", F.regexp_extract("department", r"^\S+", 0).alias("fragment")).distinct()
    held = r.docs(spark, d, "department").where("department is not null").select("department")
    return citations.departments_cited(blocks, names, held)


def departments_cited(spark, d):
    """Departments by the orders whose reference block holds the first word of their name, and whether the register has orders of them."""
    return _cited(spark, d)[0]


def reference_blocks(spark, d):
    """How many orders have a reference block, and how many of those name no department."""
    return _cited(spark, d)[1]


def edges_rebuilt(spark, d):
    """The edges built and written twice over: the second run leaves what the first did."""
    path = Scratch(spark, "edges").path("built")
    integrity.rebuilt(r.edges_build(spark, d), path)
    return citations.counts(integrity.rebuilt(r.edges_build(spark, d), path))


# --- indexes --------------------------------------------------------------------


def _rows_in_place(spark, d):
    """``chunk_rows`` with the texts left where they lie."""
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.row_index")).alias("__at")
    stored = table(spark, d, "gr_chunks").select(F.col("faiss_id").alias("row_id"), "content_type", "text", place)
    return citations.latest_in_place(stored, "row_id", "__at", ()).where("text is not null")


def _postings(spark, d):
    index = PostingIndex(spark, Scratch(spark, "postings").path("index"))
    rows = _rows_in_place(spark, d)
    index.add(rows.where("content_type = 'text'"))
    index.add(rows.where("content_type <> 'text' or content_type is null"))
    return index, rows


def bm25_stored(spark, d):
    """The term search of ``bm25_fts_topk``, from a stored index that was filled in two parts."""
    return _postings(spark, d)[0].search(r.questions(spark, d), r.K)


def bm25_stored_okapi(spark, d):
    return _postings(spark, d)[0].search(r.questions(spark, d), r.K, "okapi")


def bm25_after_delete(spark, d):
    """The same after all tables were taken out of the index and the rest was written anew."""
    index, rows = _postings(spark, d)
    index.delete(rows.where("content_type = 'table'").select("row_id"))
    return index.compact(index.root + "-compact").search(r.questions(spark, d), r.K)


def _stored_vectors(spark, d):
    store = VectorStore(spark, Scratch(spark, "vectors").path("store"), 64)
    store.add(r.chunk_rows(spark, d).select("row_id", "doc_id", hashed_embedding(F.col("text")).alias("vec")))
    store.check()
    return store.load()


def vector_store_round_trip(spark, d):
    v = _stored_vectors(spark, d)
    return v.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_documents"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most"))


def alignment(spark, d):
    """The stored vectors of all pieces against those made anew from their texts."""
    made = r.chunk_rows(spark, d).where(F.size(tx.tokenize(F.col("text"))) > 0).select("row_id", hashed_embedding(F.col("text")).alias("vec"))
    return integrity.alignment(_stored_vectors(spark, d), made)


# --- answers ----------------------------------------------------------------------


def _embed(spark, d):
    """The embedder of these tables: the stored vector of the piece that a question was taken from."""
    return lambda questions: r.vectors(spark, d).select(F.col("row_id").alias("query_id"), "vec").join(questions.select("query_id"), "query_id", "left_semi")


def retrieve_facets(spark, d):
    """The whole retrieval under a filter, by cosine."""
    f = catalog.facets(date_from="2010-01-01", language="mr")
    allowed = r.docs(spark, d, "date", "language").where(f).select("doc_id")
    return retrieval.retriever("corpus")(r.questions(spark, d), r.chunk_rows(spark, d), r.vectors(spark, d), _embed(spark, d), allowed=allowed)


def retrieve_flat(spark, d):
    return retrieval.retriever("flat")(r.questions(spark, d), r.chunk_rows(spark, d), r.vectors(spark, d), _embed(spark, d))


def _evidence(spark, d):
    rows, questions = r.chunk_rows(spark, d), r.questions(spark, d)
    scorer = retrieval.lexical_scorer(search.statistics(rows))
    found = retrieval.retrieve(questions, rows, r.vectors(spark, d), _embed(spark, d), scorer).join(rows.select("row_id", "text"), "row_id", "left")
    return Scratch(spark, "evidence").write(found, "found")  # read several times by an answer


def answers(spark, d):
    """Questions to cited answers: retrieval with the default scorer, the budget of a hosted model, the default generator."""
    config = answering.GenerationConfig(context=3000, rate=2.0)
    out = answering.answer(r.questions(spark, d), _evidence(spark, d), config)
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("query_id", F.md5("answer").alias("digest"), "language", "abstained", "low_confidence", "n_blocks", "dropped", join("valid"), join("phantom"))


def answer_sources(spark, d):
    """The order behind each citation of these answers."""
    config = answering.GenerationConfig(context=3000, rate=2.0)
    evidence = _evidence(spark, d)
    out = answering.answer(r.questions(spark, d), evidence, config)
    blocks = grounding.trim(evidence.where("row_id is not null"), config.context, config.rate).select("query_id", F.col("block_no").cast("int").alias("block_no"), "row_id")
    return answering.sources(out, blocks.join(r.chunk_rows(spark, d).select("row_id", "doc_id"), "row_id"))


def _conversation_turns(spark, d):
    m = table(spark, d, "messages").where("conversation_id is not null and content is not null").select("id", "conversation_id", "role", "content", "created_at").distinct()
    from pyspark.sql import Window as W

    back = F.row_number().over(W.partitionBy("conversation_id").orderBy(F.desc_nulls_last("created_at"), F.desc("id"), F.desc("role"), F.desc("content")))
    t = m.withColumn("back", back).where("back <= 5")  # the question and the four turns before it
    return t.select(F.col("conversation_id").alias("query_id"), F.lower(F.trim("role")).alias("role"), "content", "back", (-F.col("back")).alias("turn_no"))


def _chat(spark, d, config):
    t = _conversation_turns(spark, d)
    questions = t.where("back = 1").select("query_id", F.col("content").alias("text"), F.lit("hi").alias("language"))
    turns = grounding.history(t.where("back > 1").select(F.col("query_id").alias("conversation_id"), "turn_no", "role", "content"), config.history_turns, config.history_budget, config.rate)
    none = spark.createDataFrame([], "query_id string, block_no int, block string")
    p = answering.build_prompts(questions, none, config, turns.withColumnRenamed("conversation_id", "query_id"))
    said = F.array_join(F.transform(F.slice("messages", 2, F.greatest(F.size("messages") - 2, F.lit(0))), lambda m: F.concat(F.coalesce(m["role"], F.lit("?")), F.lit(":"), m["content"])), "\n")
    return p.select("query_id", F.size("messages").alias("n_messages"), F.md5(said).alias("history_digest"), F.md5(F.element_at("messages", -1)["content"]).alias("user_digest"))


def chat_prompts_compact(spark, d):
    """The last message of every conversation as the question, with the turns before it that fit."""
    return _chat(spark, d, answering.GenerationConfig.of("local"))


def chat_prompts_full(spark, d):
    return _chat(spark, d, answering.GenerationConfig.of("hosted"))


def questions_rewritten(spark, d):
    t = _conversation_turns(spark, d)
    out = answering.rewrite(t.where("back = 1").select("query_id", F.col("content").alias("text")), t.where("back > 1"))
    return out.select("query_id", F.md5("text").alias("digest"))


def _pieces(spark, d):
    return r.chunks(spark, d).select(F.col("gr_id").alias("doc_id"), F.col("faiss_id").alias("row_id"), "chunk_index", "text")


def summary_blocks(spark, d):
    """What a summary of each asked order reads: its pieces in order, within the budget."""
    asked = asked_orders(spark, d).select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(0).alias("side"))
    return answering.document_blocks(_pieces(spark, d), asked, 1500).drop("text")


def comparison_blocks(spark, d):
    """What a comparison of an order with the one it replaces reads: six pieces a side, within the budget."""
    pairs = r.edges(spark, d).where("kind = 'supersedes' and dst_id is not null and src_id <> dst_id").select("src_id", "dst_id").distinct()
    name = F.concat("src_id", F.lit("/"), "dst_id").alias("query_id")
    asked = pairs.select(name, F.col("src_id").alias("doc_id"), F.lit(0).alias("side")).unionByName(pairs.select(name, F.col("dst_id").alias("doc_id"), F.lit(1).alias("side")))
    return answering.document_blocks(_pieces(spark, d), asked, 3000, 6).drop("text")


# --- portal and evaluation ------------------------------------------------------------


def health(spark, d):
    docs, chunks = r.docs(spark, d, "department", "date"), r.chunks(spark, d)
    return catalog.totals(docs, chunks).select(F.when(F.col("chunks") > 0, "ok").otherwise("loading").alias("status"), "documents", "departments", F.col("chunks").alias("indexed"))


def conversation_appended(spark, d):
    """Two messages and a conversation added: one of the messages is stored already."""
    c, m = table(spark, d, "conversations").distinct(), table(spark, d, "messages").distinct()
    one = spark.createDataFrame([("new", "u002")], "id string, user_id string")
    said = spark.createDataFrame([("new-1", "new", "user", "What holds?")], "id string, conversation_id string, role string, content string")
    said = said.unionByName(m.where("id is not null").orderBy("id").limit(1).select("id", "conversation_id", "role", "content"))
    both = portal.appended(m.select("id", "conversation_id", "role", "content").distinct(), said, "id")
    return portal.conversation_counts(portal.appended(c, one, "id"), both).where("id = 'new' or n_messages > 8").select("id", "user_id", "n_messages")


def role_rules(spark, d):
    """Who may read the audit and who may force the language of an answer."""
    u = table(spark, d, "users").select("id", "role").distinct()
    return u.select("id", portal.allowed(F.col("role"), ["admin"]).alias("may_audit"), portal.answer_language(F.col("role"), F.lit("mr"), ["admin", "officer"]).alias("language"))


def answer_latency(spark, d):
    """Seconds from a question to its answer, by the answer's length class."""
    from pyspark.sql import Window as W

    m = table(spark, d, "messages").where("conversation_id is not null and created_at is not null").select("id", "conversation_id", F.lower(F.trim("role")).alias("role"), "created_at", F.length("content").alias("n")).distinct()
    w = W.partitionBy("conversation_id").orderBy("created_at", "id", "role", "n")
    steps = m.withColumn("before", F.lag("created_at").over(w)).withColumn("asked", F.lag("role").over(w)).where("role = 'assistant' and asked = 'user'")
    steps = steps.select(F.when(F.col("n") > 100, "long").otherwise("short").alias("stage"), F.round(F.col("created_at") - F.col("before"), 3).alias("seconds"))
    return evaluation.latencies(steps, "stage", "seconds")


def _hays(spark, d):
    names = r.docs(spark, d, "gr_number").select("doc_id", catalog.hay(F.col("gr_number"), F.col("doc_id")).alias("hay"))
    return r._ranked(spark, d).join(names, "doc_id")


def hit_by_containment(spark, d):
    """The first rank whose names contain the number of the order that a question was taken from."""
    expected = r._relevant(spark, d).join(r.docs(spark, d, "gr_number"), "doc_id").where("gr_number is not null").select("query_id", F.col("gr_number").alias("name"))
    return evaluation.first_match(_hays(spark, d), expected)


def demo_verification(spark, d):
    """Known questions against the first hit; those whose order is undated count as outside."""
    expected = r._relevant(spark, d).join(r.docs(spark, d, "date"), "doc_id").join(r.questions(spark, d).select("query_id"), "query_id", "left_semi")
    expected = expected.select("query_id", F.col("doc_id").alias("name"), F.lit(None).cast("string").alias("number"), F.col("date").isNull().alias("outside"))
    tops = _hays(spark, d).where("rank = 1").join(r.chunk_rows(spark, d).select("row_id", "text"), "row_id").select("query_id", "hay", "text", (F.col("score") < 20).alias("low_confidence"))
    return evaluation.verified(tops, expected)


_NAMES = """table_info get_document list_documents_flat document_download document_keys source_paths core_metadata tables_real tables_signature
tables_cleaned markdown_stripped graph_nodes outgoing_edges incoming_edges neighbourhood_edges neighbourhood_dangling supersession_records
held_numbers departments_cited reference_blocks edges_rebuilt bm25_stored bm25_stored_okapi bm25_after_delete vector_store_round_trip
alignment retrieve_facets retrieve_flat answers answer_sources chat_prompts_compact chat_prompts_full questions_rewritten summary_blocks
comparison_blocks health conversation_appended role_rules answer_latency hit_by_containment demo_verification"""

QUERIES = {name: globals()[name] for name in _NAMES.split()}

_D, _C, _E = "WITH " + q._DOCS, q._CHUNKS, q._EDGES
_ASKED = "a0 AS (SELECT doc_id FROM docs WHERE doc_id LIKE '%00')"
_ROWS = q._SAID.replace("said0 AS", "tb AS (SELECT doc_id, first_line, list(c ORDER BY line_no) AS r FROM cut GROUP BY ALL), said0 AS")
_FLAT = "ft AS (SELECT *, list_filter(list_transform(flatten(r), lambda c: trim(c)), lambda c: c <> '') AS f, list_max(list_transform(r, lambda x: len(x))) AS w FROM tb)"
_TURNS = """m AS (SELECT DISTINCT id, conversation_id, role, content, created_at FROM messages WHERE conversation_id IS NOT NULL AND content IS NOT NULL),
t AS (SELECT conversation_id AS query_id, lower(trim(role)) AS role, content, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC NULLS LAST, id DESC NULLS LAST, role DESC NULLS LAST, content DESC) AS back FROM m QUALIFY back <= 5)"""
_GATE = """g0 AS (SELECT *, coalesce(score >= CASE WHEN content_type = 'table' THEN 0.50 ELSE 0.55 END, FALSE) AS ok FROM pool), g1 AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS anyok FROM g0),
g2 AS (SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, row_id)::INT AS rank, NOT anyok AS low_confidence, anyok FROM g1 WHERE ok OR NOT anyok
  QUALIFY rank <= CASE WHEN anyok THEN 12 ELSE 2 END)
SELECT u.query_id, row_id, score, rank, coalesce(low_confidence, TRUE) AS low_confidence FROM (SELECT DISTINCT query_id FROM qu) u LEFT JOIN g2 ON g2.query_id = u.query_id"""
_AROUND = _D + ", " + _E + ", " + _ASKED + """, lk0 AS (SELECT src_id AS a, dst_id AS b, 0 AS way FROM edges WHERE dst_id IS NOT NULL UNION ALL SELECT dst_id, src_id, 1 FROM edges WHERE dst_id IS NOT NULL),
n1 AS (SELECT doc_id AS root_id, b AS node_id, min(way) AS way FROM a0 JOIN lk0 ON a = doc_id WHERE a <> b GROUP BY ALL),
nr AS (SELECT root_id, node_id FROM (SELECT doc_id AS root_id, doc_id AS node_id, 0 AS dist, 0 AS way FROM a0 UNION ALL SELECT root_id, node_id, 1, way FROM n1) QUALIFY row_number() OVER (PARTITION BY root_id ORDER BY dist, way, node_id) <= 60)"""
_ANSWERED = (
    "WITH " + q._TEXTS + ", " + q._DENSE.replace("pairs AS", "qs2 AS (SELECT * FROM qs WHERE query_id IN (SELECT query_id FROM qu)), pairs AS").replace("FROM rows, qs)", "FROM rows, qs2)") + ", " + q.dense(60) + ", " + q.bm25(20) + ", " + q.fused() + ", " + q._RERANKED
    + r""", top AS (SELECT query_id, max(score) AS t, bool_or(low_confidence) AS low FROM gt GROUP BY query_id),
say AS (SELECT query_id, block_no, CASE WHEN regexp_matches(text, '(?s)^\s*.*?[.?!।](?:\s|\z)') THEN regexp_extract(text, '(?s)^\s*(.*?[.?!।])(?:\s|\z)', 1) ELSE regexp_extract(text, '(?s)^\s*(.*)', 1) END || ' [' || block_no || ']' AS s FROM tr WHERE kept),
an AS (SELECT query_id, string_agg(s, ' ' ORDER BY block_no) AS answer, count(*) AS n_blocks FROM say GROUP BY query_id),
dr AS (SELECT query_id, max(dropped) AS dropped FROM tr GROUP BY query_id),
ja AS (SELECT u.query_id, u.text, coalesce(low, TRUE) AS low_confidence, coalesce(t, 0) < 0.10 AS abstained FROM qu u LEFT JOIN top USING (query_id))"""
)
_BLOCKS = _D + r""", bk AS (SELECT doc_id, regexp_extract(text, '(?s)(?:वाचा|संदर्भ|Reference|Read)[\s.:：ः–-]*(.*?)(?:\n\s*(?:विषय|Subject|प्रस्तावना|शासन निर्णय|Preamble)\s*[:：ः]|\z)', 1) AS b FROM docs WHERE text IS NOT NULL)"""
_CITED = r"list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\[(\d{1,9})\]', 1), lambda x: x::INT)))"


def _chat_sql(rate: float, compact: bool) -> str:
    last = "Answer in full in the question''s language, citing ' || sp || ' after each fact." if compact else "Rules:' || chr(10) || '1. There are 0 blocks: ' || sp || '. Cite no others.' || chr(10) || '2. Give the provision itself.' || chr(10) || '3. Copy numbers and dates.' || chr(10) || '4. If the blocks do not answer, say so."
    parts = ["'Context:' || chr(10)", "'Question: ' || content", f"'{last}'"]
    user = " || chr(10) || chr(10) || ".join(parts if compact else [parts[0], parts[2], parts[1]])
    return (
        "WITH " + _TURNS + f""", h0 AS (SELECT *, sum({q.estimate('content', rate)}) OVER (PARTITION BY query_id ORDER BY back) AS spent FROM t WHERE back > 1),
        h AS (SELECT query_id, count(*) AS n, string_agg(coalesce(role, '?') || ':' || content, chr(10) ORDER BY back DESC) AS s FROM h0 WHERE spent <= 800 GROUP BY query_id),
        u AS (SELECT query_id, content, '{'[1]-[0]' if compact else '[1] to [0]'}' AS sp FROM t WHERE back = 1)
        SELECT u.query_id, (2 + coalesce(n, 0))::INT AS n_messages, md5(coalesce(s, '')) AS history_digest, md5({user}) AS user_digest FROM u LEFT JOIN h ON h.query_id = u.query_id"""
    )


ORACLE = {
    "table_info": "SELECT (row_number() OVER () - 1)::INT AS cid, column_name AS name FROM (DESCRIBE gr_edges)",
    "get_document": _D + " SELECT doc_id, gr_number, date, coalesce(len(refs), 0)::INT AS n_refs FROM docs WHERE doc_id LIKE '%00'",
    "list_documents_flat": "WITH " + _C + """ SELECT gr_id AS doc_id, content_type, page_start, count(*) OVER (PARTITION BY gr_id) AS n_pieces FROM chunks WHERE gr_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY gr_id ORDER BY chunk_index NULLS FIRST, faiss_id) = 1""",
    "document_download": _D + """ SELECT doc_id, md5(concat_ws(chr(10) || chr(10), concat_ws(chr(10), 'Number: ' || gr_number, 'Date: ' || date, 'Department: ' || department, 'Title: ' || title), text)) AS digest
        FROM docs WHERE text IS NOT NULL""",
    "document_keys": _D + " SELECT doc_id, md5(concat_ws(' ', gr_number, doc_id, source_file)) AS hay_digest, coalesce(nullif(gr_number, ''), nullif(doc_id, ''), nullif(source_file, '')) AS doc_key FROM docs",
    "source_paths": "SELECT DISTINCT source_file, string_split(string_split(source_file, '/')[-1], '.')[1] AS doc_id, replace(string_split(source_file, '/')[1], '_', ' ') AS department FROM gr_documents WHERE source_file IS NOT NULL",
    "core_metadata": _D + ", " + _C + " SELECT gr_id AS doc_id, faiss_id, content_type, NULL::VARCHAR AS title, gr_number, date FROM chunks LEFT JOIN docs ON docs.doc_id = gr_id",
    "tables_real": "WITH " + _ROWS + ", " + _FLAT + r""" SELECT doc_id, first_line::INT AS first_line, coalesce(len(r) >= 2 AND w BETWEEN 2 AND 20 AND len(f) >= 4
        AND len(list_filter(r, lambda x: len(list_filter(x, lambda c: length(trim(c)) > 1)) >= 2 AND len(list_filter(x, lambda c: length(trim(c)) > 1)) >= 0.4 * w)) >= 2
        AND len(list_filter(f, lambda c: regexp_matches(c, '\p{Nd}'))) / len(f) >= 0.30 AND len(list_filter(f, lambda c: length(c) > 30)) / len(f) <= 0.35
        AND list_max(list_transform(f, lambda c: length(c))) <= 80 AND len(list_filter(f, lambda c: regexp_matches(c, '^\p{L}{9,}$'))) / len(f) <= 0.15, FALSE) AS real FROM ft""",
    "tables_signature": "WITH " + _ROWS + ", " + _FLAT + """, sg AS (SELECT doc_id, first_line, list_sort(f)[1:12] AS s FROM ft)
        SELECT doc_id, first_line::INT AS first_line, array_to_string(s, '|') AS signature FROM sg QUALIFY len(s) = 0 OR row_number() OVER (PARTITION BY doc_id, s ORDER BY first_line) = 1""",
    "graph_nodes": _D + " SELECT doc_id, gr_number, date, substring(coalesce(title, ''), 1, 120) AS title, department FROM docs",
    "outgoing_edges": _D + ", " + _E + ", " + _ASKED + " SELECT DISTINCT src_id, dst_id, dst_number, dst_date, kind, resolution FROM edges WHERE src_id IN (SELECT doc_id FROM a0)",
    "incoming_edges": _D + ", " + _E + ", " + _ASKED + " SELECT DISTINCT src_id, dst_id, dst_number, dst_date, kind, resolution FROM edges WHERE dst_id IN (SELECT doc_id FROM a0)",
    "neighbourhood_edges": _AROUND + """ SELECT DISTINCT a0.doc_id AS root_id, src_id AS src, dst_id AS dst, kind FROM a0 JOIN edges ON src_id = a0.doc_id OR dst_id = a0.doc_id
        WHERE resolution = 'resolved' AND dst_id IS NOT NULL AND (a0.doc_id, src_id) IN (SELECT (root_id, node_id) FROM nr) AND (a0.doc_id, dst_id) IN (SELECT (root_id, node_id) FROM nr)""",
    "neighbourhood_dangling": _AROUND + " SELECT DISTINCT a0.doc_id AS root_id, src_id, dst_number AS gr_number, dst_date AS date, kind, resolution FROM a0 JOIN edges ON src_id = a0.doc_id WHERE resolution <> 'resolved' OR dst_id IS NULL",
    "supersession_records": q._CHAIN + """, a AS (SELECT doc_id FROM docs WHERE doc_id LIKE '%00' UNION ALL SELECT 'none'), ct AS (SELECT src_id, count(DISTINCT dst_number) AS n, count(DISTINCT dst_id) AS h FROM edges GROUP BY src_id),
        lt AS (SELECT doc_id, list(next_id ORDER BY hop) AS c FROM ch GROUP BY doc_id)
        SELECT a.doc_id, d.doc_id IS NOT NULL AS found, gr_number, coalesce(supersedes, FALSE) AS declares, CASE WHEN d.doc_id IS NOT NULL THEN coalesce(n, 0) END AS n_cites,
          CASE WHEN d.doc_id IS NOT NULL THEN coalesce(h, 0) END AS n_held, c[1] AS superseded_by, array_to_string(c, ' > ') AS chain FROM a LEFT JOIN docs d ON d.doc_id = a.doc_id LEFT JOIN ct ON src_id = a.doc_id LEFT JOIN lt ON lt.doc_id = a.doc_id""",
    "held_numbers": _D + """, a AS (SELECT DISTINCT dst_number AS asked FROM gr_edges WHERE edge_id % 100 = 0 AND dst_number <> '') SELECT asked, min(doc_id) AS doc_id FROM a LEFT JOIN docs ON contains(gr_number, asked) GROUP BY asked""",
    "departments_cited": _BLOCKS + """, n AS (SELECT DISTINCT department, regexp_extract(department, '^\\S+') AS f FROM gr_documents WHERE department <> '')
        SELECT department, count(DISTINCT doc_id) AS n_documents, TRUE AS held FROM bk JOIN n ON contains(b, f) WHERE b <> '' AND f <> '' GROUP BY department""",
    "reference_blocks": _BLOCKS + """, n AS (SELECT DISTINCT regexp_extract(department, '^\\S+') AS f FROM gr_documents WHERE department <> ''), x AS (SELECT doc_id, any_value(b) AS b, bool_or(coalesce(f <> '' AND contains(b, f), FALSE)) AS hit FROM bk LEFT JOIN n ON TRUE GROUP BY doc_id)
        SELECT count(*) AS n_documents, count(*) FILTER (b <> '') AS with_block, count(*) FILTER (b <> '' AND NOT hit) AS unattributed FROM x""",
    "edges_rebuilt": q.ORACLE["edge_counts"],
    "bm25_stored": q.ORACLE["bm25_fts_topk"],
    "bm25_stored_okapi": q.ORACLE["bm25_okapi_topk"],
    "bm25_after_delete": q.ORACLE["bm25_fts_topk"].replace("FROM chunks WHERE text IS NOT NULL", "FROM chunks WHERE text IS NOT NULL AND content_type IS DISTINCT FROM 'table'"),
    "vector_store_round_trip": "WITH " + _C + " SELECT count(*) AS n, count(DISTINCT gr_id) AS n_documents, 64 AS least, 64 AS most FROM chunks WHERE text IS NOT NULL",
    "alignment": "WITH " + _C + f" SELECT count(*) AS n, 1.0::DOUBLE AS worst FROM chunks WHERE text IS NOT NULL AND len({q.tokens('text')}) > 0",
    "retrieve_facets": "WITH " + q._TEXTS + ", " + q._DENSE + """, ok AS (SELECT row_id FROM crow WHERE doc_id IN (SELECT doc_id FROM docs WHERE date >= '2010-01-01' AND language = 'mr')),
        pairs2 AS (SELECT * FROM pairs WHERE query_id IN (SELECT query_id FROM qu)), """ + q.dense(60, "row_id IN (SELECT row_id FROM ok) AND query_id IN (SELECT query_id FROM qu)") + ", " + q.bm25(80, name="s8") + """,
        sp AS (SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)::INT AS rank FROM (SELECT query_id, row_id, score FROM s8 WHERE row_id IN (SELECT row_id FROM ok)) QUALIFY rank <= 20), """
        + q.fused() + """, cp AS (SELECT fu.query_id, row_id, content_type FROM fu JOIN crow USING (row_id) WHERE fused_rank <= 120 QUALIFY row_number() OVER (PARTITION BY fu.query_id, doc_id ORDER BY fused_rank) <= 2),
        pool AS (SELECT cp.query_id, cp.row_id, content_type, score FROM cp LEFT JOIN pairs p ON p.query_id = cp.query_id AND p.row_id = cp.row_id AND p.row_id IN (SELECT row_id FROM ok)), """ + _GATE,
    "retrieve_flat": "WITH " + q._TEXTS + ", " + q._DENSE + """, px AS (SELECT p.query_id, p.row_id, p.score, content_type FROM pairs p JOIN crow USING (row_id) WHERE content_type IN ('text', 'table') AND query_id IN (SELECT query_id FROM qu)),
        md AS (SELECT * FROM px QUALIFY row_number() OVER (PARTITION BY query_id, content_type ORDER BY score DESC, row_id) <= CASE content_type WHEN 'text' THEN 20 ELSE 10 END),
        dn AS (SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)::INT AS rank FROM md), """ + q.bm25(20, "okapi") + ", " + q.fused() + """,
        pool AS (SELECT fu.query_id, fu.row_id, content_type, p.score FROM fu JOIN crow USING (row_id) LEFT JOIN pairs p ON p.query_id = fu.query_id AND p.row_id = fu.row_id), """ + _GATE,
    "answers": _ANSWERED + f""" SELECT ja.query_id, md5(CASE WHEN abstained OR answer IS NULL THEN CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'उपलब्ध आदेशांमध्ये या प्रश्नाचे उत्तर नाही.' ELSE 'The orders at hand do not cover this question.' END ELSE answer END) AS digest,
        CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'mr' ELSE 'en' END AS language, abstained, low_confidence, CASE WHEN abstained THEN 0 ELSE coalesce(n_blocks, 0) END::INT AS n_blocks, CASE WHEN abstained THEN 0 ELSE coalesce(dropped, 0) END::BIGINT AS dropped,
        CASE WHEN abstained THEN '' ELSE array_to_string(list_filter({_CITED}, lambda x: x BETWEEN 1 AND n_blocks), ',') END AS valid, CASE WHEN abstained THEN '' ELSE array_to_string(list_filter({_CITED}, lambda x: x NOT BETWEEN 1 AND n_blocks), ',') END AS phantom
        FROM ja LEFT JOIN an USING (query_id) LEFT JOIN dr USING (query_id)""",
    "answer_sources": _ANSWERED + f""", v AS (SELECT query_id, unnest(list_filter({_CITED}, lambda x: x BETWEEN 1 AND n_blocks)) AS block_no FROM an JOIN ja USING (query_id) WHERE NOT abstained)
        SELECT v.query_id, v.block_no, tr.row_id, doc_id FROM v JOIN tr ON tr.query_id = v.query_id AND tr.block_no = v.block_no JOIN crow ON crow.row_id = tr.row_id""",
    "chat_prompts_compact": _chat_sql(1.2, True),
    "chat_prompts_full": _chat_sql(2.0, False),
    "questions_rewritten": "WITH " + _TURNS + """, l AS (SELECT query_id, arg_min(content, back) AS e FROM t WHERE back > 1 AND role = 'user' GROUP BY query_id)
        SELECT t.query_id, md5(CASE WHEN e IS NULL THEN content ELSE e || ' ' || content END) AS digest FROM t LEFT JOIN l ON l.query_id = t.query_id WHERE back = 1""",
    "summary_blocks": _D + ", " + _C + f""", s0 AS (SELECT gr_id AS doc_id, faiss_id AS row_id, row_number() OVER w AS block_no, sum({q.estimate('text', 2.0)}) OVER w AS spent FROM (SELECT faiss_id, gr_id, chunk_index, text FROM chunks)
          WHERE text IS NOT NULL AND gr_id IN (SELECT doc_id FROM docs WHERE doc_id LIKE '%00') WINDOW w AS (PARTITION BY gr_id ORDER BY chunk_index NULLS FIRST, faiss_id)),
        s1 AS (SELECT *, block_no = 1 OR spent <= 1500 AS kept FROM s0), s2 AS (SELECT *, sum(CASE WHEN kept THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id)::BIGINT AS dropped FROM s1)
        SELECT doc_id AS query_id, doc_id, row_id, block_no::INT AS block_no, dropped FROM s2 WHERE kept""",
    "comparison_blocks": "WITH " + _C + ", " + _E + f""", p AS (SELECT DISTINCT src_id, dst_id FROM edges WHERE kind = 'supersedes' AND dst_id IS NOT NULL AND src_id <> dst_id), sd AS (SELECT src_id || '/' || dst_id AS query_id, src_id AS doc_id, 0 AS side FROM p UNION ALL SELECT src_id || '/' || dst_id, dst_id, 1 FROM p),
        x AS (SELECT query_id, doc_id, side, faiss_id AS row_id, chunk_index, text FROM sd JOIN chunks ON gr_id = doc_id WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, side ORDER BY chunk_index NULLS FIRST, faiss_id) <= 6),
        s0 AS (SELECT *, row_number() OVER w AS block_no, sum({q.estimate('text', 2.0)}) OVER w AS spent FROM x WINDOW w AS (PARTITION BY query_id ORDER BY side, chunk_index NULLS FIRST, row_id)),
        s1 AS (SELECT *, block_no = 1 OR spent <= 3000 AS kept FROM s0), s2 AS (SELECT *, sum(CASE WHEN kept THEN 0 ELSE 1 END) OVER (PARTITION BY query_id)::BIGINT AS dropped FROM s1)
        SELECT query_id, doc_id, row_id, block_no::INT AS block_no, dropped FROM s2 WHERE kept""",
    "health": _D + ", " + _C + " SELECT CASE WHEN (SELECT count(*) FROM chunks) > 0 THEN 'ok' ELSE 'loading' END AS status, count(*) AS documents, count(DISTINCT department) AS departments, (SELECT count(*) FROM chunks) AS indexed FROM docs",
    "conversation_appended": """WITH n AS (SELECT conversation_id, count(DISTINCT id) AS n FROM messages GROUP BY 1)
        SELECT 'new' AS id, 'u002' AS user_id, 1::BIGINT AS n_messages UNION ALL SELECT DISTINCT id, user_id, n FROM conversations JOIN n ON conversation_id = id JOIN (SELECT DISTINCT id AS i2, user_id AS u2, title, created_at FROM conversations) z ON i2 = id AND u2 IS NOT DISTINCT FROM user_id WHERE n > 8""",
    "role_rules": "SELECT DISTINCT id, coalesce(role IN ('admin'), FALSE) AS may_audit, CASE WHEN role IN ('admin', 'officer') THEN 'mr' ELSE 'auto' END AS language FROM users",
    "answer_latency": """WITH m AS (SELECT DISTINCT id, conversation_id, lower(trim(role)) AS role, created_at, length(content) AS n FROM messages WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL),
        s AS (SELECT *, lag(created_at) OVER w AS b, lag(role) OVER w AS asked FROM m WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, id NULLS FIRST, role NULLS FIRST, n NULLS FIRST)),
        x AS (SELECT CASE WHEN n > 100 THEN 'long' ELSE 'short' END AS stage, round(created_at - b, 3) AS sec FROM s WHERE role = 'assistant' AND asked = 'user')
        SELECT stage, count(*) AS n, round(quantile_cont(sec, 0.5), 3) AS p50, round(max(sec), 3) AS longest, count(*) FILTER (sec > 10) AS n_slow FROM x GROUP BY stage""",
    "hit_by_containment": q._SCORED + """, hy AS (SELECT rk.query_id, rk.rank, concat_ws(' ', gr_number, docs.doc_id) AS hay FROM rk JOIN docs ON docs.doc_id = rk.doc_id),
        ex AS (SELECT DISTINCT rel.query_id, gr_number AS name FROM rel JOIN docs ON docs.doc_id = rel.doc_id WHERE gr_number IS NOT NULL)
        SELECT ex.query_id, min(rank) AS "top" FROM ex LEFT JOIN hy ON hy.query_id = ex.query_id AND name <> '' AND contains(hay, name) GROUP BY ex.query_id""",
    "demo_verification": q._SCORED + """, hy AS (SELECT rk.query_id, rk.score, concat_ws(' ', gr_number, docs.doc_id) AS hay FROM rk JOIN docs ON docs.doc_id = rk.doc_id WHERE rk.rank = 1),
        ex AS (SELECT rel.query_id, rel.doc_id AS name, date IS NULL AS outside FROM rel JOIN docs ON docs.doc_id = rel.doc_id WHERE rel.query_id IN (SELECT query_id FROM qu))
        SELECT ex.query_id, CASE WHEN outside THEN coalesce(score < 20, TRUE) ELSE coalesce(contains(hay, name), FALSE) END AS passed FROM ex LEFT JOIN hy ON hy.query_id = ex.query_id""",
}
