"""Queries of the register's own operators, each with its SQL.

Every query runs over its whole tables.  Searches take the rows whose id is
divisible by 100 as queries, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from daftar.functions import text as tx
from daftar.functions.metadata import extract, fields
from daftar.functions.vectors import dot
from daftar.operators import catalog, chunking, citations, evaluation, fusion, grounding, integrity, portal, search, tables
from daftar.session import table
from daftar.sources.register import pieces

K = 10


def docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Orders once each, with the columns asked for; only those are read."""
    needed = list(dict.fromkeys(["doc_id", "ingested_at", "title", *columns]))
    stored = table(spark, d, "gr_documents")
    if "text" not in needed:
        return citations.latest(stored.select(*needed))
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.row_index")).alias("__at")
    return citations.latest_in_place(stored.select(*needed, place), "doc_id", "__at").select(*needed)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Stored pieces once each."""
    return table(spark, d, "gr_chunks").where("faiss_id is not null").dropDuplicates(["faiss_id"])


def edges(spark: SparkSession, d: str) -> DataFrame:
    return citations.stored_edges(table(spark, d, "gr_edges"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), "label")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), "vec")


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where("text is not null").select(F.col("faiss_id").alias("row_id"), F.col("gr_id").alias("doc_id"), "content_type", "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The title of a piece's order as the question, for the pieces whose id is divisible by 100."""
    titles = docs(spark, d).select("doc_id", "title").where("title is not null")
    return chunks(spark, d).where("faiss_id % 100 = 0").join(titles, F.col("gr_id") == F.col("doc_id")).select(F.col("faiss_id").alias("query_id"), F.col("title").alias("text"))


# --- texts ---------------------------------------------------------------


def tokenize_counts(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", tx.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


def term_document_frequency(spark, d):
    return search.statistics(chunk_rows(spark, d))[0]


def canonical_numbers(spark, d):
    n = table(spark, d, "gr_edges").select(F.col("dst_number").alias("number")).union(table(spark, d, "gr_documents").select("gr_number")).where("number is not null").distinct()
    return n.select("number", tx.canonical_number(F.col("number")).alias("canon"))


def language_detect(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.script_language(F.col("text")).alias("language"))


def token_estimate(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.token_estimate(F.col("text")).alias("full"), tx.token_estimate(F.col("text"), 1.2).alias("local"))


def categories(spark, d):
    return docs(spark, d, "text").where("text is not null").select("doc_id", tx.category(F.col("text")).alias("category"))


def date_from_id(spark, d):
    return table(spark, d, "gr_documents").select("doc_id").distinct().select("doc_id", tx.date_from_id(F.col("doc_id")).alias("day"))


def number_shape(spark, d):
    n = table(spark, d, "gr_edges").select("dst_number").where("dst_number is not null").distinct()
    return n.select("dst_number", tx.looks_like_number(F.col("dst_number")).alias("is_number"))


def short_titles(spark, d):
    return table(spark, d, "conversations").select("id", "title").distinct().select("id", tx.short_title(F.col("title")).alias("short_title"))


# --- pieces and tables ---------------------------------------------------


def page_split(spark, d):
    p = chunking.pages(docs(spark, d, "text").select("doc_id", "text"), "text")
    return p.select("doc_id", "page_pos", "page_no", F.size(tx.words(F.col("page_text"))).alias("n_words"))


def chunk_windows(spark, d):
    w = chunking.windows(docs(spark, d, "text").select("doc_id", "text"), "text")
    return w.select("doc_id", "chunk_index", "page_start", "page_end", "n_words", F.md5("chunk_text").alias("digest"))


def chunk_counts(spark, d):
    return chunking.windows(docs(spark, d, "text").select("doc_id", "text"), "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def table_runs(spark, d):
    return tables.runs(docs(spark, d, "text"), "doc_id", "text")


def table_sentences(spark, d):
    return tables.sentences(docs(spark, d, "text"), "doc_id", "text")


def table_chunk_packing(spark, d):
    return tables.table_chunks(docs(spark, d, "text"), "doc_id", "text", 20)


def stored_pieces(spark, d):
    """Every text in its stored form: word windows of its prose, then the chunks of its tables, numbered through."""
    p = tables.pieces(docs(spark, d, "text"), "doc_id", "text")
    return p.select("doc_id", "chunk_index", "content_type", "page_start", "page_end", F.md5("chunk_text").alias("digest"))


def prose_without_tables(spark, d):
    return tables.prose(docs(spark, d, "text"), "doc_id", "text").select("doc_id", F.length("prose_text").alias("n_chars"), F.md5("prose_text").alias("digest"))


# --- search --------------------------------------------------------------


def dense_topk(spark, d):
    return search.dense_topk(vectors(spark, d), vector_queries(spark, d), K)


def dense_topk_filtered(spark, d):
    return search.dense_topk(vectors(spark, d).where("label = 3"), vector_queries(spark, d), K)


def dense_topk_by_modality(spark, d):
    """Texts and tables are searched apart and merged by score."""
    rows = vectors(spark, d).join(chunks(spark, d).select(F.col("faiss_id").alias("row_id"), "content_type"), "row_id")
    text = search.dense_topk(rows.where("content_type = 'text'"), vector_queries(spark, d), 20)
    tabs = search.dense_topk(rows.where("content_type = 'table'"), vector_queries(spark, d), 10)
    both = text.withColumn("modality", F.lit("text")).unionByName(tabs.withColumn("modality", F.lit("table")))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "row_id")))


def bm25_fts_topk(spark, d):
    return search.bm25_topk(chunk_rows(spark, d), questions(spark, d), K)


def bm25_okapi_topk(spark, d):
    return search.bm25_topk(chunk_rows(spark, d), questions(spark, d), K, "okapi")


def bm25_filtered_overfetch(spark, d):
    """Over-fetched by four, then filtered to tables, then cut."""
    hits = search.bm25_topk(chunk_rows(spark, d), questions(spark, d), 4 * K)
    kept = hits.drop("rank").join(chunk_rows(spark, d).where("content_type = 'table'").select("row_id"), "row_id", "left_semi")
    return search.best(kept, ["query_id"], [F.desc("score"), "row_id"], K).select("query_id", "row_id", "score", "rank")


def dense_score_for_id(spark, d):
    """The exact cosine of the first sparse hits of each question that has a vector."""
    hits = search.bm25_topk(chunk_rows(spark, d), questions(spark, d), K).select("query_id", "row_id")
    return search.scores_for(hits, vectors(spark, d), vector_queries(spark, d)).select("query_id", "row_id", "cosine")


def related_documents(spark, d):
    """The five other orders whose pieces are nearest to each query vector's piece."""
    of = chunks(spark, d).select(F.col("faiss_id").alias("row_id"), F.col("gr_id").alias("doc_id"))
    hits = search.dense_topk(vectors(spark, d), vector_queries(spark, d), 5 * 6).join(of, "row_id")
    own = of.select(F.col("row_id").alias("query_id"), F.col("doc_id").alias("own"))
    other = hits.join(own, "query_id", "left").where("own is null or doc_id <> own").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return search.best(other, ["query_id"], [F.desc("score"), "doc_id"], 5).select("query_id", "doc_id", F.round("score", 3).alias("score"), "rank")


def ann_cell_recall(spark, d):
    """Recall of the cell search against the exact one."""
    return evaluation.recall(search.cell_topk(vectors(spark, d), vector_queries(spark, d), K), dense_topk(spark, d), K)


# --- fusion --------------------------------------------------------------


def _lists(spark, d):
    return search.dense_topk(vectors(spark, d), vector_queries(spark, d), 60), search.bm25_topk(chunk_rows(spark, d), questions(spark, d), 20)


def rrf_fuse(spark, d):
    return fusion.reciprocal_rank(*_lists(spark, d))


def per_document_cap(spark, d):
    of = chunks(spark, d).select(F.col("faiss_id").alias("row_id"), F.col("gr_id").alias("doc_id"))
    pool = rrf_fuse(spark, d).where("fused_rank <= 120").join(of, "row_id")
    return fusion.cap_per_document(pool).select("query_id", "row_id", "doc_id", "fused_rank")


def _dense_hits(spark, d):
    return search.dense_topk(vectors(spark, d), vector_queries(spark, d), 60).select("query_id", "row_id", "score")


def gate_and_floor(spark, d):
    return fusion.gate(_dense_hits(spark, d), vector_queries(spark, d), F.col("score") >= 0.55)


def empty_filter_abstains(spark, d):
    none = search.dense_topk(vectors(spark, d).where("label = -1"), vector_queries(spark, d), K).select("query_id", "row_id", "score")
    return fusion.gate(none, vector_queries(spark, d), F.col("score") >= 0.55)


def rerank_lexical(spark, d):
    """The first 40 sparse hits in the order of the default scorer."""
    rows, q = chunk_rows(spark, d), questions(spark, d)
    terms, size = search.statistics(rows)
    hits = search.bm25_topk(rows, q, 40).select("query_id", "row_id")
    scored = fusion.lexical_scores(hits, rows, q, terms, size.first()["n_rows"])
    return scored.select("query_id", "row_id", "rerank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank"), "row_id")).alias("rank"))


def merge_user_uploads(spark, d):
    """Labels 0-4 as the register and 5-9 as uploads, gated apart and merged."""
    q = vector_queries(spark, d)
    part = lambda c: fusion.gate(search.dense_topk(vectors(spark, d).where(c), q, 20).select("query_id", "row_id", "score"), q, F.col("score") >= 0.3).where("row_id is not null")
    return fusion.merge_extra(part("label < 5"), part("label >= 5"))


def upload_hybrid_no_floor(spark, d):
    """Fused hits of uploads that pass the cosine gate, at most six, no floor."""
    fused = fusion.reciprocal_rank(search.dense_topk(vectors(spark, d), vector_queries(spark, d), 20), search.bm25_topk(chunk_rows(spark, d), questions(spark, d), 20, "okapi"))
    scored = search.scores_for(fused.select("query_id", "row_id", "fused_rank"), vectors(spark, d), vector_queries(spark, d)).where("cosine >= 0.3")
    return search.best(scored, ["query_id"], ["fused_rank"], 6).select("query_id", "row_id", "cosine", "rank")


def hybrid_answer_context(spark, d):
    """Questions to numbered evidence: dense and sparse lists fused, capped per order, reranked, gated and cut to the budget."""
    rows, q = chunk_rows(spark, d), questions(spark, d)
    terms, size = search.statistics(rows)
    pool = search.best(per_document_cap(spark, d), ["query_id"], ["fused_rank"], 40, "place")
    scored = fusion.lexical_scores(pool, rows, q, terms, size.first()["n_rows"]).select("query_id", "row_id", F.col("rerank").alias("score"))
    kept = fusion.gate(scored, q, F.col("score") >= 0.5).where("row_id is not null").join(rows, "row_id")
    return grounding.trim(kept, 3000).select("query_id", "row_id", "block_no", "score", "low_confidence", "dropped")


def header_metadata(spark, d):
    """What the header of every text says of its order, but for its references."""
    return fields(docs(spark, d, "text").select("doc_id", "text"), "doc_id", "text").drop("text")


def header_references(spark, d):
    """The references that every text prints, in order."""
    m = extract(docs(spark, d, "text").select("doc_id", "text"), "doc_id", "text")
    return m.select("doc_id", "supersedes", F.posexplode("refs").alias("pos", "ref")).select("doc_id", "pos", "ref.number", "ref.date", "supersedes")


def piece_ids(spark, d):
    """New word-window pieces with dense ids."""
    return pieces(docs(spark, d, "text")).select("faiss_id", "gr_id", "chunk_index")


# --- graph ---------------------------------------------------------------


def edges_build(spark, d):
    return citations.build_edges(docs(spark, d, "gr_number", "date", "refs", "supersedes"))


def edge_counts(spark, d):
    return citations.counts(edges_build(spark, d))


def edges_outgoing(spark, d):
    return edges(spark, d).groupBy("src_id").agg(F.count(F.lit(1)).alias("n_out"), F.count("dst_id").alias("n_resolved"))


def edges_incoming(spark, d):
    return edges(spark, d).where("dst_id is not null").groupBy("dst_id").agg(F.count(F.lit(1)).alias("n_in"))


def graph_stats(spark, d):
    e = edges(spark, d)
    return e.groupBy("resolution", "kind").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src_id").alias("n_sources"))


def dangling_references(spark, d):
    return edges(spark, d).where("resolution = 'dangling'").groupBy("dst_canon").agg(F.count(F.lit(1)).alias("n"), F.min("dst_number").alias("printed"))


def supersede_chain(spark, d):
    return citations.chains(docs(spark, d, "date"), edges(spark, d))


def _roots(spark, d):
    """Orders whose id is divisible by 100 as a number."""
    return docs(spark, d).where("doc_id rlike '00$'").select(F.col("doc_id").alias("root_id"))


def neighbourhood_depth1(spark, d):
    return citations.neighbourhood(edges(spark, d), _roots(spark, d), 1)


def neighbourhood_depth2(spark, d):
    return citations.neighbourhood(edges(spark, d), _roots(spark, d), 2)


def supersede_warnings(spark, d):
    return citations.warnings(docs(spark, d, "gr_number", "date"), supersede_chain(spark, d))


def citation_presence(spark, d):
    """Cited numbers and whether the register holds an order of that number."""
    cited = edges(spark, d).select("dst_canon").where("dst_canon is not null").groupBy("dst_canon").agg(F.count(F.lit(1)).alias("n"))
    held = docs(spark, d, "gr_number").select(tx.canonical_number(F.col("gr_number")).alias("dst_canon"), "doc_id").where("dst_canon is not null").groupBy("dst_canon").agg(F.min("doc_id").alias("doc_id"))
    return cited.join(held, "dst_canon", "left")


def superseding_substring(spark, d):
    """Orders that claim to replace the numbers of the orders whose id ends in 00, by containment."""
    asked = docs(spark, d, "gr_number").where("doc_id rlike '00$' and gr_number is not null").select(F.col("gr_number").alias("asked"))
    return citations.claimed_by(docs(spark, d, "supersedes", "refs"), asked)


def canonical_backfill(spark, d):
    return citations.backfilled(docs(spark, d, "gr_number", "gr_number_canon")).select("doc_id", "gr_number_canon")


def reference_reparse(spark, d):
    return citations.reference_changes(docs(spark, d, "refs"), extract(docs(spark, d, "text").select("doc_id", "text"), "doc_id", "text"))


def neighbour_arcs(spark, d):
    """Direct neighbours of the roots by role, the newest seven of each."""
    e, roots = edges(spark, d).where("dst_id is not null and src_id <> dst_id").select("src_id", "dst_id", "kind").distinct(), _roots(spark, d)
    into = e.join(roots, F.col("dst_id") == F.col("root_id")).select("root_id", F.col("src_id").alias("node_id"), F.when(F.col("kind") == "supersedes", "newer").otherwise("older").alias("role"))
    out = e.join(roots, F.col("src_id") == F.col("root_id")).select("root_id", F.col("dst_id").alias("node_id"), F.lit("older").alias("role"))
    one = into.unionByName(out).groupBy("root_id", "node_id").agg(F.min("role").alias("role"))
    dated = one.join(docs(spark, d, "date").select(F.col("doc_id").alias("node_id"), "date"), "node_id")
    return citations.arcs(dated).select("root_id", "role", "node_id", "place", "hidden")


# --- register ------------------------------------------------------------


def list_documents_page(spark, d):
    return catalog.listing(docs(spark, d, "gr_number", "date"), "the", limit=50, offset=50).select("doc_id", "gr_number", "date", "title")


def list_documents_total(spark, d):
    return docs(spark, d, "gr_number").where(catalog.matches("the", "title", "gr_number", "doc_id")).agg(F.count(F.lit(1)).alias("total"))


def find_document(spark, d):
    asked = table(spark, d, "gr_edges").where("edge_id % 100 = 0 and dst_number is not null").select(F.col("dst_number").alias("asked")).distinct()
    return catalog.find(docs(spark, d, "gr_number"), asked)


def document_chunks(spark, d):
    return chunks(spark, d).select(F.col("gr_id").alias("doc_id"), "chunk_index", "faiss_id", "content_type", F.lit(1.0).alias("score"))


def corpus_stats(spark, d):
    return catalog.totals(docs(spark, d, "department", "date"), chunks(spark, d))


def stats_by_department(spark, d):
    return catalog.by_department(docs(spark, d, "department"))


def facet_filter_ids(spark, d):
    f = catalog.facets(date_from="2015-01-01", date_to="2020-12-31", language="mr")
    return chunks(spark, d).select("faiss_id", F.col("gr_id").alias("doc_id")).join(docs(spark, d, "date", "language").where(f).select("doc_id"), "doc_id", "left_semi").select("faiss_id")


def document_text_joined(spark, d):
    return catalog.joined_text(chunks(spark, d)).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


# --- answers -------------------------------------------------------------


def _evidence(spark, d):
    hits = search.bm25_topk(chunk_rows(spark, d), questions(spark, d), 12)
    return hits.join(chunk_rows(spark, d), "row_id")


def context_trim_budget(spark, d):
    return grounding.trim(_evidence(spark, d), 3000).select("query_id", "row_id", "block_no", "spent", "dropped")


def format_blocks(spark, d):
    meta = docs(spark, d, "gr_number", "date").select("doc_id", "title", "gr_number", "date")
    c = chunks(spark, d).select(F.col("gr_id").alias("doc_id"), "faiss_id", "chunk_index", "page_start", "page_end", "content_type", "text").join(meta, "doc_id")
    block = grounding.block(F.col("chunk_index") + 1, F.col("title"), F.col("gr_number"), F.col("date"), F.col("page_start"), F.col("page_end"), F.col("content_type"), F.col("text"))
    return c.select("faiss_id", F.md5(block).alias("digest"), F.length(block).alias("n_chars"))


def _user_turns(spark, d):
    m = table(spark, d, "messages").where("conversation_id is not null and content is not null").distinct()
    return m.withColumn("turn_no", F.row_number().over(W.partitionBy("conversation_id").orderBy("created_at", "id")))


def history_window_budget(spark, d):
    return grounding.history(_user_turns(spark, d), 4, 800).select("conversation_id", "id", "back", "spent")


def recency_window(spark, d):
    m = table(spark, d, "messages").where("conversation_id is not null").select("id", "conversation_id", "created_at").distinct()
    return catalog.recent(m, "conversation_id", [F.desc("created_at"), F.desc("id")], 6).select("conversation_id", "id", "place")


def _answers(spark, d):
    return table(spark, d, "messages").where("lower(trim(role)) = 'assistant' and content is not null").select("id", "content").distinct()


def _sourced_answers(spark, d):
    """Answers with their own numbered sources, and the citations of them."""
    m = table(spark, d, "messages").where("lower(trim(role)) = 'assistant' and content is not null").select("id", "content", "sources").distinct()
    a = m.select("id", "content", grounding.numbered_sources(F.col("sources")).alias("blocks"))
    valid, phantom = grounding.cited_sources(F.col("content"), F.col("blocks"))
    return a.withColumn("valid", valid).withColumn("phantom", phantom)


def source_citations(spark, d):
    """The numbers an answer cites: those of the sources it lists, and those of none."""
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _sourced_answers(spark, d).select("id", join("valid"), join("phantom"))


def source_citations_resolved(spark, d):
    """Each valid citation of an answer with the order number that the answer's own sources give it."""
    cited = _sourced_answers(spark, d).select("id", F.explode(F.filter("blocks", lambda s: F.array_contains("valid", s["n"]))).alias("s"))
    return cited.select("id", F.col("s.n").alias("block_no"), F.col("s.gr_number").alias("gr_number")).distinct()


def hard_abstention(spark, d):
    top = _dense_hits(spark, d).where("row_id <> query_id").groupBy("query_id").agg(F.max("score").alias("top"))
    return top.select("query_id", "top", grounding.abstains(F.col("top"), 0.30).alias("abstains"))


def abstain_language(spark, d):
    m = table(spark, d, "messages").where("content is not null").select("id", "content").distinct()
    return m.select("id", grounding.refusal_language(F.lit("auto"), F.col("content")).alias("language"))


def prompt_messages(spark, d):
    kept = grounding.trim(_evidence(spark, d), 1000).select("query_id", "block_no", F.concat(F.lit("["), F.col("block_no").cast("string"), F.lit("] "), "text").alias("block"))
    p = grounding.prompts(kept, questions(spark, d), "Answer only from the numbered blocks.", "Cite the blocks you use.")
    return p.select("query_id", F.size("messages").alias("n_messages"), F.md5(F.get("messages", F.lit(1))["content"]).alias("digest"))


def prompt_sizes(spark, d):
    kept = grounding.trim(_evidence(spark, d), 1000).select("query_id", "block_no", "text").withColumnRenamed("text", "block")
    p = grounding.prompts(kept, questions(spark, d), "Answer only from the numbered blocks.", "Cite the blocks you use.")
    return grounding.over_context(p, 1500, 300)


def default_answers(spark, d):
    """The default answerer over the kept evidence."""
    kept = grounding.trim(_evidence(spark, d), 1000).select("query_id", "block_no", "text")
    return grounding.first_sentences(kept).select("query_id", F.md5("answer").alias("digest"), F.size(grounding.cited(F.col("answer"), F.lit(12))[0]).alias("n_cited"))


# --- portal --------------------------------------------------------------


def conversation_list(spark, d):
    return portal.conversation_counts(table(spark, d, "conversations"), table(spark, d, "messages"))


def own_conversations(spark, d):
    return portal.owned(table(spark, d, "conversations"), "u002").select("id", "user_id").distinct()


def active_user_lookup(spark, d):
    u = table(spark, d, "users")
    return portal.active_users(u, u.select("username")).select("id", "username", "role")


def conversation_cascade(spark, d):
    """What is left when the conversations of nobody are deleted."""
    c, m = table(spark, d, "conversations"), table(spark, d, "messages")
    left, said = portal.without(c, m, c.where("user_id is null"))
    return left.agg(F.countDistinct("id").alias("n_conversations")).crossJoin(said.agg(F.countDistinct("id").alias("n_messages")))  # one row each


def message_sources(spark, d):
    """Sources and warnings of every message, read from their JSON."""
    m = table(spark, d, "messages").select("id", "sources", "warnings").distinct()
    n = lambda c: F.size(F.coalesce(F.from_json(c, "array<string>"), F.array()))
    return m.groupBy("id").agg(F.max(n("sources")).alias("n_sources"), F.max(n("warnings")).alias("n_warnings"))


def daily_token_quota(spark, d):
    q = portal.daily_use(table(spark, d, "events"), 500.0)
    return q.select("user_id", F.col("day").cast("string").alias("day"), F.round("used", 4).alias("used"), F.round("remaining", 4).alias("remaining"))


def audit_latest(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", "event_type")


def feedback_summary(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def token_bucket(spark, d):
    return portal.token_bucket(table(spark, d, "events")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("allowed"), 1)).alias("n_allowed"))


# --- evaluation ----------------------------------------------------------


def _ranked(spark, d):
    return search.bm25_topk(chunk_rows(spark, d), questions(spark, d), K).join(chunk_rows(spark, d).select("row_id", "doc_id"), "row_id")


def _relevant(spark, d):
    return chunks(spark, d).where("faiss_id % 100 = 0").select(F.col("faiss_id").alias("query_id"), F.col("gr_id").alias("doc_id"))


def hit_at_k_mrr(spark, d):
    return evaluation.ranking_quality(_ranked(spark, d), _relevant(spark, d), questions(spark, d))


def _scored(spark, d):
    """The best relevant and the best other score of each question."""
    hits = _ranked(spark, d).join(_relevant(spark, d).withColumn("good", F.lit(True)), ["query_id", "doc_id"], "left")
    kind = F.when(F.col("good"), "keep").otherwise("reject")
    return hits.groupBy("query_id", kind.alias("kind")).agg(F.max("score").alias("score"))


def score_separation(spark, d):
    return evaluation.separation(_scored(spark, d))


def suggested_threshold(spark, d):
    return evaluation.threshold(_scored(spark, d))


def _source_log(spark, d):
    """Answers by their own sources. The tables name no expected order: an answer with sources counts as in the corpus, and as right if it cites the first of them."""
    a = _sourced_answers(spark, d).select("id", F.col("content").alias("answer"), F.col("valid").alias("sources"), "phantom", (F.size("blocks") > 0).alias("in_corpus"), F.try_element_at("blocks", F.lit(1))["n"].alias("first"))
    return evaluation.answer_flags(a.withColumn("correct", F.coalesce(F.array_contains("sources", F.col("first")), F.lit(False))))


def source_answer_metrics(spark, d):
    """How many answers cite, are grounded, right, degenerate or refusals."""
    n = lambda c, a: F.count(F.when(F.col(c), 1)).alias(a)
    return _source_log(spark, d).groupBy("in_corpus").agg(F.count(F.lit(1)).alias("n"), n("cited", "cited"), n("grounded", "grounded"), n("correct", "correct"), n("degenerate", "degenerate"), n("refused", "refused"))


def source_failure_labels(spark, d):
    """What is wrong with the answers."""
    return _source_log(spark, d).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# --- integrity -----------------------------------------------------------


def dense_id_space(spark, d):
    return integrity.id_space(chunks(spark, d), "faiss_id")


def orphan_chunks(spark, d):
    return integrity.orphans(chunks(spark, d).select("faiss_id", "gr_id"), table(spark, d, "gr_documents"), "gr_id", "doc_id").select("faiss_id", "gr_id")


def empty_documents(spark, d):
    return integrity.orphans(docs(spark, d).select("doc_id"), chunks(spark, d), "doc_id", "gr_id")


def upsert_keep_latest(spark, d):
    return docs(spark, d, "gr_number", "date").select("doc_id", "gr_number", "date", "title", "ingested_at")


def resume_anti_join(spark, d):
    """Orders without a stored piece: what a resumed run has to do."""
    return integrity.missing(docs(spark, d).select("doc_id"), chunks(spark, d).select(F.col("gr_id").alias("doc_id")), "doc_id")


def truncate_from_id(spark, d):
    kept, left = integrity.cut_back(chunks(spark, d), docs(spark, d), 1000)
    return kept.agg(F.count(F.lit(1)).alias("n_chunks")).crossJoin(left.agg(F.count(F.lit(1)).alias("n_documents")))  # one row each


_NAMES = """source_citations source_citations_resolved source_answer_metrics source_failure_labels superseding_substring canonical_backfill reference_reparse neighbour_arcs prompt_sizes default_answers own_conversations active_user_lookup
conversation_cascade message_sources hybrid_answer_context header_metadata header_references piece_ids tokenize_counts term_document_frequency canonical_numbers language_detect token_estimate categories date_from_id number_shape
short_titles page_split chunk_windows chunk_counts table_runs table_sentences table_chunk_packing stored_pieces prose_without_tables dense_topk
dense_topk_filtered dense_topk_by_modality dense_score_for_id bm25_fts_topk bm25_okapi_topk bm25_filtered_overfetch related_documents
ann_cell_recall rrf_fuse per_document_cap gate_and_floor empty_filter_abstains rerank_lexical merge_user_uploads upload_hybrid_no_floor
edges_build edge_counts edges_outgoing edges_incoming graph_stats dangling_references supersede_chain neighbourhood_depth1
neighbourhood_depth2 supersede_warnings citation_presence list_documents_page
list_documents_total find_document document_chunks corpus_stats stats_by_department facet_filter_ids document_text_joined
context_trim_budget format_blocks history_window_budget recency_window hard_abstention
abstain_language prompt_messages conversation_list daily_token_quota audit_latest feedback_summary token_bucket
hit_at_k_mrr score_separation suggested_threshold dense_id_space orphan_chunks
empty_documents upsert_keep_latest resume_anti_join truncate_from_id"""

QUERIES = {name: globals()[name] for name in _NAMES.split()}

from daftar.plans.register_sql import ORACLE  # noqa: E402
