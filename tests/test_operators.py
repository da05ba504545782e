"""Literal cases of the register's operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from daftar.functions import text as tx
from daftar.operators import chunking, citations, evaluation, fusion, grounding, portal, search, tables
from daftar.plans import register_queries


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<array<string>>' if isinstance(v, list) else 'int'}" for k, v in values.items()))
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "number, want",
    [
        ("संकीर्ण-२०२३/प्र.क्र.४५/तांशि-४", "संकीर्ण2023/प्रक्र45/तांशि4"),
        ("संकीर्ण 2023 / प्र. क्र. ४५ / तांशि ४", "संकीर्ण2023/प्रक्र45/तांशि4"),
        ("GR-123", "gr123"), ("//a//b/", "a/b"), ("", None), (None, None), ("---", None), ("...", None), ("  ", None),
    ],
)
def test_canonical_number(spark, number, want):
    assert one(spark, tx.canonical_number(F.col("x")), x=number) == want


def test_tokenize(spark):
    assert one(spark, tx.tokenize(F.col("x")), x="DTE Admission 2023") == ["dte", "admission", "2023"]
    assert one(spark, tx.tokenize(F.col("x")), x="शासन निर्णय क्रमांक") == ["शासन", "निर्णय", "क्रमांक"]


def test_windows(spark):
    df = spark.createDataFrame([("a", "# Page 1\n" + "w " * 300 + "\n# Page 2\n" + "v " * 300), ("b", "x " * 250), ("c", ""), ("d", None)], "id string, text string")
    got = [(r["id"], r["chunk_index"], r["page_start"], r["page_end"], r["n_words"]) for r in chunking.windows(df, "text").orderBy("id", "chunk_index").collect()]
    assert got == [("a", 0, 1, 1, 250), ("a", 1, 1, 2, 250), ("a", 2, 2, 2, 200), ("b", 0, 1, 1, 250), ("b", 1, 1, 1, 50)]
    with pytest.raises(ValueError):
        chunking.windows(df, "text", 50, 50)


TABLE = "Before.\n| H1 | H2 |\n|----|----|\n| d1 | d2 |\n| d3 |  |\nAfter.\n| lone | line |"


def test_tables(spark):
    df = spark.createDataFrame([("a", TABLE), ("b", "no table"), ("c", None)], "id string, text string")
    assert [tuple(r) for r in tables.runs(df, "id", "text").collect()] == [("a", 1, 4, 3)]
    assert [r["said"] for r in tables.sentences(df, "id", "text").orderBy("row_no").collect()] == ["In this row: H1 is d1, H2 is d2.", "In this row: H1 is d3."]
    assert {r["id"]: r["prose_text"] for r in tables.prose(df, "id", "text").collect()} == {"a": "Before.\nAfter.\n| lone | line |", "b": "no table"}
    packed = [r["chunk_text"] for r in tables.table_chunks(df, "id", "text", 13).orderBy("chunk_no").collect()]
    assert packed == ["Table: H1 | H2\nIn this row: H1 is d1, H2 is d2.", "Table: H1 | H2\nIn this row: H1 is d3."]


def test_stored_pieces(spark):
    rows = "| H | K |\n|---|---|\n| a | 1 |\n| b | 2 |"
    texts = {"a": f"lost\n# Page 2\nw1 w2 w3\n{rows}\nw4\n# Page 3\n{rows}", "b": "w " * 5, "c": rows, "d": None, "e": "", "f": "| lone | x |", "g": f"{rows}\n# Page 9\nw"}
    df = spark.createDataFrame([(k, v, k) for k, v in texts.items()], "id string, text string, chunk_text string")
    got = {}
    for r in tables.pieces(df, "id", "text", 4, 1).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append((r["chunk_index"], r["content_type"], r["page_start"], r["page_end"], r["chunk_text"]))
    said = [f"Table: H | K\nIn this row: H is {x}, K is {n}." for x, n in (("a", 1), ("b", 2))]
    table = lambda first, page: [(first + i, "table", page, page, s) for i, s in enumerate(said)]
    assert got["a"] == [(0, "text", 2, 2, "w1 w2 w3 w4"), (1, "text", 2, 2, "w4"), *table(2, 2), *table(4, 3)]
    assert got["b"] == [(0, "text", 1, 1, "w w w w"), (1, "text", 1, 1, "w w")] and got["c"] == table(0, 1)
    assert [x[4] for x in got["f"]] == ["| lone | x", "x |"] and got["g"] == [(0, "text", 9, 9, "w")] and not {"d", "e"} & set(got)
    assert tables.table_chunks(df, "id", "text").where("id = 'a'").select("first_line", "page").distinct().count() == 2


def test_lines_are_trimmed_of_blanks_only(spark):
    assert one(spark, tables.signature(F.col("x")), x=[["0a1", " b2 "], ["1c", None]]) == ["0a1", "1c", "b2"]


def test_latest_where_rows_lie(spark):
    rows = [("a", 1, "x", "old", 0), ("a", 2, "x", "new", 1), ("b", None, None, "b", 2), ("a", 2, "x", "new", 3), (None, 9, "z", "none", 4)]
    df = spark.createDataFrame(rows, "doc_id string, ingested_at int, title string, text string, at int")
    assert sorted(tuple(r) for r in citations.latest_in_place(df, "doc_id", "at").select("doc_id", "text").collect()) == [("a", "new"), ("b", "b")]
    assert citations.latest_in_place(df.limit(0), "doc_id", "at").count() == 0


def test_table_rows(spark):
    grid = [["Model", "", ""], ["", "EN-DE", "EN-FR"], ["base", "27", "38"], ["big", "28", "41"]]
    assert one(spark, tables.merge_gapped_header(F.col("x")), x=grid)[0] == ["Model", "EN-DE", "EN-FR"]
    assert one(spark, tables.looks_real(F.col("x")), x=grid) is True
    assert one(spark, tables.looks_real(F.col("x")), x=[["some wordyprose text", "b"], ["c", "d"]]) is False
    assert one(spark, tables.strip_caption(F.col("x")), x=[["Caption", ""], ["h", "k"], ["a", "1"]]) == [["h", "k"], ["a", "1"]]
    assert one(spark, tables.fold_subscripts(F.col("x")), x=[["d d\nmodel ff", "a\nlong wrapped"]]) == [["d_model d_ff", "a long wrapped"]]


def edge_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, gr_number string, date string, refs array<struct<number:string,date:string>>, supersedes boolean")


def test_edges(spark):
    docs = edge_docs(spark, [
        ("a1", "GR-7", "2019-05-04", None, None), ("a2", "GR 7", "2021-11-30", [("GR-7", "2019-05-04")], False), ("a3", "GR-1", None, [("GR-1", None)], True),
        ("b", None, None, [("GR-7", "2021-11-30"), ("GR-GONE", "2010-10-30"), ("GR 7", None), ("---", None)], True),
        ("c", None, None, [("G.R. 7", None)], False), ("d", None, None, [("gr1", None)], None),
    ])
    got = {(r["src_id"], r["dst_number"]): (r["dst_id"], r["kind"], r["resolution"], r["by_date"]) for r in citations.build_edges(docs).collect()}
    assert got == {
        ("a2", "GR-7"): ("a1", "cites", "resolved", False), ("b", "GR-7"): ("a2", "supersedes", "resolved", True), ("b", "GR-GONE"): (None, "supersedes", "dangling", False),
        ("c", "G.R. 7"): (None, "cites", "ambiguous", False), ("d", "gr1"): ("a3", "cites", "resolved", False),
    }


def test_chain_follows_the_newest_and_stops_at_cycles(spark):
    docs = spark.createDataFrame([("a", "2019"), ("b", "2021"), ("c", "2023"), ("old", "2018"), ("x", None), ("y", "2020")], "doc_id string, date string")
    e = [("b", "a"), ("old", "a"), ("c", "b"), ("x", "y"), ("y", "x")]
    edges = spark.createDataFrame([(s, t, "supersedes") for s, t in e], "src_id string, dst_id string, kind string")
    got = {}
    for r in citations.chains(docs, edges).orderBy("doc_id", "hop").collect():
        got.setdefault(r["doc_id"], []).append(r["next_id"])
    assert got == {"a": ["b", "c"], "b": ["c"], "x": ["y"], "y": ["x"]}
    assert citations.chains(docs, edges, 1).count() == 4


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 8))
    v[7] = v[3]  # a tie
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [1.0])], "row_id bigint, vec array<double>")
    q = spark.createDataFrame([(i, v[i].tolist()) for i in (3, 50)], "query_id bigint, vec array<double>")
    got = {(r["query_id"], r["rank"]): r["row_id"] for r in search.dense_topk(rows, q, 5).collect()}
    for i in (3, 50):
        s = np.round(v @ v[i], 6)
        assert [got[i, k + 1] for k in range(5)] == np.lexsort((np.arange(400), -s))[:5].tolist()
    assert search.dense_topk(rows.limit(0), q, 5).count() == 0
    assert search.dense_topk(rows, q.limit(0), 5).count() == 0
    sound = rows.where("row_id < 1000")
    exact = search.dense_topk(sound, q, 5).select("query_id", "row_id", "rank")
    assert search.cell_topk(sound, q, 5, n_cells=6, probes=6).select("query_id", "row_id", "rank").exceptAll(exact).count() == 0
    assert search.cell_topk(sound.limit(0), q, 5).count() == 0


def test_bm25_edge_cases(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, ""), (4, "gamma")], "row_id bigint, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "!!!"), (3, "alpha alpha"), (4, None)], "query_id bigint, text string")
    got = {(r["query_id"], r["row_id"]): r["score"] for r in search.bm25_topk(rows, q, 9).collect()}
    assert set(got) == {(1, 1), (1, 2), (3, 1), (3, 2)} and got[3, 2] == pytest.approx(2 * got[1, 2], abs=1e-6)
    assert search.bm25_topk(rows.limit(0), q, 3).count() == 0


def test_fusion_order(spark):
    ranked = lambda ids: spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids)], "query_id int, row_id bigint, rank int")
    got = [r["row_id"] for r in fusion.reciprocal_rank(ranked([2, 1, 3]), ranked([2, 1, 4])).orderBy("fused_rank").collect()]
    assert got == [2, 1, 3, 4]


def test_gate_keeps_a_floor(spark):
    hits = spark.createDataFrame([(1, i, s) for i, s in enumerate((0.9, 0.8, 0.1))] + [(2, i, 0.0) for i in range(4)], "query_id int, row_id bigint, score double")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = sorted((r["query_id"], r["row_id"], r["low_confidence"]) for r in fusion.gate(hits, q, F.col("score") >= 0.5).collect() if r["row_id"] is not None)
    assert got == [(1, 0, False), (1, 1, False), (2, 0, True), (2, 1, True)]
    assert fusion.gate(hits, q, F.col("score") >= 0.5).where("query_id = 3").first()["low_confidence"] is True


def test_citations_and_budget(spark):
    valid, phantom = grounding.cited(F.col("x"), F.lit(3))
    assert one(spark, valid, x="As in [1] and [3], but [5] and [1]") == [1, 3]
    assert one(spark, phantom, x="As in [1] and [3], but [5]") == [5]
    hits = spark.createDataFrame([(1, 1, "word " * 100), (1, 2, "word " * 100), (2, 1, "word " * 1000)], "query_id int, rank int, text string")
    assert sorted((r["query_id"], r["block_no"], r["dropped"]) for r in grounding.trim(hits, 140).collect()) == [(1, 1, 1), (2, 1, 0)]


def test_refusal(spark):
    df = spark.createDataFrame([(0.006,), (0.946,), (None,)], "s double")
    assert [r[0] for r in df.select(grounding.abstains(F.col("s"))).collect()] == [True, False, True]
    assert [r[0] for r in df.select(grounding.abstains(F.col("s"), 0)).collect()] == [False] * 3


def test_token_bucket(spark):
    ev = spark.sql("select id as event_id, 1 as user_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,if(id < 25, 0, 30)) as ts from range(30)")
    got = [r["allowed"] for r in portal.token_bucket(ev).orderBy("event_id").collect()]
    assert got == [True] * 20 + [False] * 5 + [True] * 5


def test_failure_labels(spark):
    log = spark.createDataFrame([("A long enough answer.", [1], [5], False, True), ("[1]", [1], [], True, True), ("It is not found here at all.", [], [], False, False)], "answer string, sources array<int>, phantom array<int>, correct boolean, in_corpus boolean")
    assert [r["labels"] for r in evaluation.answer_flags(log).collect()] == [["PHANTOM", "WRONG-SOURCE"], ["DEGENERATE"], []]


def test_caption(spark):
    page = "Intro\nTable 2 is cited\nTable 2: Fees for hos-\ntel rooms by\ncategory.\n1 2 3\nmore"
    df = spark.createDataFrame([(page, "Table2:"), (page, "Table 9"), (page, " Figure "), ("Table 2: only\n\nnot this", "Table 2")], "page string, label string")
    assert [r[0] for r in df.select(tables.caption(F.col("page"), F.col("label"))).collect()] == ["Table 2: Fees for hostel rooms by category.", "Table 9", "Figure", "Table 2: only"]


def test_references_from_json(spark):
    df = spark.createDataFrame([('["GR-1", "", null]',), ('[{"number": "GR-7", "date": "2021-11-30"}, {"number": ""}]',), ("[]",), ("",), ("broken [",), (None,)], "raw string")
    got = [[tuple(x) for x in r[0]] for r in df.select(citations.entries_from_json(F.col("raw"))).collect()]
    assert got == [[("GR-1", None)], [("GR-7", "2021-11-30")], [], [], [], []]


def test_over_context(spark):
    df = spark.createDataFrame([(1, [("system", "a " * 10), ("user", "b " * 10)])], "query_id int, messages array<struct<role:string,content:string>>")
    assert [tuple(r) for r in grounding.over_context(df, 40, 15).collect()] == [(1, 26, True)]
    assert grounding.over_context(df, 60, 15).first()["over"] is False


def test_reference_changes(spark):
    kind = "doc_id string, refs array<struct<number:string,date:string>>"
    a = spark.createDataFrame([("x", [("A/1", None)]), ("y", None)], kind)
    b = spark.createDataFrame([("x", [("a / 1", "2020")]), ("y", [("B/22", None)])], kind)
    assert tuple(citations.reference_changes(a, b).first()) == (2, 1, 3.5)


def test_containing(spark):
    rows = spark.createDataFrame([("a", "GR-123 and GR-12"), ("b", None), ("c", ""), ("d", "x")], "row_id string, text string")
    patterns = spark.createDataFrame([("GR-12",), ("GR-123",), ("",), (None,), ("GR-12",), ("zz",)], "pattern string")
    assert sorted(tuple(r) for r in search.containing(rows, patterns).collect()) == [("a", "GR-12"), ("a", "GR-123")]
    assert search.containing(rows, patterns.limit(0)).count() == 0


def test_cell_search_finds_nine_of_ten(spark, small):
    from daftar.plans import register_queries as r

    assert r.ann_cell_recall(spark, small).first()["recall"] >= 0.9


def test_citations_resolve_to_the_sources_of_their_own_answer(spark, tmp_path):
    two = '[{"n": 1, "gr_number": "A-1"}, {"n": 2, "gr_number": "B-2"}]'
    rows = [
        ("a0", "Assistant ", "The order has been placed before the desk. [2] It holds. [3]", two), ("a9", "assistant", "The order has been placed before the desk. [1]", '[{"n": 1, "gr_number": "C-3"}]'),
        ("b1", "assistant", "The order has been placed before the desk. [1]", "[]"), ("b2", "assistant", "The order has been placed before the desk. [4]", None), ("u1", "user", "What of [1]?", two),
    ]
    spark.createDataFrame(rows + rows[:1], "id string, role string, content string, sources string").write.parquet(f"{tmp_path}/messages.parquet")
    d = str(tmp_path)
    assert {tuple(r) for r in register_queries.source_citations(spark, d).collect()} == {("a0", "2", "3"), ("a9", "1", ""), ("b1", "", "1"), ("b2", "", "4")}
    assert sorted(tuple(r) for r in register_queries.source_citations_resolved(spark, d).collect()) == [("a0", 2, "B-2"), ("a9", 1, "C-3")]
    got = {r["in_corpus"]: r.asDict() for r in register_queries.source_answer_metrics(spark, d).collect()}
    assert [got[True][c] for c in ("n", "cited", "grounded", "correct")] == [2, 2, 1, 1] and [got[False][c] for c in ("n", "cited", "grounded", "correct")] == [2, 0, 0, 0]
    assert {tuple(r) for r in register_queries.source_failure_labels(spark, d).collect()} == {("PHANTOM", 1), ("WRONG-SOURCE", 1), ("NO-ABSTAIN", 2)}
