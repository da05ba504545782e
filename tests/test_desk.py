"""Answers, stored indexes, graph records and checks on small literal cases."""

import pytest
from pyspark.sql import functions as F

from daftar.functions.vectors import hashed_embedding
from daftar.operators import answering, catalog, citations, evaluation, integrity, portal, retrieval, search, tables
from daftar.sources import index as stored
from daftar.sources.index import PostingIndex, VectorStore


def test_posting_index_is_kept_up(spark, tmp_path):
    rows = spark.createDataFrame([(1, "alpha beta alpha"), (2, "alpha"), (3, ""), (4, "gamma"), (5, None), (6, "beta beta delta")], "row_id bigint, text string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "!!!"), (3, "beta beta"), (4, None)], "query_id bigint, text string")
    index = PostingIndex(spark, str(tmp_path / "ix"))
    assert index.search(q, 3).count() == 0  # nothing was added yet
    index.add(rows.where("row_id < 3"))
    index.add(rows.where("row_id >= 3"))
    for form in ("fts", "okapi"):
        want = [tuple(r) for r in search.bm25_topk(rows.where("text is not null"), q, 9, form).orderBy("query_id", "rank").collect()]
        assert [tuple(r) for r in index.search(q, 9, form).orderBy("query_id", "rank").collect()] == want
    index.delete(spark.createDataFrame([(1,), (1,)], "row_id bigint"))
    left = search.bm25_topk(rows.where("row_id <> 1 and text is not null"), q, 9)
    for ix in (index, index.compact(str(tmp_path / "new"))):
        assert ix.search(q, 9).exceptAll(left).count() == 0 and ix.search(q, 9).count() == left.count() > 0


def _shuffled(node):
    """Records that the exchanges of an executed plan wrote."""
    name = node.getClass().getSimpleName()
    if name.startswith("AdaptiveSparkPlan"):
        return _shuffled(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return _shuffled(node.plan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    return own + sum(_shuffled(node.children().apply(i)) for i in range(node.children().size()))


def test_posting_search_moves_no_pairs(spark, tmp_path):
    rows = spark.range(400).selectExpr("id as row_id", "concat('common word', if(id % 7 = 0, ' seven seven', ''), if(id % 50 = 0, ' fifty', '')) as text")
    q = spark.range(100).selectExpr("id as query_id", "if(id % 2 = 0, 'common seven', 'word fifty') as text")
    index = PostingIndex(spark, str(tmp_path / "ix"))
    index.add(rows)
    for form in ("fts", "okapi"):
        got = index.search(q, 9, form)
        assert [tuple(r) for r in got.orderBy("query_id", "rank").collect()] == [tuple(r) for r in search.bm25_topk(rows, q, 9, form).orderBy("query_id", "rank").collect()]
        got.collect()
        assert 0 < _shuffled(got._jdf.queryExecution().executedPlan()) < 400 * 100 / 4  # every query meets all 400 rows


@pytest.mark.parametrize("form", ["fts", "okapi"])
def test_posting_search_shuffles_the_best_of_few_tasks(spark, tmp_path, form):
    rows = spark.range(6000).selectExpr("id as row_id", "if(id % 3 = 0, 'common', 'rest') as text")
    q = spark.createDataFrame([(1, "common"), (2, "common common")], "query_id bigint, text string")
    index = PostingIndex(spark, str(tmp_path / "ix"))
    index.add(rows)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = {n: spark.conf.get(n) for n in names}
    try:
        for n, value in zip(names, ("200", "false")):
            spark.conf.set(n, value)
        got = index.search(q, 3, form)
        assert [(r["query_id"], r["row_id"], r["rank"]) for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"]))] == [(i, 3 * j, j + 1) for i in (1, 2) for j in range(3)]
        assert 2000 < _shuffled(got._jdf.queryExecution().executedPlan()) <= 2000 + 2 * 3 * spark.sparkContext.defaultParallelism + 20  # 200 tasks would hand on 1,200
    finally:
        for n, value in old.items():
            spark.conf.set(n, value)


@pytest.mark.parametrize("held", [0, 1, 9])
def test_a_task_hands_on_its_best_once(tmp_path, monkeypatch, held):
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(stored, "HELD", held)
    rng = np.random.default_rng(5)
    for i in range(2):  # files of one bag each
        pd.DataFrame({"bag_id": [i], "terms": [[0, 1][: i + 1]], "weights": [[2.0, 1.0][: i + 1]]}).to_parquet(tmp_path / f"{i}.parquet")
    whole = pd.DataFrame({"row_id": np.arange(90), "term_id": rng.integers(0, 2, 90), "part": rng.integers(1, 4, 90) / 2})
    ask = lambda *stretches: pd.concat(stored._best_of_task(iter(stretches), str(tmp_path), 4, 6, False))
    order = ["bag_id", "score", "row_id"]
    best = lambda df: df.sort_values(order, ascending=[True, False, True]).groupby("bag_id").head(4).reset_index(drop=True)
    got, want = ask(whole[60:], whole[:30], whole[30:60]), best(ask(whole))
    assert len(want) == 8
    pd.testing.assert_frame_equal(best(got), want)
    assert [int((got["bag_id"] == i).sum()) for i in range(2)] == [4 if i < held else 12 for i in range(2)]


def test_vector_store_takes_one_length_only(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"), 2)
    assert store.load().count() == 0
    store.add(spark.createDataFrame([(1, [1.0, 0.0], "a")], "row_id bigint, vec array<double>, title string"))
    with pytest.raises(Exception, match="has 2 numbers, not 3"):
        store.add(spark.createDataFrame([(2, [1.0, 0.0, 1.0], "b")], "row_id bigint, vec array<double>, title string"))
    store.check()
    store.add(spark.createDataFrame([(1, [0.0, 1.0], "again")], "row_id bigint, vec array<double>, title string"))
    with pytest.raises(ValueError, match="2 vectors but 1 ids"):
        store.check()


def test_embedding_is_a_unit_vector(spark):
    df = spark.createDataFrame([("a", "one two two"), ("b", ""), ("c", None), ("d", "Two, one two!")], "id string, t string").select("id", hashed_embedding(F.col("t"), 8).alias("v"))
    v = {r["id"]: r["v"] for r in df.collect()}
    assert sum(x * x for x in v["a"]) == pytest.approx(1) and v["a"] == v["d"] and v["b"] == [0.0] * 8 and v["c"] is None


@pytest.fixture(scope="module")
def desk(spark):
    rows = spark.createDataFrame([(1, "d1", "text", "alpha fee. More of it."), (2, "d1", "table", "alpha rate"), (3, "d1", "text", "alpha rule"), (4, "d2", "text", "beta fee!"), (5, "d3", "text", "gamma")], "row_id bigint, doc_id string, content_type string, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.8, 0.2]), (4, [0.0, 1.0])], "row_id bigint, vec array<double>")
    questions = spark.createDataFrame([(10, "alpha fee"), (11, "zeta"), (12, "beta fee")], "query_id bigint, text string")
    near = {10: [1.0, 0.0], 11: [-1.0, -1.0], 12: [0.0, 1.0]}
    embed = lambda q: spark.createDataFrame(list(near.items()), "query_id bigint, vec array<double>").join(q.select("query_id"), "query_id", "left_semi")
    return rows, vectors, questions, embed


def test_retrieval(spark, desk):
    rows, vectors, questions, embed = desk
    got = {}
    for r in retrieval.retrieve(questions, rows, vectors, embed).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["row_id"], r["low_confidence"]))
    assert got[10] == [(1, False), (2, False)]  # two pieces of a document at most
    assert got[12] == [(4, False)] and all(low for _, low in got[11]) and len(got[11]) == 2
    none = retrieval.retrieve(questions, rows, vectors, embed, allowed=spark.createDataFrame([], "doc_id string"))
    assert [(r["row_id"], r["low_confidence"]) for r in none.collect()] == [(None, True)] * 3
    only = retrieval.retrieve(questions, rows, vectors, embed, allowed=spark.createDataFrame([("d2",)], "doc_id string"))
    assert {r["row_id"] for r in only.collect()} == {4}
    flat = retrieval.retriever("flat")(questions, rows, vectors, embed).where("query_id = 10")
    assert [r["row_id"] for r in flat.orderBy("rank").collect()] == [1, 2, 3]
    scorer = lambda pairs, rows, q: pairs.withColumn("score", F.when(F.col("row_id") == 3, 0.9).otherwise(0.1))
    assert {r["row_id"] for r in retrieval.retrieve(questions.where("query_id = 10"), rows, vectors, embed, scorer).where("not low_confidence").collect()} <= {3}
    with pytest.raises(ValueError):
        retrieval.retriever("else")


def test_answers(spark, desk):
    rows, vectors, questions, embed = desk
    evidence = retrieval.retrieve(questions, rows, vectors, embed).join(rows.select("row_id", "text"), "row_id", "left")
    got = {r["query_id"]: r for r in answering.answer(questions, evidence).collect()}
    assert got[10]["answer"] == "alpha fee. [1] alpha rate [2]" and got[10]["valid"] == [1, 2] and got[10]["phantom"] == [] and not got[10]["abstained"]
    assert got[11]["abstained"] and got[11]["answer"] == answering.REFUSALS["en"] and got[11]["n_blocks"] == 0
    wild = lambda prompts, blocks: prompts.select("query_id", F.lit("So it is [7].").alias("answer"))
    assert [r["phantom"] for r in answering.answer(questions.where("query_id = 10"), evidence, generate=wild).collect()] == [[7]]
    turns = spark.createDataFrame([(10, 1, "user", "x " * 2000), (10, 2, "user", "before"), (10, 3, "assistant", "so")], "query_id bigint, turn_no int, role string, content string")
    assert answering.answer(questions, evidence, history=turns).where("query_id = 10").first()["n_blocks"] == 2
    assert answering.answer(questions.limit(0), evidence).count() == 0 and answering.answer(questions, evidence.limit(0)).where("not abstained").count() == 0
    cited = answering.sources(answering.answer(questions, evidence), spark.createDataFrame([(10, 2, "d1")], "query_id bigint, block_no int, doc_id string"))
    assert [tuple(r) for r in cited.collect()] == [(10, 2, "d1")]


def test_prompts(spark):
    q = spark.createDataFrame([(1, "What?", "mr", True), (2, "Why?", "auto", False), (3, "Who?", None, None)], "query_id int, text string, language string, low_confidence boolean")
    blocks = spark.createDataFrame([(1, 2, "[2] b"), (1, 1, "[1] a"), (2, 1, "[1] c")], "query_id int, block_no int, block string")
    turns = spark.createDataFrame([(2, 5, "assistant", "yes"), (2, 4, "user", "no?")], "query_id int, turn_no int, role string, content string")
    compact = {r["query_id"]: r["messages"] for r in answering.build_prompts(q, blocks, answering.GenerationConfig.of("local"), turns).collect()}
    full = {r["query_id"]: r["messages"] for r in answering.build_prompts(q, blocks, answering.GenerationConfig.of("hosted"), turns).collect()}
    assert [m["role"] for m in compact[2]] == ["system", "user", "assistant", "user"] and len(compact[1]) == 2
    assert compact[1][0]["content"].endswith("Write the answer in Marathi (मराठी).") and "weakly" in compact[1][0]["content"] and "weakly" not in full[2][0]["content"]
    at = lambda text, *parts: [text.index(p) for p in parts]
    assert at(compact[1][-1]["content"], "[1] a", "[2] b", "What?", "[1]-[2]") == sorted(at(compact[1][-1]["content"], "[1] a", "[2] b", "What?", "[1]-[2]"))
    assert at(full[1][-1]["content"], "[2] b", "Rules", "What?") == sorted(at(full[1][-1]["content"], "[2] b", "Rules", "What?")) and "5." in full[1][-1]["content"]
    for text in (answering.SYSTEM_FULL, answering.SYSTEM_COMPACT):  # the four rules
        assert all(w in text for w in ("blocks", "cite", "conflict", "cite nothing"))
    with pytest.raises(ValueError):
        answering.GenerationConfig.of("nobody")


def test_rewrite_and_images(spark):
    q = spark.createDataFrame([(1, "And then?"), (2, "New")], "query_id int, text string")
    turns = spark.createDataFrame([(1, 1, "user", "first"), (1, 2, "user", "What of fees?"), (1, 3, "assistant", "This.")], "query_id int, turn_no int, role string, content string")
    assert {tuple(r) for r in answering.rewrite(q, turns).collect()} == {(1, "What of fees? And then?"), (2, "New")}
    blank = lambda x: x.select("query_id", F.lit(" ").alias("text"))
    assert {tuple(r) for r in answering.rewrite(q, turns, blank).collect()} == {(1, "And then?"), (2, "New")}
    blocks = spark.createDataFrame([(1, i, f"u{i}" if i != 2 else "") for i in range(1, 7)] + [(2, 1, None)], "query_id int, block_no int, image_url string")
    assert [tuple(r) for r in answering.with_images(blocks).collect()] == [(1, ["u1", "u3", "u4"], [1, 3, 4])]


def test_graph_records(spark):
    e = [("a", "b", "B/1", "supersedes", "resolved"), ("a", None, "X/9", "cites", "dangling"), ("c", "a", "A/1", "cites", "resolved"), ("b", "d", "D/1", "cites", "resolved"), ("c", "b", "B/1", "cites", "resolved"), ("b", None, "Y/9", "cites", "ambiguous")]
    edges = spark.createDataFrame([(s, t, n, k, r, None) for s, t, n, k, r in e], "src_id string, dst_id string, dst_number string, kind string, resolution string, dst_date string")
    roots = spark.createDataFrame([("a",), ("gone",)], "root_id string")
    near = citations.neighbourhood(edges, roots, 1)
    assert {tuple(r) for r in near.where("root_id = 'a'").collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 1)}
    inside, loose = citations.neighbour_edges(edges, near, 1)
    assert {(r["src"], r["dst"]) for r in inside.collect()} == {("a", "b"), ("c", "a")} and [(r["src_id"], r["gr_number"]) for r in loose.collect()] == [("a", "X/9")]
    two = citations.neighbourhood(edges, roots, 2, 3)
    assert {r["node_id"] for r in two.where("root_id = 'a'").collect()} == {"a", "b", "c"}  # the cap keeps the nearest
    docs = spark.createDataFrame([("a", "A/1", "2020", True), ("b", "B/1", "2019", None), ("c", "C/1", None, False)], "doc_id string, gr_number string, date string, supersedes boolean")
    asked = spark.createDataFrame([("b",), ("zz",), ("b",)], "doc_id string")
    got = {r["doc_id"]: r for r in citations.supersession(docs, edges, citations.chains(docs, edges), asked).collect()}
    assert got["b"]["chain"] == ["a"] and got["b"]["superseded_by"] == "a" and (got["b"]["n_cites"], got["b"]["n_held"]) == (2, 1) and not got["zz"]["found"] and got["zz"]["n_cites"] is None
    assert {tuple(r) for r in citations.held_numbers(docs, spark.createDataFrame([("B",), ("/1",), ("Q",)], "asked string")).collect()} == {("B", "b"), ("/1", "a"), ("Q", None)}


def test_a_hub_is_cut_where_it_cannot_count(spark):
    """More superseders and links than any walk can use, against the whole lists."""
    n = 300
    docs = spark.range(n).selectExpr("format_string('s%03d', id) doc_id", "cast(2000 + id % 7 as string) date").union(spark.createDataFrame([("hub", "1999")], "doc_id string, date string"))
    edges = spark.range(n).selectExpr("format_string('s%03d', id) src_id", "'hub' dst_id", "'supersedes' kind")
    ring = spark.createDataFrame([("hub", "s299", "supersedes"), ("hub", "s006", "supersedes")], "src_id string, dst_id string, kind string")
    best = max(((2000 + i % 7, f"s{i:03d}") for i in range(n)))[1]
    got = {r["doc_id"]: r["next_id"] for r in citations.chains(docs, edges.union(ring)).where("hop = 1").collect()}
    assert got["hub"] == best and got["s006"] == "hub"
    near = citations.neighbourhood(edges, spark.createDataFrame([("s000",)], "root_id string"), 2, 10)
    assert sorted((r["distance"], r["node_id"]) for r in near.collect()) == [(0, "s000"), (1, "hub"), *[(2, f"s{i:03d}") for i in range(1, 9)]]


def test_departments_cited(spark):
    blocks = spark.createDataFrame([("a", "Order of the Crop Department, and Works"), ("b", ""), ("c", "no name"), ("d", "Works")], "doc_id string, block string")
    names = spark.createDataFrame([("Crop Department", "Crop"), ("Works Department", "Works"), ("Works Department", "Roads")], "department string, fragment string")
    counted, total = citations.departments_cited(blocks, names, spark.createDataFrame([("Crop Department",)], "department string"))
    assert {tuple(r) for r in counted.collect()} == {("Crop Department", 1, True), ("Works Department", 2, False)} and tuple(total.first()) == (4, 3, 1)


def test_checks_and_lookups(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    for _ in range(2):
        assert integrity.rebuilt(df, str(tmp_path / "t")).count() == 2
    assert {tuple(r) for r in portal.appended(df, spark.createDataFrame([("b", 9), ("c", 3)], "id string, n int"), "id").collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert [tuple(r) for r in catalog.table_info(df).collect()] == [(0, "id", "string"), (1, "n", "int")]
    hits = spark.createDataFrame([(1, 1, "A/12 x"), (1, 2, "A/1 y"), (2, 1, "z")], "query_id int, rank int, hay string")
    expected = spark.createDataFrame([(1, "A/1"), (1, "q"), (2, "nothing"), (3, "")], "query_id int, name string")
    assert {tuple(r) for r in evaluation.first_match(hits, expected).collect()} == {(1, 1), (2, None), (3, None)}
    log = spark.createDataFrame([("a", 1.0), ("a", 12.0), ("a", None), ("b", 10.0)], "stage string, s double")
    assert {tuple(r) for r in evaluation.latencies(log, "stage", "s").collect()} == {("a", 2, 6.5, 12.0, 1), ("b", 1, 10.0, 10.0, 0)}
    tops = spark.createDataFrame([(1, "A/1 d", "fee 5", False), (2, "x", "y", True)], "query_id int, hay string, text string, low_confidence boolean")
    known = spark.createDataFrame([(1, "A/1", "5", False), (2, "", None, True), (3, "A/1", None, False), (4, "", None, True)], "query_id int, name string, number string, outside boolean")
    assert {tuple(r) for r in evaluation.verified(tops, known).collect()} == {(1, True), (2, True), (3, False), (4, True)}
    said = spark.createDataFrame([("The blocks do not appear to cover it.",), ("It is not covered.",), ("यात समाविष्ट नाही.",), ("I was unable to find it.",), ("It covers fees.",)], "a string")
    assert [r[0] for r in said.select(F.col("a").rlike(evaluation.REFUSAL)).collect()] == [True, True, True, True, False]


def test_progress_is_told(spark):
    docs = spark.createDataFrame([("a", "A/1", None, None, None)], "doc_id string, gr_number string, date string, refs array<struct<number:string,date:string>>, supersedes boolean")
    seen = []
    assert citations.build_edges(docs, seen.append).count() == 0 and seen == ["references", "candidates", "edges"]


def test_markdown_and_equal_tables(spark):
    text = "a\n| h | k |\n|---|:-:|\n| 1 | 2 |\nb | c\n\n| lone | row |\nend\nx | y\n--|--\nz"
    df = spark.createDataFrame([(text,), ("none",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tables.without_markdown_tables(F.col("t"))).collect()] == ["a\n\n| lone | row |\nend\nz", "none", "", None]
    grid = [["a", "1"], ["b", "2"]]
    rows = spark.createDataFrame([("d", 5, grid), ("d", 1, grid), ("d", 9, [["c", "3"]]), ("e", 1, grid), ("e", 2, [[""]]), ("e", 3, [[""]])], "doc string, line int, rows array<array<string>>")
    assert sorted((r["doc"], r["line"]) for r in tables.first_of_equal(rows, "rows", ["doc"], ["line"]).collect()) == [("d", 1), ("d", 9), ("e", 1), ("e", 2), ("e", 3)]


def test_token_bucket_of_a_hot_user(spark):
    """One user over many partitions, with and without rests, against the same fold in order."""
    ev = spark.range(4000).selectExpr("id event_id", "if(id % 10 = 0, cast(null as int), 1) user_id", "timestamp'2024-01-01' + make_interval(0,0,0,0,0,0, cast(id * 2 + if(id > 2000, 500, 0) + if(id % 3 = 0, 1, 0) as int)) ts").repartition(7)
    want = {}
    state = {}
    for r in sorted(ev.selectExpr("event_id", "user_id", "unix_micros(ts) us").collect(), key=lambda r: (r["us"], r["event_id"])):
        level, at = state.get(r["user_id"], (20.0, r["us"]))
        level = min(20.0, level + (r["us"] - at) / 1e6 * (20.0 / 60.0))
        want[r["event_id"]] = level >= 1
        state[r["user_id"]] = (level - (level >= 1), r["us"])
    assert {r["event_id"]: r["allowed"] for r in portal.token_bucket(ev).collect()} == want
    assert portal.token_bucket(ev.limit(0)).count() == 0
