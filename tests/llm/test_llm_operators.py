"""The training-data operators on small cases: brute force, round trips, nulls, ties, empty tables, clashing columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from daftar.llm import conversations, languages, lookalike, mixing, ocr, packing, pieces, queries, subjects, tokens
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, small, name):
    same(queries.QUERIES[name](spark, small), queries.ORACLE[name], small)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


# --- 1: look-alike text ----------------------------------------------------


@pytest.mark.parametrize(
    "a, b",
    [
        ("Ā", "Ā"), ("ＡＢ－１", "AB-1"), ("С.R.", "C.R."), ("a‐b‑c", "a-b-c"), ("x​y⁠﻿­z", "xyz"), ("a b c", "a b c"),
        ("अाे", "ओ"), ("\u1fb9ё", "Āë"), ("Α\u0304", "Ā"), ("र्इ", "ई"), ("उु", "ऊ"), ("आॆ", "ऒ"), ("ανυριϲ", "avupic"), ("ӀӏҮүѵҺ", "IlYyvh"), ("Ⅳ ⅴ", "IV v"), ("ﬁle", "file"), ("𝐀𝟏", "A1"),
        ("ᎪᏴ", "AB"), ("a\tb", "a b"), ("a\u2028b\x85c", "a b c"), ("a\r\nb", "a\nb"), ("माेर", "मोर"), ("क़", "क़"), ("ऱ", "ऱ"), ("अाज", "आज"), ("", ""),
    ],
)
def test_same_look(a, b):
    assert lookalike.look(a) == lookalike.look(b)


@pytest.mark.parametrize("a, b", [("A", "a"), ("ā", "a"), ("१", "1"), ("a b", "ab"), ("a  b", "a b"), ("a.b", "ab"), ("²", "2"), ("½", "1/2"), ("…", "..."), ("ſ", "s"), ("a\nb", "a b")])
def test_other_look(a, b):
    assert lookalike.look(a) != lookalike.look(b)


def test_fold_is_coarser_than_look_and_both_are_stable():
    rng = random.Random(1)
    table = lookalike._shapes().table
    deva = "".join(lookalike._COMPOSED)
    pool = "aAāĀｅé́̄СсΑ-‐‑－  ​\t\r\nमक़क़ßẞ２²1ıİſµ" + deva * 2 + "".join(rng.sample(sorted(table), 60))
    for _ in range(6000):
        s = "".join(rng.choices(pool, k=6))
        assert lookalike.look(lookalike.look(s)) == lookalike.look(s)
        assert lookalike.fold(lookalike.look(s)) == lookalike.fold(s) == lookalike.fold(lookalike.fold(s))
    for a in {x for p in lookalike._COMPOSED for x in p}:  # every order of composing ends in the same form
        for p in lookalike._COMPOSED:
            assert lookalike.look(a + p) == lookalike.look(a + lookalike._COMPOSED[p]) and lookalike.look(p + a) == lookalike.look(lookalike._COMPOSED[p] + a), (a, p)
    assert lookalike.fold("Straße") == lookalike.fold("STRASSE")
    assert lookalike.look("a\n\tb\r\nc").count("\n") == 2


def test_twins(spark):
    rows = [("d1", "C.R.1"), ("d2", "С.R.1"), ("d3", "C.R.1"), ("d3", "С.R.1"), ("d4", "c.r.1"), ("d5", None), (None, "C.R.1"), ("d6", ""), ("d1", "C.R.1")]
    df = spark.createDataFrame(rows, "id string, v string")
    k = lookalike.keyed(df, "id", "v")
    held, names = lookalike.owners(df, "id", "v"), lookalike.spelled(df, "v")
    for got in (lookalike.twins(k, k, k), lookalike.twins(names, held, held)):
        assert {tuple(r) for r in got.collect()} == {("d1", "d2"), ("d2", "d3"), ("d1", "d3")}
    other = spark.createDataFrame([("d2", "Ｃ.R.1"), ("d9", "C.R.1")], "id string, v string")
    both = lookalike.spelled(df.unionByName(other), "v")
    assert {tuple(r) for r in lookalike.twins(both, lookalike.owners(other, "id", "v"), held).collect()} == {("d1", "d2"), ("d2", "d3"), ("d2", "d9"), ("d3", "d9")}
    empty = k.limit(0)
    assert lookalike.twins(empty, empty, empty).count() == 0
    out = lookalike.normalise(spark.createDataFrame([(None, "x"), ("ａ", "ｙ")], "v string, look string"), "v")
    assert [tuple(r) for r in out.collect()] == [(None, "x"), ("a", "ｙ")]


# --- 2: scanned pages --------------------------------------------------------


@pytest.fixture(scope="module")
def channel():
    rng = random.Random(2)
    names = "the committee examined record transfer together with order office district payment under consideration medicine staff ledger hire depot".split()
    words, pairs = {}, {}
    bad = {"e": "c", "d": "cl", "h": "b"}
    for _ in range(60000):
        a, b = rng.choice(names), rng.choice(names)
        for w in (a, b):
            if rng.random() < 0.004 and any(c in w for c in bad):
                c = rng.choice([c for c in bad if c in w])
                i = rng.choice([i for i, x in enumerate(w) if x == c])
                w = w[:i] + bad[c] + w[i + 1 :]
            words[w] = words.get(w, 0) + 1
        pairs[a, b] = pairs.get((a, b), 0) + 1
    words["co-operative"] = 500
    words["cooperative"] = 3
    return ocr.Channel(words, pairs)


def test_confusions_are_learned(channel):
    assert {("e", "c"), ("d", "cl"), ("h", "b")} <= set(channel.confusions)
    assert "rccord" not in channel.lexicon and "record" in channel.lexicon
    assert channel.decode(["the", "rccord", "uncler", "consideration"]) == ["the", "record", "under", "consideration"]


PAGES = """# Page 1

Title of the office
Government of the Province
Order No. AB-2015/C.R.2/D-1
Date: 9 January, 2015

The committee exam-
ined the rccord together with the co-
operative order of the

Title of the office

1

# Page 2

district office under consid¬
eration.

Title of the office

2"""


def test_noise_of_pages(channel):
    got = ocr.label(channel, PAGES)
    lines = PAGES.split("\n")
    assert {(lines[n], k) for n, k in got} == {
        ("The committee exam-", "hyphen"), ("ined the rccord together with the co-", "misread"), ("Title of the office", "running"),
        ("1", "pageno"), ("2", "pageno"), ("district office under consid¬", "hyphen"),
    }
    assert 2 not in [n for n, _ in got]  # the letterhead
    assert ocr.label(channel, "") == [] and ocr.label(channel, "\n\n# Page 1\n") == []


def test_repair_keeps_everything_else(channel):
    fixed = ocr.repair(channel, PAGES)
    assert "The committee examined the record together with the co-operative order of the district office under consideration." in fixed
    assert "Page" not in fixed and fixed.count("Title of the office") == 1
    clean = "A plain paragraph.\n\nAnother one, 12 words."
    assert ocr.repair(channel, clean) == clean


def test_pieces_are_repaired_too(spark, channel):
    docs = spark.createDataFrame([("d", PAGES), ("n", None), (None, "the rccord")], "doc_id string, text string")
    held = spark.createDataFrame(
        [(1, "d", "The committee exam-\nined the rccord together with the co-\nTitle of the office\n2\noperative order"), (2, "gone", "the rccord"), (3, "d", None), (4, "d", "Title of the office\nGovernment of the Province\nOrder No. AB-2015/C.R.2/D-1"), (None, None, "a plain line")],
        "faiss_id bigint, gr_id string, text string",
    )
    got = {(r["tbl"], r["row_key"]): r["text"] for r in ocr.repaired(docs, held, channel).collect()}
    assert len(got) == 8 and got["gr_documents", "d"] == ocr.repair(channel, PAGES)
    assert got["gr_documents", "n"] is None and got["gr_documents", None] == "the record"
    assert got["gr_chunks", "1"] == "The committee examined the record together with the co-operative order"
    assert got["gr_chunks", "2"] == "the record" and got["gr_chunks", "3"] is None and got["gr_chunks", None] == "a plain line"
    assert got["gr_chunks", "4"].startswith("Title of the office\nGovernment")  # the letterhead is no running line


def test_repaired_reads_both_tables(spark, small):
    from daftar.llm import queries

    got = queries.p2_repaired(spark, small).groupBy("tbl").agg(F.countDistinct("row_key").alias("n")).collect()
    want = {t: spark.read.parquet(f"{small}/{t}.parquet").select(k).distinct().count() for t, k in (("gr_documents", "doc_id"), ("gr_chunks", "faiss_id"))}
    assert {r["tbl"]: r["n"] for r in got} == want


def test_noise_of_pieces(spark, channel):
    docs = spark.createDataFrame([("d", PAGES), ("n", None), ("d", PAGES), (None, PAGES)], "doc_id string, text string")
    held = spark.createDataFrame([(1, "d", "ined the rccord together with the co-\nTitle of the office\n2"), (2, "gone", "the rccord"), (3, "d", None), (1, "d", "ined the rccord together with the co-\nTitle of the office\n2"), (4, None, "the exam-\nined")], "faiss_id bigint, gr_id string, text string")
    got = {(r["row_key"], r["line_no"], r["noise"]) for r in ocr.noisy_lines(docs, held, channel).where("tbl = 'gr_chunks'").collect()}
    assert got == {("1", 0, "misread"), ("1", 1, "running"), ("1", 2, "pageno"), ("2", 0, "misread"), ("4", 0, "hyphen")}


def test_noise_of_pieces_beside_their_document(spark, channel):
    docs = spark.createDataFrame([("d", PAGES), ("n", None)], "doc_id string, text string")
    held = spark.createDataFrame([(1, "n", "the exam-\nined the rccord"), (2, "d", "the rccord of the office\nTitle of the office"), (3, "d", "Title of the office\n")], "faiss_id bigint, gr_id string, text string")
    got = {(r["row_key"], r["line_no"], r["noise"]) for r in ocr.noisy_lines(docs, held, channel).where("tbl = 'gr_chunks'").collect()}
    assert got == {("1", 0, "hyphen"), ("1", 1, "misread"), ("2", 0, "misread"), ("2", 1, "running"), ("3", 0, "running")}


def test_a_piece_is_laid_along_its_document():
    head, a, b, c, d = 7, 1, 2, 3, 4
    lines = [head, a, 0, b, head, 0, c, d, head]
    assert ocr.laid_along([head, a, b], lines, 0, {4, 8}) == [0, 1, 3]
    assert ocr.laid_along([b, head, c, d, head], lines, 0, {4, 8}) == [3, 4, 6, 7, 8]
    assert ocr.laid_along([9, head, 0], lines, 0, {4, 8}) == [None, 4, None] and ocr.laid_along([], lines, 0, set()) == []
    assert ocr.laid_along([d, a], lines, 0, set()) == [7, 1]


def test_letterhead_is_told_from_an_equal_running_line(spark, channel):
    docs = spark.createDataFrame([("d", PAGES)], "doc_id string, text string")
    first = "Title of the office\nGovernment of the Province\nOrder No. AB-2015/C.R.2/D-1"
    held = spark.createDataFrame([(1, "d", first), (2, "d", "eration.\nTitle of the office\n2")], "faiss_id bigint, gr_id string, text string")
    got = {(r["row_key"], r["line_no"], r["noise"]) for r in ocr.noisy_lines(docs, held, channel).where("tbl = 'gr_chunks'").collect()}
    assert got == {("2", 1, "running"), ("2", 2, "pageno")}


# --- 3: pieces -----------------------------------------------------------------


def greedy(t, limit, overlap):
    """The same cuts, one by one."""
    spaces = set(map(chr, pieces._SPACES))
    level = {}
    for p in range(1, len(t)):
        if t[p] not in spaces and t[p - 1] in spaces:
            q = p
            while q and t[q - 1] in spaces:
                q -= 1
            level[p] = 3 if t[q:p].count("\n") >= 2 else 2 if q and t[q - 1] in ".?!।" else 1
    before = 0
    for p in [*sorted(level), len(t)]:
        for x in range(before + limit - overlap, p, limit - overlap):
            level[x] = 0
        before = p
    out, e = [], 0
    while t:
        w = limit if e == 0 else limit - overlap
        if len(t) - e <= w:
            return [*out, len(t)]
        near = [p for p in sorted(level) if (e or overlap) < p <= e + w]
        for ok in (lambda p: level[p] == 3 and p > e + w // 2, lambda p: level[p] >= 2 and p > e + w // 2, lambda p: level[p] >= 2, lambda p: level[p] >= 1, lambda p: True):
            if hit := [p for p in near if ok(p)]:
                e = hit[-1]
                break
        out.append(e)
    return out


def test_cuts_equal_the_greedy_ones():
    rng = random.Random(5)
    texts = ["", " ", "short. " + "long" * 50 + " end", "x" * 500, "ab " * 300, "a" * 120, "a" * 121, " " * 400, ("w" * 104 + " ") * 5]
    for _ in range(150):
        texts.append("".join(rng.choice(["a", "bc", "देव", " ", " ", "\n", "\n\n", ". ", "। ", "long" * rng.randrange(40)]) for _ in range(rng.randrange(200))))
    block = pieces.Block(texts)
    owner, end = block.cuts(120, 15)
    for i, t in enumerate(texts):
        stops = (end[owner == i] - block.start[i]).tolist()
        assert stops == greedy(t, 120, 15), repr(t)
        assert all(e > 15 for e in stops[:-1]) and stops == sorted(stops)  # so any two neighbours have the whole overlap in common
    assert block.longest(pieces.WORD).tolist() == [max(map(len, t.split()), default=0) for t in texts]


def test_split_round_trip(spark):
    text = "# Page 3\n" + "One sentence here. " * 100 + "\n\n# Page 4\n" + "word" * 900
    df = spark.createDataFrame([("a", text, 1), ("b", "short", 2), ("c", None, 3), ("d", "", 4)], "id string, t string, k int")
    got = pieces.split(df, "id", "t").orderBy("id", "chunk_index").collect()
    mine = [r for r in got if r["id"] == "a"]
    assert all(len(r["piece"]) <= 1200 for r in got) and [r["chunk_index"] for r in mine] == list(range(len(mine)))
    assert mine[0]["piece"] + "".join(r["piece"][150:] for r in mine[1:]) == text
    assert (mine[0]["page_start"], mine[-1]["page_end"]) == (3, 4)
    assert [tuple(r)[:4] for r in got if r["id"] != "a"] == [("b", 0, 1, 1)]
    with pytest.raises(ValueError):
        pieces.split(df, "id", "t", 100, 50)


# --- 5: languages ----------------------------------------------------------------


def test_labels():
    read = {"mr-IN": "mr", " MR": "mr", "मराठी": "mr", "hi_IN": "hi", "Hindi": "hi", "eng": "en", "en-GB": "en", "fr": "other", "ne": "other", None: None, "": None, "  ": None, "-": None, "N/A": None, "und": None, "unknown": None}
    assert {k: languages.label_of(k) for k in read} == read


def test_languages_on_held_out_documents(spark, small):
    docs = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/gr_documents.parquet").where("text is not null and language in ('mr', 'hi', 'en')").dropDuplicates(["doc_id"])
    profiles = languages.fit(languages.sample(docs.where("xxhash64(doc_id) % 2 = 0"), "doc_id", "language", "text"))
    out = languages.assign(docs.where("xxhash64(doc_id) % 2 <> 0"), "doc_id", "language", "text", profiles).where("block_no = -1")
    assert out.where("lang = label").count() / out.count() > 0.8  # a tenth of the labels is wrong on purpose
    assert out.where("confidence < 0 or confidence > 1").count() == 0


def test_language_edge_cases(spark):
    df = spark.createDataFrame([("a", "en", ""), ("b", None, None), ("c", "en", "12 34 | 5"), ("d", "en", "The order of the office shall be placed before the committee for the record of it.")], "id string, l string, t string")
    profiles = languages.fit([("en", "The committee examined the order of the office and the record of the leave. " * 30), ("mr", "समितीने नोंद आणि यादी यांची तपासणी करून शिफारस केली आहे. " * 30)])
    assert {(r["id"], r["block_no"], r["lang"]) for r in languages.assign(df, "id", "l", "t", profiles).collect()} == {("d", 0, "en"), ("d", -1, "en")}
    assert languages.fit([]).nearest(["word"]) is None


# --- 7: conversations ----------------------------------------------------------------


def verdict(rows):
    """The rules, one by one."""
    rank = {"system": 0, "user": 1, "assistant": 2}
    seen = set()
    items = []
    for m in rows:
        if m not in seen and m[3] is not None and m[3].strip():
            seen.add(m)
            items.append(((m[2] or "").strip().lower(), m[3], m[4]))
    if not items:
        return None
    if any(r not in rank for r, _, _ in items):
        return "alien_role"
    turns = []
    for r, c, _ in sorted(items, key=lambda x: (x[2], rank[x[0]], x[1])):
        if r != "system" and (not turns or turns[-1] != (r, c)):
            turns.append((r, c))
    if not turns:
        return "empty"
    return "kept" if [r for r, _ in turns] == ["user", "assistant"] * (len(turns) // 2) else "broken"


def test_conversations_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for c in range(150):
        n = rng.choice([0, 1, 2, 3, 4, 6])
        for k in range(n):
            role = ["user", "assistant"][k % 2] if rng.random() < 0.9 else rng.choice(["user", "assistant", "system", "tool", None, " USER "])
            m = (f"m{c}-{k}", f"c{c}", role, rng.choice(["a", "b", "", " \n", None]) if rng.random() < 0.3 else f"t{k}", float(rng.choice([k, k, k // 2])))
            rows += [m] * rng.choice([1, 1, 1, 2])
    rows.append(("z", None, "user", "x", 1.0))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, conversation_id string, role string, content string, created_at double").repartition(3)
    want = {c: v for c in {r[1] for r in rows if r[1]} if (v := verdict([r for r in rows if r[1] == c]))}
    turns, verdicts = conversations.rebuild(df)
    assert {r["conversation_id"]: r["verdict"] for r in verdicts.collect()} == want
    assert {r[0] for r in turns.select("conversation_id").distinct().collect()} == {c for c, v in want.items() if v == "kept"}
    assert conversations.judge(conversations.stretches(conversations.turns(df.limit(0)))).count() == 0


def test_one_conversation_over_many_partitions(spark):
    rows = spark.range(40_000).selectExpr("cast(id as string) id", "'hot' conversation_id", "if(id % 2 = 0, 'user', 'assistant') role", "concat('t', id) content", "cast(id as double) created_at", "1 as part")
    turns, verdicts = conversations.rebuild(rows)
    assert [tuple(r) for r in verdicts.collect()] == [("hot", "kept", 40_000)]
    assert turns.agg(F.count("*"), F.countDistinct("turn_no"), F.min("turn_no"), F.max("turn_no")).first()[:] == (40_000, 40_000, 1, 40_000)
    assert turns.where("turn_no <> cast(created_at as int) + 1").count() == 0


# --- 8: containers ----------------------------------------------------------------------


def test_plan_places_every_text_once_within_capacity():
    rng = random.Random(8)
    for capacity in (7, 50, 512):
        h = {k: rng.randrange(1, 40) for k in rng.sample(range(0, capacity + 1), min(capacity, 60))}
        ranges, n = packing.plan(h, capacity)
        load = [0] * n
        for length, lo, hi, first in ranges:
            for k in range(hi - lo):
                load[first + k] += length
        assert max(load, default=0) <= capacity and sum(load) == sum(k * v for k, v in h.items())
        for length, count in h.items():
            if length:
                spans = sorted((lo, hi) for x, lo, hi, _ in ranges if x == length)
                assert spans[0][0] == 0 and spans[-1][1] == count and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert packing.plan({}, 10) == ([], 0)


def test_length_buckets_are_optimal():
    from itertools import combinations

    rng = random.Random(9)
    for _ in range(40):
        h = {k: rng.randrange(1, 9) for k in rng.sample(range(1, 30), 8)}
        sizes = sorted(h)

        def padding(bounds):
            return sum(n * (next(b for b in bounds if b >= k) - k) for k, n in h.items())

        want = min(padding([*c, sizes[-1]]) for k in range(0, 3) for c in combinations(sizes[:-1], k))
        assert padding(packing.length_buckets(h, 3)) == want


def test_pack(spark):
    rows = [(i, n) for i, n in enumerate([0, 1, 5, 5, 5, 9, 10, 11, 25, 3])] + [(None, 4)]
    lengths = spark.createDataFrame(rows, "doc_id bigint, n_tokens int")
    items = packing.items(lengths, "doc_id", 10, "box")
    out = packing.pack(items, "doc_id", {"box": 10}).collect()
    assert len(out) == 11 + 1 + 2
    load = {}
    for r in out:
        load[r["bin_no"]] = load.get(r["bin_no"], 0) + r["tokens"]
    assert max(load.values()) <= 10 and sum(load.values()) == sum(n for _, n in rows) and len(load) == 8
    assert packing.pack(items.limit(0), "doc_id", {"box": 10}).count() == 0


def test_tokens_are_those_of_the_tokenizer(spark):
    df = spark.createDataFrame([(1, "Order of the office", "x"), (2, "", "y"), (3, None, "z")], "id int, text string, n_tokens string")
    enc = tokens.encoding(tokens.TOKENIZER)
    assert [tuple(r) for r in tokens.measured(df, "text").orderBy("id").collect()] == [(1, len(enc.encode_ordinary("Order of the office"))), (2, 0)]


def test_bucket_batches_keep_texts_of_no_size(spark):
    items = spark.createDataFrame([("a", i, 0, n) for i, n in enumerate([0, 0, 3, 5, 9])] + [("b", 9, 0, 0)], "container string, doc_id int, part int, tokens int")
    got = packing.bucket_batches(items, "doc_id", {"a": 10, "b": 10}, 2).collect()
    assert sorted((r["container"], r["doc_id"]) for r in got) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 9)]
    first = min(r["bucket"] for r in got if r["container"] == "a")
    assert first > 0 and {r["bucket"] for r in got if r["tokens"] == 0 and r["container"] == "a"} == {first}


# --- 9: mixtures ----------------------------------------------------------------------------


def test_shortages_go_to_siblings_first():
    targets = {"office_1": (0.4, 1), "office_2": (0.3, 5), "press_1": (0.3, 5)}
    leaves = {("office", "mr", "office_1"): (100.0, 1), ("office", "mr", "office_2"): (1000.0, 1), ("press", "mr", "press_1"): (1000.0, 1), ("press", "mr", "other"): (9.0, 1)}
    got = mixing.budgets(leaves, targets, 1000.0)
    assert got[("office", "mr", "office_1")] == pytest.approx(100) and got[("office", "mr", "office_2")] == pytest.approx(600) and got[("press", "mr", "press_1")] == pytest.approx(300)
    exact = mixing.budgets(leaves, targets, None)
    assert exact[("office", "mr", "office_1")] == pytest.approx(100) and sum(exact.values()) == pytest.approx(250)
    assert mixing.budgets({}, targets, None) == {}


def test_mixture(spark):
    rows = [(i, s, "mr" if i % 3 else None, 10) for i, s in enumerate(["big_1"] * 600 + ["small_1"] * 30 + ["else_1"] * 50)] + [(None, "big_1", "mr", 10), (9000, "big_1", "mr", 0)]
    texts = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_tokens int")
    targets = spark.createDataFrame([("big_1", 0.7, 1), ("small_1", 0.2, 3), ("absent_1", 0.1, 2), ("big_1", 0.7, 1)], "source string, target_share double, max_repeats int")
    drawn, _ = mixing.mix(texts, targets, None, 1)
    got = {r["source"]: (r["t"], r["e"]) for r in drawn.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.max("epoch").alias("e")).collect()}
    total = sum(t for t, _ in got.values())
    assert set(got) == {"big_1", "small_1"} and got["small_1"][1] <= 2 and got["small_1"][0] / total == pytest.approx(0.2 / 0.9, abs=0.02)
    assert drawn.groupBy("doc_id", "epoch").count().where("count > 1").count() == 0
    again, _ = mixing.mix(texts.repartition(5), targets, None, 1)
    assert drawn.select("doc_id", "epoch").exceptAll(again.select("doc_id", "epoch")).count() == 0


def test_rare_source_does_not_shrink_the_mixture(spark, tmp_path):
    rows = [(i, s, "mr", "Order of the office") for i, s in enumerate(["big_1"] * 600 + ["big_2"] * 300 + ["small_1"] * 10 + ["else_1"] * 50)]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big_1", 0.5, 1), ("big_2", 0.2, 3), ("small_1", 0.3, 3)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/source_targets.parquet")
    drawn = queries.p9_mixture(spark, str(tmp_path))
    got = {r["source"]: (r["n"], r["e"]) for r in drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("epoch").alias("e")).collect()}
    assert got["small_1"] == (30, 2) and sum(n for n, _ in got.values()) == pytest.approx(910, abs=2)
    assert got["big_1"] == (600, 0) and got["big_2"][0] == pytest.approx(280, abs=2)
    shares = {(r["mixture"], r["source"]): r["n_texts"] for r in queries.p9_shares(spark, str(tmp_path)).collect()}
    assert shares["one_epoch", "small_1"] == 30 and sum(n for (m, _), n in shares.items() if m == "one_epoch") == sum(n for n, _ in got.values())
    assert queries.p9_largest_exact(spark, str(tmp_path)).count() == pytest.approx(100, abs=2)


# --- 10: subjects ----------------------------------------------------------------------------


def test_term_ids_join_scripts():
    assert subjects.term("बैठक") == subjects.term("baithak") != 0 and subjects.term("a1") == 0 and subjects.term("x") == 0


def test_body_sentences():
    text = "Regarding the leave record\nGovernment of the Province\nOne is here. Two is here.\n\nThree is here.\nBy order and in the name of the Head of the Province.\nCopy forwarded to the Crop Department."
    assert [s.strip() for s in subjects.body_sentences("Regarding the leave record", text) if s.strip()] == ["One is here", "Two is here", "Three is here"]


def test_subjects_on_held_out_labels(spark):
    rng = random.Random(10)
    words = {"health": ["clinic", "nurse", "vaccine", "ward", "dialysis"], "sport": ["stadium", "referee", "kabaddi", "medal", "league"], "law": ["court", "petition", "clause", "bail", "tribunal"]}
    frames = ["The office shall report on the {} and the {} soon.", "A plan for the {} is placed before the {} desk.", "No approval is needed for the {} if the {} is complete."]
    docs, truth = [], {}
    for i in range(400):
        mine = rng.sample(sorted(words), rng.choice([1, 1, 2]))
        truth[i] = set(mine)
        docs.append((i, None, " ".join(rng.choice(frames).format(*rng.choices(words[s], k=2)) for s in mine for _ in range(4)) + " " + frames[0].format(*rng.choices(words[rng.choice(sorted(words))], k=2))))
    labels = [(i, s) for i in range(80) for s in truth[i]] + [(3, "nonsense"), (None, "law")]
    df = spark.createDataFrame(docs + [(None, None, "x."), (999, None, None), (1000, None, "")], "doc_id bigint, title string, text string")
    areas = spark.createDataFrame([(s, s.title(), None, None) for s in words], "subject string, label_en string, label_mr string, scope_note string")
    out = subjects.subjects(df, spark.createDataFrame(labels, "doc_id bigint, subject string"), areas).where("n_sentences >= 3").collect()
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert sum(got.get(i) == truth[i] for i in range(80, 400)) / 320 > 0.95
    assert not {999, 1000, None} & set(got)
    assert subjects.subjects(df.limit(0), spark.createDataFrame([], "doc_id bigint, subject string"), areas).count() == 0


def test_regular_expressions_have_no_clash():
    assert re.compile(languages._CLOSING)
