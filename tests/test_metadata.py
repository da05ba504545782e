"""Header fields and printed references, on literal headers."""

import pytest
from pyspark.sql import functions as F

from daftar.functions import metadata, text as tx


def refs(block):
    return [n for n, _ in metadata._read_references(block)]


@pytest.mark.parametrize(
    "block, want",
    [
        ("१) शासन निर्णय, कृषी विभाग, क्र. कृषी-२०१०/(१९३/१०) /का-४, दि. ३०.१०.२०१०.\n२) क्र. कृषी-२०१२/(२४७/१२) /का-४, दि. ०२.०९.२०१३.", ["कृषी-२०१०/(१९३/१०) /का-४", "कृषी-२०१२/(२४७/१२) /का-४"]),
        ("१) शासन निर्णय क्र. कृषी विभाग, क्र. संकीर्ण २०११/प्र.क्र. १३६/का-३, दिनांक - १८/०७/२०११.", ["संकीर्ण २०११/प्र.क्र. १३६/का-३"]),
        ("शासन निर्णय कृषी विभाग क्र. संकीर्ण २०११/प्र.क्र. १३६/का-३ दि. १८/०७/२०११.", ["संकीर्ण २०११/प्र.क्र. १३६/का-३"]),
        ("शासन परिपत्रक क्र. अन-२०२०/प्र.क्र.१०२/का-४, दि.०८/०३/२०१७.", ["अन-२०२०/प्र.क्र.१०२/का-४"]),
        ("क्र. अन-२०२३/प्र.क्र.४५/का-४.\nडोंगराळ / दुर्गम भागासाठी प्राधान्य द्यावे.", ["अन-२०२३/प्र.क्र.४५/का-४"]),
        ("Order No. A-1/2 (2) B-3/4; C/5", ["A-1/2", "B-3/4", "C/5"]), ("1) Rule No 7/B  and 8/C\n2) 9/D", ["7/B", "9/D"]), ("", []), (None, []), ("12/03/2017", []), ("x" * 90 + "/1", []),
    ],
)
def test_printed_numbers(block, want):
    assert refs(block) == want


def test_dates_stay_with_their_item():
    got = metadata._read_references("१) क्र. अ/१, दि. ३० ऑक्टोबर, २०१०.\n२) क्र. ब/२.\n३) क्र. क/३, दि. ०२.०९.२०१३")
    assert [(n, bool(d)) for n, d in got] == [("अ/१", True), ("ब/२", False), ("क/३", True)] and got[0][1].startswith("३० ऑक्टोबर")


def test_sections(spark):
    text = "शासन निर्णय क्रमांक: अ-१/२०२४\nवाचा : १) शासन निर्णय, वित्त विभाग, क्र. ब/४५, दि. ०८.०३.२०१७.\nविषय : नियोजन विभाग यांचेकडील प्रस्तावाबाबत\nप्रस्तावना : इतर विभाग यांनी कळविले आहे.\n"
    df = spark.createDataFrame([("a", text), ("b", "शासन निर्णय क्रमांक: अ-१/२०२४\nविषय : काही तरी\n"), ("c", "वाचा : शासन निर्णय क्र. ब-२०२३/४५."), ("d", None), ("e", "नवीन विषय व तुकड्या मंजुरीबाबत दिलेला निर्णय.\nआदेश क्रमांक: ११/(२०/१५)/तां-२, दि. २३ मे, २०१८")], "id string, t string")
    block = {r["id"]: r["b"] for r in df.select("id", metadata.reference_block(F.col("t")).alias("b")).collect()}
    assert "वित्त विभाग" in block["a"] and "नियोजन" not in block["a"] and "इतर" not in block["a"] and block["b"] == "" and "ब-२०२३" in block["c"]
    got = {r["id"]: r for r in metadata.fields(df, "id", "t").collect()}
    assert got["a"]["title"] == "नियोजन विभाग यांचेकडील प्रस्तावाबाबत" and got["a"]["gr_number"] == "अ-१/२०२४" and got["e"]["gr_number"] == "११/(२०/१५)/तां-२"
    assert got["e"]["date"] is None and got["e"]["title"].startswith("नवीन विषय") and got["d"]["gr_number"] is None and got["d"]["title"] is None


def test_extract_keeps_other_columns_and_rows(spark):
    df = spark.createDataFrame([("a", "Dated 1 May 2024", "mine", 7), ("a", "Dated 1 May 2024", "mine", 7)], "id string, t string, date string, refs_seen int")
    got = metadata.extract(df, "id", "t").collect()
    assert len(got) == 2 and got[0]["date"] == "2024-05-01" and got[0]["refs_seen"] == 7 and got[0]["refs"] == []
    assert metadata.extract(df.limit(0), "id", "t").count() == 0


def test_number_shape(spark):
    want = {"A/1": True, "A-1": False, "12/03/2017": False, "१२.०३.२०१७.": False, "12/03/2017.": False, "1/2/3/4": True, "x/" + "1" * 80: False, "a/b": False, "12/3/x": True}
    df = spark.createDataFrame([(k,) for k in want], "v string")
    assert {r["v"]: r["n"] for r in df.select("v", tx.looks_like_number(F.col("v")).alias("n")).collect()} == want


def test_titles_keep_the_digits_at_their_ends(spark):
    df = spark.createDataFrame([("a", "x\n12 A line of more than 25 letters 1\n"), ("b", "1 The first line of the letter 0")], "id string, t string")
    assert {r["id"]: r["title"] for r in metadata.fields(df, "id", "t").collect()} == {"a": "12 A line of more than 25 letters 1", "b": "1 The first line of the letter 0"}
