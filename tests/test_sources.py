from pyspark.sql import functions as F

from daftar.functions import metadata
from daftar.sources import register
from daftar.streaming import ingest

HEADER = """# Page 1
पाणी पुरवठा कामांच्या देखभालीबाबत सुधारित सूचना देण्याबाबत.
महाराष्ट्र शासन
पाणी पुरवठा विभाग
शासन निर्णय क्रमांक: पापु-२०२२/प्र.क्र.७/का-३
दिनांक: ५ मार्च, २०२२
संदर्भ: १) शासन निर्णय, पाणी पुरवठा विभाग, क्र. पापु-२०१८/(४४/१८) /का-३, दि. १२.११.२०१८.
२) शासन निर्णय क्र. पाणी पुरवठा विभाग, क्र. पापु २०१९/प्र.क्र. २१/का-३, दिनांक - १८/०७/२०१९.
३) पापु-२०१८/(४४/१८)/का-३
४) पापु-२०२२/प्र.क्र.७/का-३, दि. ०१/०१/२०२०
प्रस्तावना: सदर शासन निर्णय अधिक्रमित करण्यात येत आहे.
"""


def test_header(spark):
    df = spark.createDataFrame([("a", HEADER), ("b", None), ("c", ""), ("d", "Government Resolution No.: EDU-2020/C.R.5/D-1 Dated 3 May 2020\nDate: 15 June 2023\nLearning Department\nSubject: The meal.\nRead: nothing here")], "id string, text string")
    got = {r["id"]: r for r in metadata.extract(df, "id", "text").collect()}
    a = got["a"]
    assert (a["gr_number"], a["date"], a["department"], a["language"], a["supersedes"]) == ("पापु-२०२२/प्र.क्र.७/का-३", "2022-03-05", "पाणी पुरवठा विभाग", "mr", True)
    assert a["title"].startswith("पाणी पुरवठा कामांच्या") and a["category"] == "government resolution (GR)"
    assert [tuple(r) for r in a["refs"]] == [("पापु-२०१८/(४४/१८) /का-३", "2018-11-12"), ("पापु २०१९/प्र.क्र. २१/का-३", "2019-07-18")]
    assert got["b"]["gr_number"] is None and got["b"]["refs"] in (None, []) and got["c"]["title"] is None
    d = got["d"]
    assert (d["gr_number"], d["date"], d["department"], d["title"], d["supersedes"]) == ("EDU-2020/C.R.5/D-1", "2020-05-03", "Learning Department", "The meal.", False)


def test_dates_in_lines(spark):
    want = {"Dated: 15 June 2023": "2023-06-15", "दिनांक: ३०.१०.२०१०": "2010-10-30", "Dated: 02.09.13": "2013-09-02", "94 सप्टेंबर, 2028": None, "30/02/2023": None, "15/13/2023": None, "21/01/0201": None, "01/01/1900": "1900-01-01", "31/12/2035": "2035-12-31", "2024-04-10": "2024-04-10", "१४०२५/११/२०२३": None}
    df = spark.createDataFrame([(k,) for k in want], "v string")
    assert {r["v"]: r["d"] for r in df.select("v", metadata.iso_date(F.col("v")).alias("d")).collect()} == want


def _write(root, name, text, department="Crop_and_Soil"):
    folder = root / department
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_folder_to_tables(spark, tmp_path):
    _write(tmp_path, "20240115120000001.mr.txt", HEADER)
    _write(tmp_path, "20240116120000002.mr.txt", "no header " * 300)
    _write(tmp_path, "notes.txt", "not an order")
    docs = register.documents(register.order_files(spark, str(tmp_path)))
    got = {r["doc_id"]: r for r in docs.collect()}
    assert {k: (v["department"], v["date"]) for k, v in got.items()} == {"20240115120000001": ("Crop and Soil", "2022-03-05"), "20240116120000002": ("Crop and Soil", "2024-01-16")}
    _write(tmp_path, "20240116120000002.mr.txt", "Dated: 2 May 2020", "Other_Office")
    twice = register.documents(register.order_files(spark, str(tmp_path))).where("doc_id like '%002'")
    assert {(r["department"], r["date"]) for r in twice.collect()} == {("Crop and Soil", "2024-01-16"), ("Other Office", "2020-05-02")} and twice.count() == 2
    ids = [r["faiss_id"] for r in register.pieces(docs, 7).orderBy("gr_id", "chunk_index").collect()]
    assert ids == list(range(7, 7 + len(ids))) and len(ids) == 4
    assert "Number: पापु" in register.as_text(docs).where("doc_id like '%001'").first()["value"]


def test_upsert_keeps_the_latest(spark):
    stored = spark.createDataFrame([("a", 1, "old"), ("b", 1, "b")], "doc_id string, ingested_at int, title string")
    new = spark.createDataFrame([("a", 2, "new"), ("c", None, "c"), (None, 9, "x")], "doc_id string, ingested_at int, title string")
    assert {tuple(r) for r in register.upsert(new, stored, "doc_id", ("ingested_at", "title")).select("doc_id", "title").collect()} == {("a", "new"), ("b", "b"), ("c", "c")}


def test_stream_stores_every_order_once(spark, tmp_path):
    root, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    root.mkdir()
    for text, name in ((HEADER, "20240115120000001.mr.txt"), ("second", "20240116120000002.mr.txt"), ("again", "20240115120000001.v2.mr.txt")):
        _write(root, name, text)
        ingest.ingest(ingest.watch(spark, str(root)), table, state).awaitTermination()
    ingest.ingest(ingest.watch(spark, str(root)), table, str(tmp_path / "fresh")).awaitTermination()  # all files again
    assert sorted(r["doc_id"] for r in spark.read.parquet(table).collect()) == ["20240115120000001", "20240116120000002"]
