from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st

from daftar.operators import timestamps
from daftar.plans import core_queries

CASES = {
    "2013-02-03": ("2013-02-03", "day"),
    " 2019-11-02\t": ("2019-11-02", "day"),
    "२००७-०९-१०": ("2007-09-10", "day"),
    "20/10/2010": ("2010-10-20", "day"),
    "08.02.08": ("2008-02-08", "day"),
    "08.02.85": ("1985-02-08", "day"),
    "15.5.2021": ("2021-05-15", "day"),
    "27-Mar-2014": ("2014-03-27", "day"),
    "2016/04/09": ("2016-04-09", "day"),
    "20250625": ("2025-06-25", "day"),
    "17th June 2023": ("2023-06-17", "day"),
    "20 August, 2018": ("2018-08-20", "day"),
    "२२ जानेवारी, २०२३": ("2023-01-22", "day"),
    "26 अक्टूबर 2021": ("2021-10-26", "day"),
    "March 31, 2012": ("2012-03-31", "day"),
    "1150898697": ("2006-06-21T14:04:57.000000Z", "exact"),
    "1301758827008": ("2011-04-02T15:40:27.008000Z", "exact"),
    "761592540": ("1994-02-18T17:29:00.000000Z", "exact"),
    "2024-03-19T18:05:02+02:00": ("2024-03-19T16:05:02.000000Z", "exact"),
    "2016-07-10 18:26:26+0530": ("2016-07-10T12:56:26.000000Z", "exact"),
    "2025-06-25T12:55:44-03:30": ("2025-06-25T16:25:44.000000Z", "exact"),
    "2023-09-25 19:20:43.436847": ("2023-09-25T13:50:43.436847Z", "exact"),
    "०२.०४.२०१५ १५:२५": ("2015-04-02T09:55:00.000000Z", "exact"),
    "2012-05-16 16:33 IST": ("2012-05-16T11:03:00.000000Z", "exact"),
    "2023-10-29 02:12:37 BST": ("2023-10-29T01:12:37.000000Z", "exact"),
    "Sat, 31 Aug 2013 17:21:57 +0000": ("2013-08-31T17:21:57.000000Z", "exact"),
    "21/02/2023 08:59 AM": ("2023-02-21T03:29:00.000000Z", "exact"),
    "15/12/2015 12:24 PM": ("2015-12-15T06:54:00.000000Z", "exact"),
    "2018-03-18 19:36:06 America/New_York": ("2018-03-18T23:36:06.000000Z", "exact"),
    "2014-04-02T16:01:59[Europe/London]": ("2014-04-02T15:01:59.000000Z", "exact"),
    "2016-11-06 01:14:54 America/New_York": ("2016-11-06T05:14:54.000000Z", "ambiguous"),
    "30/03/2014 01:29 Europe/London": ("2014-03-30T01:29:00.000000Z", "skipped"),
    "01/01/1900": ("1900-01-01", "day"),
    "31/12/2035": ("2035-12-31", "day"),
    **dict.fromkeys(["00/00/0000", "30/02/2023", "15/13/2023", "21/01/0201", "19 January 9202", "78 सप्टेंबर, 2022", "31.04.2013", "01/01/2036", "n.d.", "illegible", "", "   ", "2020-01-01 25:00", "2020-01-01 10:00 Nowhere/Else"], (None, None)),
    None: (None, None),
}


def test_spellings(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(CASES)], "id int, value string")
    got = {r["value"]: (r["normal_form"], r["time_status"]) for r in timestamps.normalise(df, "value").collect()}
    assert got == CASES


def test_counts_of_any_unit(spark):
    cases = {
        "1577836800.5": "2020-01-01T00:00:00.500000Z", "1577836800,1234567": "2020-01-01T00:00:00.123456Z", "1577836800123.25": "2020-01-01T00:00:00.123250Z", "1577836800123456": "2020-01-01T00:00:00.123456Z",
        "1577836800123456789": "2020-01-01T00:00:00.123456Z", "761592540123456789": "1994-02-18T17:29:00.123456Z", "-157766400.25": "1964-12-31T23:59:59.750000Z", "20250625": "2025-06-25", "9999999999999999999": None, "15778368001234567890": None,
    }
    df = spark.createDataFrame(list(cases.items()), "value string, want string")
    assert timestamps.normalise(df, "value").where("not (normal_form <=> want)").collect() == []


def test_plain_day_with_a_newline_is_found(spark, tmp_path):
    spark.createDataFrame([("a", "2020-01-02\n"), ("b", "2020-01-02"), ("c", "1577836800.5")], "doc_id string, date string").write.parquet(f"{tmp_path}/gr_documents.parquet")
    spark.createDataFrame([(1, None)], "edge_id bigint, dst_date string").write.parquet(f"{tmp_path}/gr_edges.parquet")
    got = {(r["row_key"], r["normal_form"]) for r in core_queries.p6_found(spark, str(tmp_path)).collect()}
    assert got == {("a", "2020-01-02"), ("c", "2020-01-01T00:00:00.500000Z")}


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([("2020/01/02", "x", 3, [1])], "value string, normal_form string, year int, spans array<int>")
    out = timestamps.normalise(df, "value")
    assert out.columns == ["value", "year", "spans", "normal_form", "time_status"]
    assert out.first()["normal_form"] == "2020-01-02" and out.first()["year"] == 3
    assert timestamps.normalise(df.limit(0), "value").count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-2_000_000_000, 2_050_000_000), st.sampled_from(["America/New_York", "Europe/London", "Asia/Kolkata", "Australia/Sydney"])), min_size=20, max_size=60))
def test_places_against_brute_force(spark, moments):
    rows = []
    for t, place in moments:
        local = (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=t)).astimezone(ZoneInfo(place)).replace(tzinfo=None, fold=0)
        if 1901 <= local.year <= 2035:
            # fold=0 is the first of two, and the offset before the change for a skipped time
            want = local.replace(tzinfo=ZoneInfo(place)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
            rows.append((f"{local:%Y-%m-%d %H:%M:%S} {place}", want))
    if rows:
        df = spark.createDataFrame(rows, "value string, want string")
        assert timestamps.normalise(df, "value").where("not (normal_form <=> want)").collect() == []
