"""Projection, conversion, validation and date parts on small literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.frame import MissingColumnError, PreconditionError, resolve_columns
from millrace.functions import dates, numbers, text
from millrace.operators import columns as C


def mapped(spark, values, use):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", use(F.col("t")).alias("x")).orderBy("i").collect()]


def test_names_are_resolved_without_case(spark):
    df = spark.createDataFrame([(1, 2)], "Age int, `a.b` int")
    assert resolve_columns(df, ["AGE", "A.B"]) == ["Age", "a.b"]
    with pytest.raises(MissingColumnError):
        resolve_columns(df, ["nope"])


def test_missingness_indicator(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, None), (None, "z"), (float("nan"), "w")], "A double, B string")
    out = C.add_missingness_indicator(df, ["A"]).collect()
    assert [r.A_was_missing for r in out] == [0, 0, 1, 1]
    both = C.add_missingness_indicator(df, ["A", "B"], drop_original=True)
    assert both.columns == ["A_was_missing", "B_was_missing"]
    assert {r.column: r.n_missing for r in C.missing_counts(df, ["A", "B"]).collect()} == {"A": 2, "B": 1}
    with pytest.raises(PreconditionError):
        C.add_missingness_indicator(df, ["Z"])


def test_title_case(spark):
    assert mapped(spark, ["o'neil", "hello-world abc1def", "JANE SMITH", None, ""], text.title_case) == [
        "O'Neil", "Hello-World Abc1Def", "Jane Smith", None, ""]


def test_parse_numbers(spark):
    given = ["$1,234.5", "1,200%", "50%", "-$3", "abc", "5d", "1e3", "1_000", "  7 ", "", None, "€5", "inf"]
    assert mapped(spark, given, numbers.parse_number) == [
        1234.5, 12.0, 0.5, -3.0, None, None, 1000.0, 1000.0, 7.0, None, None, 5.0, float("inf")]


def test_extract_numbers(spark):
    given = ["$4308.85", "3868.9 usd", "Price: 45.0", "Rs. 1,234.56", "34675 usd!!!", "FREE", None, "", "-5 C"]
    assert mapped(spark, given, numbers.extract_number) == [
        4308.85, 3868.9, 45.0, 1234.56, None, None, None, None, -5.0]
    df = spark.createDataFrame([("a 1",), ("b",)], "t string")
    assert C.extract_numeric(df, ["t"], "drop").collect()[0].t == 1.0


def test_numbers_to_words(spark):
    given = {"0": "zero", "30": "thirty", "105": "one hundred and five", "88.5": "eighty-eight point five",
             "1234": "one thousand, two hundred and thirty-four", "2021": "two thousand and twenty-one",
             "1001005": "one million, one thousand and five", "1000100": "one million, one hundred",
             "-0.5": "minus zero point five", "-12": "minus twelve", "12.05": "twelve point zero five",
             "hello": "hello", "1e3": "one thousand", "1050000": "one million, fifty thousand"}
    assert mapped(spark, list(given), numbers.text_to_words) == list(given.values())


def test_both_ways_of_number_words_agree(spark):
    """Arithmetic and the digits of the text, over whole numbers, fractions and the edges between the two."""
    whole = [0, 1, 19, 20, 99, 100, 101, 999, 1000, 1001, 999_999, 10**6, 10**9 + 7, 10**12, 123_456_789_012_345, 10**15 - 1, 10**15, 10**18, -1, -2**63, 2**63 - 1]
    whole += [10**k + d for k in range(1, 18) for d in (-1, 1, 23)]
    longs = spark.createDataFrame([(v,) for v in whole], "x long")
    parts = [float(v) for v in whole] + [0.5, -0.0, -0.25, 12.05, 1234567.125, 9999999.5, 10000000.5, 0.001, 0.00099, 1e-9, 1e15, 1e22, 1.7e308, float("nan"), float("inf")]
    doubles = spark.createDataFrame([(v,) for v in parts], "x double")
    exact = spark.sql("SELECT CAST(v AS DECIMAL(38, 4)) AS x FROM VALUES ('0.1000'), ('-7.0000'), ('123456789012345678901234.5'), ('10000000.25') AS t(v)")
    for df in (longs, doubles, exact):
        rows = df.select("x", numbers.number_to_words(F.col("x")).alias("a"), numbers.printed_number_words(F.col("x")).alias("b")).collect()
        assert all(r.a == r.b for r in rows), [tuple(r) for r in rows if r.a != r.b][:3]


def test_words_to_numbers(spark):
    given = {"thirty": 30, "One Hundred and five": 105, "two thousand twenty-one": 2021, "88": 88, "abc": None,
             "two point five": 2.5, "million": 1e6, "one million, two hundred thousand and six": 1200006,
             "one thousand two million": None, "-5": -5, "point": None, "": None}
    assert mapped(spark, list(given), numbers.text_to_number) == list(given.values())


def test_convert_types(spark):
    df = spark.createDataFrame([(" Yes", 1, 30.0, "n/a"), ("0", 0, None, "thirty"), ("maybe", None, 2.5, None)],
                               "flag string, n int, x double, words string")
    out = C.convert_type(C.convert_type(df, ["flag", "n"], "boolean"), ["x"], "string").collect()
    assert [r.flag for r in out] == [True, False, None] and [r.n for r in out] == [True, False, None]
    assert [r.x for r in out] == ["30.0", None, "2.5"]
    words = C.convert_type(df, ["words"], "text_to_numeric", keep_unparsed=True).collect()
    assert [(r.words, r.words_unparsed) for r in words] == [(None, "n/a"), (30.0, None), (None, None)]
    assert [r.x for r in C.convert_type(df, ["x"], "numeric_to_text").collect()] == ["thirty", None, "two point five"]
    with pytest.raises(ValueError):
        C.convert_type(df, ["x"], "complex")


def test_standard_dates(spark):
    given = {"2023-01-15": "2023-01-15", "2023/1/5 10:00": "2023-01-05", "13/02/2021": "2021-02-13",
             "02/13/2021": "2021-02-13", "1/5/23": "2023-01-05", "15-Jan-2023": "2023-01-15",
             "January 5th, 2023": "2023-01-05", "20230115": "2023-01-15", "EMP-001": None, "12345": None,
             "Purchased on 2020-02-30": None, "Date: March 3 2021": "2021-03-03", "1850-01-01": None, "hello": None}
    assert mapped(spark, list(given), dates.standard_date) == list(given.values())


def test_texts_that_are_one_date(spark):
    given = {
        "Mon, 05 Jan 2021": "2021-01-05 00:00:00", "Tue, 5 Jan 2021 10:20:30 GMT": "2021-01-05 10:20:30", "Monday, January 5th, 2021 3:04 pm": "2021-01-05 15:04:00",
        "January 2021": "2021-01-01 00:00:00", "Sept. 2020": "2020-09-01 00:00:00", "Janxyz 5, 2021": None, "Marching 2021": None, "5-Sept-2021": "2021-09-05 00:00:00",
        "2021-01-05T10:20:30+02:00": "2021-01-05 10:20:30", "2021/1/5 10:20:30.25 +0200": "2021-01-05 10:20:30.250000", "2021-01": "2021-01-01 00:00:00",
        "13/02/21": "2021-02-13 00:00:00", "02/13/70 12:00 AM": "1970-02-13 00:00:00", "2/3/68": "2068-02-03 00:00:00", "31.04.2021": None, "20210105": "2021-01-05 00:00:00",
        "20211301": None, "5 January 2021 25:00": None, "5 January 2021 13:00 pm": None, "2021.01.05 10:60": None, "5 January 2021 10:20:60": None, "soon": None, "": None,
        "a\u00012021\u00011\u00015": None, None: None}
    got = mapped(spark, list(given), dates.parse_timestamp)
    assert [g and str(g) for g in got] == list(given.values())


def test_validate_dates_drops_the_bad_row(spark):
    rows = [(i, f"2023-01-{i + 1:02d}" if i != 7 else "invalid_date") for i in range(20)]
    df = spark.createDataFrame(rows, "id int, join_date string")
    assert C.validate_format(df, ["join_date"], "date").count() == 19
    nulled = C.validate_format(df, ["join_date"], "date", "set_null")
    assert nulled.count() == 20 and nulled.filter("join_date IS NULL").collect()[0].id == 7


@pytest.mark.parametrize("kind,good,bad", [
    ("email", ["a.b+c@x-y.co.uk"], ["a@b", "a b@c.d", None]),
    ("phone", ["+1 (555) 123-4567", "1234567"], ["123", "call me"]),
    ("url", ["http://a.example.com/x/y.html", "example.org"], ["http://", "no url"]),
    ("ip_address", ["999.1.1.1"], ["1.2.3", "1.2.3.4.5"]),
    ("credit_card", ["4111111111111111", "340000000000009"], ["1234567890123456"]),
    ("aadhaar", ["2345 6789 0123", " 998877665544 "], ["1345 6789 0123"]),
    ("numeric", [" -12.50 ", "٣"], ["12.", "1e5"]),
    ("date", ["2021-1-31", "31/12/2021 10:20:30", "2021-01-31T10:20:30.5Z"], ["2021.01.31", "soon"]),
])
def test_formats(spark, kind, good, bad):
    assert mapped(spark, good + bad, lambda c: text.matches_format(c, kind)) == [True] * len(good) + [False] * len(bad)


def test_custom_format_is_anchored_at_the_start_only(spark):
    df = spark.createDataFrame([("ab1",), ("xab",), (None,)], "t string")
    assert [r.t for r in C.validate_format(df, ["t"], "custom", pattern="ab|zz").collect()] == ["ab1"]


def test_datetime_components(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 1, 15, 14),), (dt.datetime(2023, 2, 28, 9, 30),), (None,)], "dt timestamp_ntz")
    out = C.extract_datetime_components(df, "dt", list(dates.COMPONENTS)).collect()
    assert (out[0].dt_year, out[0].dt_month, out[0].dt_hour, out[0].dt_dayofweek, out[0].dt_is_weekend) == (2023, 1, 14, 6, 1)
    assert (out[1].dt_is_month_end, out[1].dt_minute, out[1].dt_weekofyear) == (1, 30, 9)
    assert out[2].dt_year is None and out[2].dt_is_weekend == 0
    texts = spark.createDataFrame([("2023-01-15",), ("junk",)], "dt string")
    assert [r.dt_day for r in C.extract_datetime(texts, ["dt"]).collect()] == [15, None]
    with pytest.raises(ValueError):
        C.extract_datetime_components(df, "dt", ["century"])


def test_round_half_even_and_trim(spark):
    df = spark.createDataFrame([(2.5, 0.125, "\t a b \n")], "a double, b double, t string")
    out = C.trim_whitespace(C.round_numeric(C.round_numeric(df, ["a"], 0), ["b"], 2), ["t"]).collect()[0]
    assert (out.a, out.b, out.t) == (2.0, 0.12, "a b")


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id * 2 AS x", "'w' AS wide").write.parquet(path)
    df = C.drop_columns(C.filter_rows(spark.read.parquet(path), "x > 50"), ["wide"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,50)" in plan and "wide" not in plan.split("ReadSchema:")[1]
