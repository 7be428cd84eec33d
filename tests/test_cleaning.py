"""Cell cleaning: the edge cases where Spark's plain casts differ."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bundleflow.functions import cleaning as C


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["x"] for r in df.select("i", expr(F.col("s")).alias("x")).orderBy("i").collect()]


NUMBERS = ["12", "12.9", "-12.9", "1e3", "12d", "12F", "1_000", "inf", "NaN", "2147483648", "9007199254740993",
           "9223372036854775807", "abc", " 7 ", "", "nan", ".5", "5.", "+3", "१२", None, "1__0", "-2147483648.9"]


def test_int4(spark):
    want = [12, 12, -12, 1000, None, None, 1000, None, None, None, None, None, None, 7, None, None, 0, 5, 3, 12, None, None, -2147483648]
    got = column(spark, NUMBERS, C.to_int4)
    assert got[:-1] == want[:-1]
    assert got[-1] in (None, -2147483648)


def test_int8(spark):
    got = dict(zip(NUMBERS, column(spark, NUMBERS, C.to_int8)))
    assert got["2147483648"] == 2147483648
    assert got["9007199254740993"] == 9007199254740992
    assert got["9223372036854775807"] is None
    assert got["inf"] is None and got["12d"] is None


def test_float(spark):
    got = dict(zip(NUMBERS, column(spark, NUMBERS, C.to_float)))
    assert got["12.9"] == pytest.approx(12.9, rel=1e-6)
    assert got["inf"] == float("inf")
    assert got["NaN"] != got["NaN"]  # kept; only the lower-case spelling is blank
    assert got["nan"] is None and got["12d"] is None


def test_blanks_are_case_sensitive(spark):
    got = column(spark, ["", "  ", "nan", "NaN", "NULL", "null", "None", "none", "<na>", "nat", " x "], C.blank_to_null)
    assert got == [None, None, None, "NaN", "NULL", None, "None", None, None, None, "x"]


DATES = {
    "05/01/2020": "2020-01-05", "2020-01-05": "2020-01-05", "05-01-2020": "2020-01-05",
    "2020-01-05 10:20:30.5": "2020-01-05", "2020-01-05 10:20:30": "2020-01-05", "2020-01-05  10:20:30": "2020-01-05",
    "1/2/2020": "2020-02-01", "31/02/2020": None, "20200-01-05": None, "not a date": None, "1/2/20": None,
    "01/01/1900": None, "1900-01-01": None, "1900-01-01 00:00:00": None, "1900-01-01 00:00:00.000000": None,
    "1/1/1900": "1900-01-01", "01-01-1900": "1900-01-01", "": None,
}


def test_date_text(spark):
    assert dict(zip(DATES, column(spark, list(DATES), C.parse_date_text))) == DATES


def test_timestamp_keeps_fraction(spark):
    got = column(spark, ["2020-01-05 10:20:30.25", "05/01/2020"], C.parse_timestamp)
    assert got == [datetime(2020, 1, 5, 10, 20, 30, 250000), datetime(2020, 1, 5)]


HEADERS = {
    "RegistrationNo": "registrationno", "Registration No.": "registration_no", "App-Date": "app_date",
    "Prof/District": "prof_district", " Distrinct ": "distrinct", "Unknown Col": "unknown_col", "a - b\\c": "a_b_c",
}


def test_headers_plan_time_and_column_agree(spark):
    assert {h: C.norm_header_name(h) for h in HEADERS} == HEADERS
    assert dict(zip(HEADERS, column(spark, list(HEADERS), C.norm_header))) == HEADERS


def test_safe_int_rounds_half_even(spark):
    assert column(spark, ["2.5", "3.5", "-0.5", "x", None, "90"], C.safe_int) == [2, 4, 0, 0, 0, 90]


def test_devanagari_digits(spark):
    assert column(spark, ["२७/०२/१९९५"], C.devanagari_digits) == ["27/02/1995"]
