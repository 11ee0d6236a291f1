import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, fixed, numbers, text


def apply(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_number_words(spark):
    got = apply(
        spark,
        ["thirty", "Twenty-Eight", "one hundred five", "two thousand three hundred", "zero", "thousand", "-", "", None, "thirty apples"],
        numbers.parse_number_words,
    )
    assert got == [30.0, 28.0, 105.0, 2300.0, 0.0, 1000.0, None, None, None, None]


def test_number_words_plain(spark):
    make = lambda c: numbers.parse_number_words(c, hyphens=False, allow_zero=False)
    assert apply(spark, ["twenty five", "twenty-five", "zero", "one"], make) == [25.0, None, None, 1.0]


def test_numbers(spark):
    plain = apply(spark, ["1", " 2.5 ", "1d", "1,200", "1e3", ".5", "5.", "nan", "inf", "abc", None], numbers.parse_number)
    assert plain == [1.0, 2.5, None, None, 1000.0, 0.5, 5.0, None, None, None, None]
    money = apply(spark, ["£45,000", "$1 200.5", "12", "€x", "₹-7"], numbers.parse_currency)
    assert money == [45000.0, 1200.5, None, None, -7.0]
    assert apply(spark, ["12%", "1,200", "$5", "x"], numbers.parse_formatted_number) == [12.0, 1200.0, 5.0, None]


@pytest.mark.parametrize(
    "value, day",
    [
        ("2023-01-05", (2023, 1, 5)), ("2023/1/5", (2023, 1, 5)), ("15/03/2023", (2023, 3, 15)), ("04/07/2023", (2023, 7, 4)),
        ("04/25/2023", (2023, 4, 25)), ("15-03-2023", (2023, 3, 15)), ("15-03-23", (2023, 3, 15)), ("04-25-70", (1970, 4, 25)),
        ("15 Mar 2023", (2023, 3, 15)), ("Mar 15, 2023", (2023, 3, 15)), ("March 15, 2023", (2023, 3, 15)),
        ("15 March 2023", (2023, 3, 15)), (" 2023-01-05 ", (2023, 1, 5)), ("2023-13-01", None), ("2023-01-40", None), ("150", None),
        ("text", None), ("", None), ("29/02/2023", None),
    ],
)
def test_dates(spark, value, day):
    assert apply(spark, [value], dates.first_date) == [dt.date(*day) if day else None]


def test_date_extras(spark):
    got = apply(spark, ["22.08.2018", "20180822", "01-Jan-2023", "2023-05-06 07:08:09"], lambda c: dates.first_date(c, extra=True))
    assert got == [dt.date(2018, 8, 22), dt.date(2018, 8, 22), dt.date(2023, 1, 1), dt.date(2023, 5, 6)]


def test_careful_dates(spark):
    values = ["2023-13-01", "22-08-2018", "22.08.2018", "2018/08/22", "20180822", "05/02/2023", "25/02/2023", "02/25/2023", "45/45/2023"]
    assert apply(spark, values, dates.careful_date) == [
        "2023-13-01", "2018-08-22", "2018-08-22", "2018-08-22", "2018-08-22", "05/02/2023", "2023-02-25", "2023-02-25", "45/45/2023",
    ]
    assert apply(spark, values, dates.is_ambiguous_date) == [False] * 5 + [True] + [False] * 3


def test_format_hits_follow_the_list(spark):
    [hits] = apply(spark, ["05/02/2023"], dates.format_hits)
    assert [f for f, h in zip(dates.ALL_FORMATS, hits) if h] == ["%d/%m/%Y", "%m/%d/%Y"]
    assert apply(spark, ["05-02-2023"], dates.first_format) == ["%d-%m-%Y"]


def test_text(spark):
    assert apply(spark, ["\t a b \n", "x ", None], text.trimmed) == ["a b", "x", None]
    assert apply(spark, ["mary-jane o'neil", "USA", "été x1y"], text.title_case) == ["Mary-Jane O'Neil", "Usa", "Été X1Y"]
    assert apply(spark, [" N/A", "Not_Available", "tbd", "x"], text.is_null_like) == [True, True, False, False]
    assert apply(spark, ["a@b.co", "a@b", "a b@c.de"], text.email_shaped) == [True, False, False]
    assert apply(spark, ["  Two   Words "], text.query_key) == ["two words"]


def test_corrected_skewness_matches_the_sample_formula(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    got = df.select(numbers.corrected_skewness(F.count("x"), F.skewness("x"))).first()[0]
    assert got == pytest.approx(1.763633, abs=1e-6)
    flat = spark.createDataFrame([(5.0,)] * 4, "x double")
    assert flat.select(numbers.corrected_skewness(F.count("x"), F.skewness("x"))).first()[0] == 0.0


def test_token_lists_are_folded():
    assert all(t == t.lower().strip() for t in fixed.REPORT_NULL_TOKENS)
