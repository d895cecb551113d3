import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadsky.functions import conditions, speed, tails, text, times
from roadsky.functions.weather_words import RATING_LEVELS, WEATHER_WORDS


def column(spark, values, kind, *expressions):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.orderBy("i").select(*expressions).collect()
    return [row[0] if len(row) == 1 else tuple(row) for row in rows]


def substring_rating(value, words=WEATHER_WORDS):
    if value is None or not value.strip():
        return "unknown"
    for rating, entries in words.items():
        if any(entry.lower() in value.lower() for entry in entries):
            return rating
    return "unknown"


def exact_rating(value):
    if value is not None:
        for rating, entries in WEATHER_WORDS.items():
            if value.strip() in entries:
                return rating
    return "unknown"


def condition_texts():
    rng = random.Random(4)
    known = [entry for entries in WEATHER_WORDS.values() for entry in entries]
    mixed = [f"{rng.choice(known)} ;{rng.choice(known)}" for _ in range(200)]
    cut = [entry[rng.randrange(3) : len(entry) - rng.randrange(3)] for entry in known]
    return known + mixed + cut + [k.upper() for k in known] + [f" {k}\t" for k in known] + [
        None, "", "  ", "\t", "Meteor", "fair", "Fair ", "FAIRLY odd", "windy",
    ]


def test_dictionary_sizes():
    assert {k: len(v) for k, v in WEATHER_WORDS.items()} == {"good": 8, "bad": 143, "neutral": 23}
    assert len({e for entries in WEATHER_WORDS.values() for e in entries}) == 174
    assert RATING_LEVELS == ("good", "bad", "neutral", "unknown")


def test_ratings_match_plain_search(spark):
    values = condition_texts()
    found = column(
        spark, values, "string",
        conditions.rating_substring(F.col("v")), conditions.rating_exact(F.col("v")),
    )
    assert found == [(substring_rating(v), exact_rating(v)) for v in values]


def test_needles_decide_like_the_whole_list(spark):
    words = {"good": ["ab", "xaby", "q"], "bad": ["cab", "c", "dd"], "neutral": ["d", "ddd", "zq", "q"]}
    rng = random.Random(1)
    values = ["".join(rng.choice("abcdqxyz") for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    found = column(spark, values, "string", conditions.rating_substring(F.col("v"), words))
    assert found == [substring_rating(v, words) for v in values]
    assert sum(len(v) for v in conditions.needles().values()) < 40


def test_rating_from_table_keeps_every_row(spark):
    df = spark.createDataFrame([("Fair ",), ("Odd",), (None,)], "c string")
    table = spark.createDataFrame([("Fair", "good")], "entry string, rating string")
    rated = conditions.rating_from_table(df, "c", table, "r").collect()
    assert {(row.c, row.r) for row in rated} == {("Fair ", "good"), ("Odd", "unknown"), (None, "unknown")}


def test_speed_forms(spark):
    values = [None, "", "Fast", " fast ", "FAST", "Slow 25.5 mph", "moderately slow", "1.2.3", ".", "30"]
    c = F.col("v")
    info = speed.speed_info(c)
    found = column(
        spark, values, "string",
        speed.speed_number(c), info["category"], info["numeric"], speed.speed_category(c),
        speed.speed_digits(c), speed.speed_ordinal(c),
    )
    assert found == [
        (None, "Unknown", None, "Unknown", None, 0),
        (None, "Unknown", None, "Unknown", None, 0),
        (60.0, "fast", 60.0, "Fast", None, 1),
        (None, "fast", 60.0, "Unknown", None, 0),
        (60.0, "fast", 60.0, "Unknown", None, 1),
        (None, "slow", 20.0, "Slow", 25.5, 0),
        (None, "moderate", 40.0, "Unknown", None, 0),
        (None, "Unknown", None, "Unknown", None, 0),
        (None, "Unknown", None, "Unknown", None, 0),
        (None, "Unknown", None, "Unknown", 30.0, 0),
    ]


def test_times_and_spans(spark):
    same = ["2019-06-07T16:46:00.000-04:00", "2019-06-07T20:46:00.000Z", "2019-06-07T22:46:00.000+02:00"]
    bad = [None, "", "yesterday", "2019-06-07", "2019-13-07T16:46:00.000-04:00"]
    found = column(spark, same + bad, "string", times.parse_offset_time(F.col("v")).cast("long"))
    assert found == [1559940360] * 3 + [None] * 5
    start = F.lit("2020-01-01 00:00:00.9").cast("timestamp")
    end = F.lit("2020-01-01 00:01:01.1").cast("timestamp")
    row = spark.range(1).select(times.minutes_between(start, end), times.minutes_between_exact(start, end)).first()
    assert row[0] == 61 / 60 and row[1] == pytest.approx(60.2 / 60)
    loose = column(spark, ["2019-06-07 01:00:00", "x", None], "string", times.parse_any_time(F.col("v")).isNull())
    assert loose == [False, True, True]


def test_spans_do_not_depend_on_the_session_zone(spark):
    values = ["2021-03-14T06:30:00.000+00:00", "2021-03-14T07:45:30.500+00:00"]
    start, end = (times.parse_offset_time(F.lit(value)) for value in values)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = spark.range(1).select(times.minutes_between(start, end), times.minutes_between_exact(start, end)).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row[0] == 75.5 and row[1] == pytest.approx(75 + 30.5 / 60)


def test_formula_texts(spark):
    df = spark.createDataFrame([("Traffic Jam", ["a(b)", "c"])], "t string, p array<string>")
    t, p = F.col("t"), F.col("p")
    row = df.select(
        text.formula(t, p), text.formula_plain(t, p), text.formula_interactions(t, p), text.model_label(t, p),
        text.list_to_text(p), text.list_from_text(F.lit("['a(b)', 'c']")), text.without_quotes(F.lit("'a' \"b\"")),
        text.four_decimals(F.lit(0.12345)),
    ).first()
    assert list(row) == [
        "Traffic Jam ~ (a(b) + c)", "Traffic Jam ~ a(b) + c", 'Q("Traffic Jam") ~ (Q("a(b)") + c)**2',
        "weather_to_Traffic Jam_a(b)_c", "[a(b), c]", ["a(b)", "c"], "a b", "0.1235",
    ]


def test_logs_are_null_outside_their_domain(spark):
    found = column(spark, [-2.0, -1.0, 0.0, 1.0, None], "double", text.log_label(F.col("v")), text.log_value(F.col("v")))
    assert found[0] == (None, None) and found[1] == (None, None) and found[2] == (0.0, None)
    assert found[3] == (pytest.approx(math.log(2)), 0.0) and found[4] == (None, None)


def test_tails_against_the_library_on_the_jvm(spark):
    laws = spark._jvm.org.apache.commons.math3.distribution
    for df in (1, 2, 3, 7, 30, 150, 199, 200, 1000, 10**6):
        law = laws.TDistribution(None, float(df))
        for t in (0.0, 0.3, 1.0, 1.96, 2.5, 6.0):
            expected = 2 * law.cumulativeProbability(-t)
            assert float(tails.t_two_sided(-t, df)) == pytest.approx(expected, rel=1e-7, abs=1e-12)
    for df in (1, 2, 3, 6, 15):
        law = laws.ChiSquaredDistribution(None, float(df))
        for x in (0.0, 0.01, 1.0, 5.0, 40.0):
            assert tails.chi2_tail(x, df) == pytest.approx(1 - law.cumulativeProbability(x), rel=1e-6, abs=1e-13)
    assert float(tails.normal_two_sided(1.959963984540054)) == pytest.approx(0.05, abs=1e-12)
    assert np.isnan(tails.t_two_sided(np.nan, 5)) and tails.t_two_sided(np.inf, 5) == 0
