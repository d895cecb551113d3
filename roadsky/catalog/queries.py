"""The registered queries. Each runs over whole tables; most have a SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsky.catalog import sqltext as S
from roadsky.catalog.views import incidents, readings, table
from roadsky.functions import conditions, speed, text, times
from roadsky.operators import clean, dictionary, fill, ols, profile, ranking, residuals, robust, sample
from roadsky.operators.vectors import assemble, standardise
from roadsky.plans import studies
from roadsky.plans.subsets import (
    check_models,
    count_experiments,
    plan_models,
    with_valid_predictors,
)
from roadsky.schemas import (
    JAM_TARGETS,
    MODEL_LOG_FULL,
    TRAFFIC_TARGETS,
    WEATHER_DUMMIES,
    WEATHER_PREDICTORS,
)
from roadsky.session import scratch_path
from roadsky.sources import tables
from roadsky.sources.quoted_csv import read_quoted_csv
from roadsky.sources.modellog import resume_sweep

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Sums of doubles differ in their last bits from run to run."""
    # adding zero turns -0.0 into 0.0
    return df.withColumns({name: F.round(name, digits) + F.lit(0.0) for name in names})


# ---- grouped impact --------------------------------------------------------


@query(
    "impact_by_rating",
    f"""{S.BASE}, grouped AS (
  SELECT weather_rating, count(*) AS total_incidents, round(avg(speed_digits), 2) AS avg_speed,
    round(avg("DelayFromTypicalTraffic(mins)"), 2) AS avg_delay_typical,
    round(avg("DelayFromFreeFlowSpeed(mins)"), 2) AS avg_delay_freeflow,
    round(100.0::DOUBLE * count_if(speed_category = 'Fast') / count(*), 2) AS pct_fast,
    round(100.0::DOUBLE * count_if(speed_category = 'Moderate') / count(*), 2) AS pct_moderate,
    round(100.0::DOUBLE * count_if(speed_category = 'Slow') / count(*), 2) AS pct_slow
  FROM rated GROUP BY weather_rating)
SELECT *, round(100.0::DOUBLE * total_incidents / (SELECT sum(total_incidents) FROM grouped), 2)
  AS percentage_of_total FROM grouped""",
)
def impact_by_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.impact_tables(incidents(spark, sf_dir))[0]


@query(
    "crosstab_rating_speed",
    f"""{S.BASE} SELECT weather_rating,
  {', '.join(f"round(100.0::DOUBLE * count_if(speed_category = '{k}') / count(*), 2) AS {S.q(k)}" for k in speed.SPEED_LEVELS)}
FROM rated GROUP BY weather_rating""",
)
def crosstab_rating_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.impact_tables(incidents(spark, sf_dir))[1]


_PEARSON = [
    ("Severity", "weather_ordinal"),
    ("DelayFromFreeFlowSpeed(mins)", "weather_ordinal"),
    ("DelayFromTypicalTraffic(mins)", "weather_ordinal"),
    ("speed_ordinal", "weather_ordinal"),
]


@query(
    "pearson_pairs",
    f"""{S.BASE}, numbers AS (
  SELECT "Severity", "DelayFromFreeFlowSpeed(mins)", "DelayFromTypicalTraffic(mins)",
    CASE weather_rating WHEN 'good' THEN 1 WHEN 'bad' THEN -1 ELSE 0 END AS weather_ordinal,
    CASE lower("Congestion_Speed") WHEN 'fast' THEN 1 WHEN 'slow' THEN -1 ELSE 0 END AS speed_ordinal
  FROM rated), whole AS (SELECT * FROM numbers WHERE "Severity" IS NOT NULL
    AND "DelayFromFreeFlowSpeed(mins)" IS NOT NULL AND "DelayFromTypicalTraffic(mins)" IS NOT NULL)
{" UNION ALL ".join(f"SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr({S.q(a)}, {S.q(b)}), 6) AS pearson FROM whole" for a, b in _PEARSON)}""",
)
def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = studies.correlations(incidents(spark, sf_dir), _PEARSON)
    return rounded(pairs, "pearson").withColumnsRenamed({"left": "left_column", "right": "right_column"})


# ---- cleaning --------------------------------------------------------------


@query(
    "clean_exact",
    f"""{S.BASE_CLEAN} SELECT "ID", round("TrafficJamDuration(mins)", 6) AS duration, "SpeedNumeric",
  "GoodWeather", "NeutralWeather", "BadWeather" FROM clean""",
)
def clean_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.clean_exact(incidents(spark, sf_dir))
    df = df.withColumnRenamed("TrafficJamDuration(mins)", "duration")
    names = ("ID", "duration", "SpeedNumeric", "GoodWeather", "NeutralWeather", "BadWeather")
    return rounded(df.select(*names), "duration")


@query(
    "clean_substring",
    f"""{S.BASE_CLEAN} SELECT "ID", round("Traffic Jam Duration", 6) AS duration, speed_numeric,
  speed_found AS speed_category, weather_rating, {', '.join(S.DUMMIES)} FROM clean""",
)
def clean_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.clean_substring(incidents(spark, sf_dir), exact=True)
    df = df.withColumnRenamed("Traffic Jam Duration", "duration")
    names = ("ID", "duration", "speed_numeric", "speed_category", "weather_rating", *WEATHER_DUMMIES)
    return rounded(df.select(*names), "duration")


@query(
    "duration_counts",
    f"""{S.BASE} SELECT count(*) AS n_before, count_if({S.VALID}) AS n_after FROM rated
WHERE has_end AND speed_numeric IS NOT NULL""",
)
def duration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.with_times(incidents(spark, sf_dir), "StartTime", "EndTime")
    df = clean.with_speed_info(clean.not_null_rows(df, "StartTime", "EndTime"))
    return clean.duration_counts(clean.with_duration(clean.not_null_rows(df, "speed_numeric")))


@query(
    "parsed_times",
    f"""WITH {S.INCIDENTS_SQL} SELECT "StartText" AS start_text,
  CAST(timezone('UTC', CAST("StartText" AS TIMESTAMPTZ)) AS TIMESTAMP) AS start_utc,
  count(*) AS n, count_if(has_end) AS n_end FROM incidents GROUP BY ALL""",
)
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = incidents(spark, sf_dir).withColumn("start_text", F.col("StartTime"))
    df = clean.with_times(df, "StartTime", "EndTime")
    wall_clock = F.col("StartTime").cast("timestamp_ntz")
    in_utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), wall_clock)
    return df.groupBy("start_text", in_utc.alias("start_utc")).agg(
        F.count("*").alias("n"), F.count("EndTime").alias("n_end")
    )


@query(
    "exact_minutes",
    """SELECT event_id AS "ID", round(epoch_us(ts - TIMESTAMP '2024-01-01 00:00:00') / 6e7, 9) AS minutes,
  round(CAST(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', date_trunc('second', ts)) AS DOUBLE) / 60, 6)
    AS whole_minutes FROM events""",
)
def exact_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = times.parse_plain_time(F.lit("2024-01-01 00:00:00"))
    df = readings(spark, sf_dir).select(
        "ID",
        times.minutes_between_exact(start, F.col("StartTime").cast("timestamp")).alias("minutes"),
        times.minutes_between(start, F.col("StartTime").cast("timestamp")).alias("whole_minutes"),
    )
    return rounded(rounded(df, "minutes", digits=9), "whole_minutes")


@query(
    "speed_forms",
    f"""{S.BASE} SELECT "Congestion_Speed" AS speed_text, "SpeedNumeric" AS by_word, speed_found AS found_category,
  speed_numeric AS found_number, speed_category AS category, speed_digits AS digits,
  CASE lower("Congestion_Speed") WHEN 'fast' THEN 1 WHEN 'slow' THEN -1 ELSE 0 END AS ordinal, count(*) AS n
FROM rated GROUP BY ALL""",
)
def speed_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one row per text first: the expressions then run on the few distinct texts
    word = F.col("speed_text")
    texts = incidents(spark, sf_dir).groupBy(F.col("Congestion_Speed").alias("speed_text"))
    info = speed.speed_info(word)
    return texts.agg(F.count("*").alias("n")).select(
        "speed_text",
        speed.speed_number(word).alias("by_word"),
        info["category"].alias("found_category"),
        info["numeric"].alias("found_number"),
        speed.speed_category(word).alias("category"),
        speed.speed_digits(word).alias("digits"),
        speed.speed_ordinal(word).alias("ordinal"),
        "n",
    )


@query(
    "condition_forms",
    f"""{S.BASE} SELECT "Weather_Conditions" AS condition, exact_rating, weather_rating AS substring_rating,
  CASE weather_rating WHEN 'good' THEN 1 WHEN 'bad' THEN -1 ELSE 0 END AS ordinal, count(*) AS n
FROM rated GROUP BY ALL""",
)
def condition_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = F.col("condition")
    texts = incidents(spark, sf_dir).groupBy(F.col("Weather_Conditions").alias("condition"))
    rating = conditions.rating_substring(condition)
    return texts.agg(F.count("*").alias("n")).select(
        "condition",
        conditions.rating_exact(condition).alias("exact_rating"),
        rating.alias("substring_rating"),
        conditions.rating_ordinal(rating).alias("ordinal"),
        "n",
    )


@query(
    "rating_dummies",
    f"""{S.BASE} SELECT weather_rating, {', '.join(S.DUMMIES)}, count(*) AS n FROM rated GROUP BY ALL""",
)
def rating_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = clean.with_rating_dummies(clean.with_rating(incidents(spark, sf_dir)))
    return rated.groupBy("weather_rating", *WEATHER_DUMMIES).agg(F.count("*").alias("n"))


@query(
    "rating_from_table",
    f"""WITH {S.READINGS_SQL}, dictionary AS (SELECT DISTINCT event_type AS entry, CASE event_type
    WHEN 'error' THEN 'bad' WHEN 'purchase' THEN 'good' ELSE 'neutral' END AS rating FROM events)
SELECT coalesce(rating, 'unknown') AS weather_rating, count(*) AS n FROM readings
LEFT JOIN dictionary ON trim("Weather_Conditions") = entry GROUP BY 1""",
)
def rating_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    dictionary = table(spark, sf_dir, "events").select(
        kind.alias("entry"),
        F.when(kind == "error", "bad").when(kind == "purchase", "good").otherwise("neutral").alias("rating"),
    )
    rated = conditions.rating_from_table(
        readings(spark, sf_dir), "Weather_Conditions", dictionary.distinct(), "weather_rating"
    )
    return rated.groupBy("weather_rating").agg(F.count("*").alias("n"))


# Words looked for in the documents.
_TEXT_WORDS = {
    "good": ("good", "very good", "clear"),
    "bad": ("error", "fail", "failure"),
    "neutral": ("the", "and the", "und", "que"),
}


@query(
    "document_ratings",
    f"""WITH {S.words_cte(_TEXT_WORDS)}
SELECT doc_id, coalesce((SELECT arg_min(rating, priority) FROM words WHERE contains(lower(text), lower(entry))),
  'unknown') AS rating FROM documents""",
)
def document_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select(
        "doc_id", conditions.rating_substring(F.col("text"), _TEXT_WORDS).alias("rating")
    )


@query(
    "log_values",
    f"""WITH {S.INCIDENTS_SQL} SELECT l_linenumber_text AS "Severity", count(*) AS n, count(log1p_delay) AS n_log1p,
  count(log_delay) AS n_log, round(sum(log1p_delay), 4) AS sum_log1p, round(sum(log_delay), 4) AS sum_log
FROM (SELECT "Severity" AS l_linenumber_text, {S.log1p('DelayFromTypicalTraffic(mins)')} AS log1p_delay,
  CASE WHEN "DelayFromTypicalTraffic(mins)" > 0 THEN ln("DelayFromTypicalTraffic(mins)") END AS log_delay
  FROM incidents) GROUP BY 1""",
)
def log_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    delay = F.col("DelayFromTypicalTraffic(mins)")
    df = clean.to_doubles(incidents(spark, sf_dir), ["Severity"]).select(
        "Severity", text.log_label(delay).alias("log1p_delay"), text.log_value(delay).alias("log_delay")
    )
    grouped = df.groupBy("Severity").agg(
        F.count("*").alias("n"),
        F.count("log1p_delay").alias("n_log1p"),
        F.count("log_delay").alias("n_log"),
        F.sum("log1p_delay").alias("sum_log1p"),
        F.sum("log_delay").alias("sum_log"),
    )
    return rounded(grouped, "sum_log1p", "sum_log", digits=4)


_COERCED = ["Severity", "DelayFromFreeFlowSpeed(mins)", "Precipitation(in)"]


@query(
    "number_coercion",
    f"WITH {S.INCIDENTS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, count({S.q(n)}) AS n_numbers, count_if({S.q(n)} IS NULL) AS n_bad, "
        f"round(sum({S.q(n)}), 3) AS total FROM incidents"
        for n in _COERCED
    ),
)
def number_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.to_doubles(incidents(spark, sf_dir).select(*_COERCED), _COERCED)
    cells = df.unpivot([], _COERCED, "column_name", "number")
    grouped = cells.groupBy("column_name").agg(
        F.count("number").alias("n_numbers"),
        F.count_if(F.col("number").isNull()).alias("n_bad"),
        F.sum("number").alias("total"),
    )
    return rounded(grouped, "total", digits=3)


_FRAME = [*WEATHER_PREDICTORS, *TRAFFIC_TARGETS]


@query(
    "complete_rows",
    f"""{S.BASE_CLEAN} SELECT count(*) AS n_rows, count_if({S.complete(_FRAME)}) AS n_complete,
  count_if("StartText" IS NOT NULL AND "WindChill(F)" IS NOT NULL) AS n_subset FROM clean""",
)
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before and after either deletion, counted in one scan."""
    df = clean.clean_exact(incidents(spark, sf_dir))
    subset = clean.is_complete(df, ["StartTime", "WindChill(F)"])
    df = clean.to_doubles(df.withColumn("in_subset", subset), _FRAME)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(clean.is_complete(df, _FRAME)).alias("n_complete"),
        F.count_if("in_subset").alias("n_subset"),
    )


# ---- profiles --------------------------------------------------------------


@query(
    "describe_model_frame",
    f"""{S.BASE_CLEAN}, {S.frame_cte(WEATHER_PREDICTORS, TRAFFIC_TARGETS)}
{" UNION ALL ".join(f"SELECT '{n}' AS column_name, count({S.q(n)}) AS n, round(avg({S.q(n)}), 6) AS mean, round(stddev_samp({S.q(n)}), 6) AS stddev, round(min({S.q(n)}), 6) AS lowest, round(max({S.q(n)}), 6) AS highest FROM frame" for n in _FRAME)}""",
)
def describe_model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.clean_exact(incidents(spark, sf_dir))
    framed = clean.model_frame(df, WEATHER_PREDICTORS, TRAFFIC_TARGETS)
    described = profile.describe_columns(framed, _FRAME).withColumnsRenamed(
        {"column": "column_name", "count": "n", "min": "lowest", "max": "highest"}
    )
    return rounded(described, "mean", "stddev", "lowest", "highest")


def _missing_sql(table_name: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"Column\", round(100.0::DOUBLE * count_if({condition}) / count(*), 6) "
        f'AS "Missing_Percentage" FROM {table_name}'
        for name, condition in columns.items()
    )


def _blank_sql(name: str) -> str:
    return f"{S.q(name)} IS NULL OR trim({S.q(name)}, {S.BLANKS}) = ''"


@query(
    "missing_share_incidents",
    f"WITH {S.INCIDENTS_SQL} "
    + _missing_sql(
        "incidents",
        # texts that are no number or time still hold a value: they are not missing
        dict.fromkeys(
            ["ID", "Severity", "StartTime", "EndTime", "DelayFromFreeFlowSpeed(mins)", "Precipitation(in)"], "FALSE"
        )
        | {name: _blank_sql(name) for name in ("State", "Congestion_Speed", "Weather_Conditions")}
        | {
            name: f"{S.q(name)} IS NULL"
            for name in (
                "Distance(mi)", "DelayFromTypicalTraffic(mins)", "Temperature(F)", "WindChill(F)", "Humidity(%)",
                "Pressure(in)", "Visibility(mi)", "WindSpeed(mph)",
            )
        },
    ),
)
def missing_share_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the incidents."""
    rows = incidents(spark, sf_dir)
    return rounded(profile.missing_share(rows, rows.columns), "Missing_Percentage")


_DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@query(
    "missing_share_documents",
    _missing_sql(
        "documents",
        {n: _blank_sql(n) if n in ("text", "lang", "source") else f"{n} IS NULL" for n in _DOCUMENT_COLUMNS},
    ),
)
def missing_share_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = profile.missing_share(table(spark, sf_dir, "documents"), _DOCUMENT_COLUMNS)
    return rounded(shares, "Missing_Percentage")


_LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def _counts_sql(table_name: str, names: list[str], zero: tuple[str, ...] = ()) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{n}' AS \"Column\", CAST({n + ' + 0' if n in zero else n} AS VARCHAR) AS \"Value\" FROM {table_name}"
        for n in names
    )
    return (
        f'WITH cells AS ({cells}), counts AS (SELECT "Column", "Value", count(*) AS "Count" FROM cells '
        f'WHERE "Value" IS NOT NULL AND trim("Value") <> \'\' GROUP BY 1, 2)'
    )


def _top_sql(table_name: str, names: list[str], zero: tuple[str, ...] = ()) -> str:
    return f"""{_counts_sql(table_name, names, zero)}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY "Column" ORDER BY "Count" DESC, "Value") AS place,
    sum("Count") OVER (PARTITION BY "Column") AS present FROM counts)
SELECT "Column", "Value", "Count", round(100.0::DOUBLE * "Count" / present, 6) AS "Percentage", place
FROM ranked WHERE place <= 20"""


@query("top_values_lineitem", _top_sql("lineitem", _LINEITEM, ("l_discount", "l_tax")))
def top_values_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    df = df.withColumns({name: F.col(name) + F.lit(0.0) for name in ("l_discount", "l_tax")})
    return rounded(profile.top_values(df, _LINEITEM), "Percentage").withColumnRenamed("rank", "place")


@query(
    "top_values_documents", _top_sql("documents", ["text", "lang", "source", "n_chars"])
)
def top_values_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = profile.top_values(table(spark, sf_dir, "documents"), ["text", "lang", "source", "n_chars"])
    return rounded(top, "Percentage").withColumnRenamed("rank", "place")


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("value_counts_orders", f'{_counts_sql("orders", _ORDER_COLUMNS)} SELECT * FROM counts')
def value_counts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(table(spark, sf_dir, "orders"), _ORDER_COLUMNS)


# ---- samples ---------------------------------------------------------------


@query(
    "sample_orders",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER
  (ORDER BY md5(concat_ws('|', o_orderkey, '7'))) AS place, count(*) OVER () AS n FROM orders)
WHERE place <= floor(n * 0.005::DOUBLE)""",
)
def sample_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = sample.sample_exact(table(spark, sf_dir, "orders"), 0.005, ["o_orderkey"], seed=7)
    return picked.select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "sample_lineitem_pairs",
    """WITH pairs AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem)
SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (
  ORDER BY md5(concat_ws('|', l_returnflag, l_linestatus, '3')),
    md5(concat_ws('|', l_returnflag, l_linestatus, l_linenumber, l_quantity, '3')))
  AS place, count(*) OVER () AS n FROM pairs) WHERE place <= floor(n * 0.3::DOUBLE)""",
)
def sample_lineitem_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six key values only: every key is a large group of copies."""
    pairs = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"
    )
    return sample.sample_exact(pairs, 0.3, ["l_returnflag", "l_linestatus"], seed=3, edge_rows=1000)


@query(
    "split_orders",
    """SELECT CASE WHEN substr(md5(concat_ws('|', o_orderkey, '0')), 1, 5) < 'b3333' THEN 'train' ELSE 'test' END
  AS split, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum FROM orders GROUP BY 1""",
)
def split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = sample.with_split(table(spark, sf_dir, "orders"), ["o_orderkey"], 0.7)
    return split.groupBy("split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query(
    "sample_csv",
    """SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER
  (ORDER BY md5(concat_ws('|', o_orderkey, o_orderpriority, '5'))) AS place, count(*) OVER () AS n FROM orders)
WHERE place <= floor(n * 0.02::DOUBLE)""",
)
def sample_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV to a smaller CSV, rows as text throughout."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    source, target = scratch_path(spark, "orders-csv"), scratch_path(spark, "sample-csv")
    tables.write_csv(orders, source)
    lines = tables.read_incident_csv(spark, source, schema="o_orderkey string, o_orderpriority string")
    tables.write_csv(sample.sample_exact(lines, 0.02, seed=5), target)
    return tables.read_incident_csv(spark, target, schema=orders.schema)


# ---- fills -----------------------------------------------------------------

_AHEAD = 'PARTITION BY "State" ORDER BY "StartTime", "ID" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW'
_BEHIND = 'PARTITION BY "State" ORDER BY "StartTime", "ID" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING'
_FILL_SQL = {
    "forward": f'last_value("Weather_Conditions" IGNORE NULLS) OVER ({_AHEAD})',
    "backward": f'first_value("Weather_Conditions" IGNORE NULLS) OVER ({_BEHIND})',
    "forward_then_backward": f'coalesce(last_value("Weather_Conditions" IGNORE NULLS) OVER ({_AHEAD}), '
    f'first_value("Weather_Conditions" IGNORE NULLS) OVER ({_BEHIND}))',
    "first_seen": f'coalesce("Weather_Conditions", first_value("Weather_Conditions" IGNORE NULLS) OVER ({_AHEAD}))',
}


def _register_fill(method: str, ranges: bool) -> None:
    name = f"fill_{method}" + ("_ranges" if ranges else "")
    sql = (
        f'{S.BASE_READINGS} SELECT "ID", "State", "StartTime", {_FILL_SQL[method]} AS "Weather_Conditions" '
        "FROM readings"
    )

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = readings(spark, sf_dir).drop("value")
        # many ranges, so that groups lie across their bounds
        cut = 200 if ranges else None
        return fill.fill_missing(
            rows, ["Weather_Conditions"], ["State"], "StartTime", ["ID"], method, cut
        ).select("ID", "State", "StartTime", "Weather_Conditions")


for _method in fill.METHODS:
    _register_fill(_method, ranges=False)
    _register_fill(_method, ranges=True)


def _register_csv_fill(method: str) -> None:
    moment = 'CAST("StartText" AS TIMESTAMPTZ)'
    filled = _FILL_SQL[method].replace('"StartTime"', "start_utc")

    @query(
        f"csv_filled_incidents_{method}",
        f"""WITH {S.INCIDENTS_SQL}, timed AS (SELECT "ID", "State",
  CAST(timezone('UTC', {moment}) AS TIMESTAMP) AS start_utc, nullif(trim("Weather_Conditions"), '') AS "Weather_Conditions"
  FROM incidents WHERE "State" IS NOT NULL)
SELECT "ID", "State", start_utc, {filled} AS condition FROM timed""",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Raw rows as CSV: scan, parse, filter, fill along time in each state, write Parquet, read back.

        Many rows of a state share a time. In the file a blank condition is no condition.
        """
        raw = incidents(spark, sf_dir)
        source, target = scratch_path(spark, "raw-csv"), scratch_path(spark, "filled-incidents")
        # text of this kind shrinks to a fraction; a file is still read by one task
        tables.write_csv(raw, source, compression="gzip", rows_a_file=1_000_000)
        filled = studies.filled_incidents(tables.read_incident_csv(spark, source, raw.schema), method)
        slim = clean.renamed(filled, {"Weather_Conditions": "condition"}, drop=["Congestion_Speed", "EndTime"])
        tables.write_parquet(slim, target, sort_by=["State", "StartTime"])
        wall_clock = F.col("StartTime").cast("timestamp_ntz")
        start = F.convert_timezone(F.current_timezone(), F.lit("UTC"), wall_clock).alias("start_utc")
        return tables.read_parquet(spark, target).select("ID", "State", start, F.trim("condition").alias("condition"))


for _method in ("first_seen", "forward_then_backward"):
    _register_csv_fill(_method)


# ---- regression sweeps -----------------------------------------------------

_MEASURES = ("rmse", "r2", "adj_r2")
_OLS_SQL = (
    "model_id, target, array_to_string(predictors, '|') AS predictors, n, round(rmse, 6) AS rmse, "
    "round(r2, 6) AS r2, round(adj_r2, 6) AS adj_r2, n_sig_predictors, "
    "n_sig_predictors + sig_intercept AS n_sig_with_intercept"
)


def _flat(models: DataFrame, *extra) -> DataFrame:
    out = models.select(
        "model_id",
        "target",
        F.array_join("predictors", "|").alias("predictors"),
        "n",
        *_MEASURES,
        "n_sig_predictors",
        "n_sig_with_intercept",
        *extra,
    )
    return rounded(out, *_MEASURES)


def main_sweep(spark: SparkSession, sf_dir: str):
    """Nine predictors, five log targets, at most three predictors: 645 models."""
    return studies.log_study(incidents(spark, sf_dir))


def main_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ols.run_sweep(*main_sweep(spark, sf_dir))


@query("main_sweep", f"{S.MAIN_SWEEP} SELECT {_OLS_SQL}, {S.formula('')} AS formula FROM ols")
def main_sweep_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(main_models(spark, sf_dir), "formula")


@query(
    "main_sweep_coefficients",
    f"""{S.MAIN_SWEEP} SELECT model_id, round(b0, 5) AS intercept, round(b1, 5) AS b1,
  CASE WHEN p > 1 THEN round(b2, 5) END AS b2, CASE WHEN p > 2 THEN round(b3, 5) END AS b3,
  CAST(abs(b1) > 1e-8 AS INT) + CAST(p > 1 AND abs(b2) > 1e-8 AS INT) + CAST(p > 2 AND abs(b3) > 1e-8 AS INT)
    AS n_nonzero FROM ols""",
)
def main_sweep_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = main_models(spark, sf_dir)
    b = {f"b{i}": F.get("coefficients", F.lit(i - 1)) for i in (1, 2, 3)}
    return rounded(
        models.withColumns(b).select("model_id", "intercept", *b, "n_nonzero"), "intercept", *b, digits=5
    )


@query(
    "reversed_sweep",
    f"{S.REVERSED_SWEEP} SELECT {_OLS_SQL}, {S.formula('')} AS formula FROM ols",
)
def reversed_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep, plan = studies.reversed_log_study(incidents(spark, sf_dir))
    return _flat(ols.run_sweep(sweep, plan), "formula")


# with predictors of mean zero the intercept is the label's mean
_SCALED_INTERCEPT = "CAST(abs(my) > t975 * sqrt(s2 / n) AS INT)"


@query(
    "standardised_sweep",
    f"{S.STANDARD_SWEEP} SELECT {_OLS_SQL.replace('sig_intercept', _SCALED_INTERCEPT)}, "
    f"{S.formula('plain')} AS formula, round(my, 5) AS intercept, "
    f"round(b1 * sqrt(s11 * n / (n - 1)), 5) AS first_beta FROM ols",
)
def standardised_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = ols.run_sweep(*studies.standardised_study(incidents(spark, sf_dir)))
    out = _flat(models, "formula", "intercept", F.get("coefficients", F.lit(0)).alias("first_beta"))
    return rounded(out, "intercept", "first_beta", digits=5)


_SINGLE = ("DelayFromTypicalTraffic(mins)", "Precipitation(in)")
_SINGLE_MODEL = [(S.model_id(0, [0]), _SINGLE[0], S.q(_SINGLE[0]), [_SINGLE[1]], [S.q(_SINGLE[1])])]


def _single(spark: SparkSession, sf_dir: str):
    df = clean.to_doubles(incidents(spark, sf_dir), _SINGLE)
    return df, ols.run_sweep(*studies.single_study(df, *_SINGLE))


@query(
    "single_regression",
    f"""{S.BASE}, {S.own_shape(_SINGLE_MODEL, "rated")}, {S._SOLVE}
SELECT {_OLS_SQL}, round(b0, 6) AS intercept, round(b1, 6) AS slope FROM ols""",
)
def single_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = _single(spark, sf_dir)[1]
    out = _flat(models, "intercept", F.get("coefficients", F.lit(0)).alias("slope"))
    return rounded(out, "intercept", "slope")


@query(
    "regression_residuals",
    f"""{S.BASE}, {S.own_shape(_SINGLE_MODEL, "rated")}, {S._SOLVE}
SELECT "ID", round({S.q(_SINGLE[0])} - b0 - b1 * {S.q(_SINGLE[1])}, 5) + 0 AS residual FROM rated, ols
WHERE {S.q(_SINGLE[1])} IS NOT NULL""",
)
def regression_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, models = _single(spark, sf_dir)
    target, predictor = _SINGLE
    rows = clean.complete_rows(df.select("ID", target, predictor), [target, predictor])
    with_residuals = ols.with_residuals(rows, target, [predictor], models.first())
    return rounded(with_residuals.select("ID", "residual"), "residual", digits=5)


_REVERSE_TARGETS = studies.WEATHER_TARGETS


@query(
    "traffic_to_weather_sweep",
    f"{S.solve_models((number, t, S.q(t), names, [S.q(n) for n in names]) for number, t, names in ((S.model_id(i, c), t, [JAM_TARGETS[j] for j in c]) for i, t in enumerate(_REVERSE_TARGETS) for k in (1, 2, 3) for c in combinations(range(6), k)))}"
    f" SELECT {_OLS_SQL} FROM ols",
)
def traffic_to_weather_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(ols.run_sweep(*studies.weather_from_traffic_study(incidents(spark, sf_dir))))


_STATUS_COLUMNS = {
    "quantity": "l_quantity",
    "twice": "2 * l_quantity + 1",
    "tax": "l_tax",
    "rare": "CASE WHEN l_orderkey = 1 AND l_linenumber = 1 THEN l_tax END",
    "price": "l_extendedprice",
    "flat": "5",
    "wild": "CASE WHEN l_linenumber = 3 THEN CAST('Infinity' AS DOUBLE) ELSE l_discount END",
}
_STATUS_PREDICTORS, _STATUS_TARGETS = ["quantity", "twice", "tax", "rare"], ["price", "flat", "wild"]


def _status_sql() -> str:
    cells = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _STATUS_COLUMNS.items())
    models = []
    for target in _STATUS_TARGETS:
        for names in (c for k in (1, 2) for c in combinations(_STATUS_PREDICTORS, k)):
            known = " AND ".join(f"isfinite({n})" for n in (target, *names))
            alike = f"abs(corr({names[0]}, {names[-1]})) > 1 - 1e-9" if len(names) > 1 else "FALSE"
            models.append(
                f"SELECT '{target}' AS target, '{'|'.join(names)}' AS predictors, {len(names)} AS p, count(*) AS n, "
                f"var_pop({target}) < 1e-12 AS constant, coalesce({alike}, FALSE) AS alike FROM cells WHERE {known}"
            )
    told = """SELECT '{mode}' AS collinear, target, predictors, n, CASE WHEN n < p + 2 THEN 'INSUFFICIENT'
  WHEN constant THEN 'CONSTANT_TARGET' WHEN alike THEN '{status}' ELSE 'OK' END AS status FROM models"""
    modes = {"null": "SINGULAR", "shortest": "RANK_DEFICIENT"}
    both = " UNION ALL ".join(told.format(mode=mode, status=status) for mode, status in modes.items())
    return (
        f"WITH cells AS (SELECT {cells} FROM lineitem), models AS ({' UNION ALL '.join(models)}) "
        f"SELECT *, status NOT IN ('OK', 'RANK_DEFICIENT') AS without_measures FROM ({both})"
    )


@query("model_statuses", _status_sql())
def model_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that cannot be fitted, beside others that can: each is a row that tells why."""
    lines = table(spark, sf_dir, "lineitem")
    cells = lines.select(*[F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in _STATUS_COLUMNS.items()])
    plan = plan_models(spark, _STATUS_TARGETS, _STATUS_PREDICTORS, 2)
    found = None
    for mode in ("null", "shortest"):
        sweep = ols.prepare(
            cells, _STATUS_PREDICTORS, _STATUS_TARGETS, log_label=False, missing="per_model", collinear=mode
        )
        models = ols.run_sweep(sweep, plan).select(
            F.lit(mode).alias("collinear"),
            "target",
            F.array_join("predictors", "|").alias("predictors"),
            "n",
            "status",
            F.col("r2").isNull().alias("without_measures"),
        )
        found = models if found is None else found.unionByName(models)
    return found


# ---- heteroskedasticity ----------------------------------------------------

_ROBUST_BASE = S.robust(S.interaction_models(studies.HC3_TARGETS, studies.HC3_PREDICTORS))


def _robust_sql(significant: str, hetero: str) -> str:
    return (
        f"{_ROBUST_BASE} SELECT model_id, {S.formula('interactions')} AS formula, "
        "'weather_to_' || target || '_' || array_to_string(predictors, '_') AS model, n, "
        "round(adj_r2, 6) AS adj_r2, round(bp_stat, 3) AS bp_stat, heteroskedastic, "
        f"{significant} AS significant_vars, {hetero} AS estimation FROM judged"
    )


def _robust_flat(models: DataFrame) -> DataFrame:
    out = models.select(
        "model_id",
        "formula",
        text.model_label(F.col("target"), F.col("predictors")).alias("model"),
        "n",
        "adj_r2",
        "bp_stat",
        (F.col("bp_pvalue") < ols.SIGNIFICANT).alias("heteroskedastic"),
        F.col("n_sig_with_intercept").alias("significant_vars"),
        "estimation",
    )
    return rounded(rounded(out, "adj_r2"), "bp_stat", digits=3)


@query(
    "tested_sweep",
    _robust_sql(
        "CASE WHEN heteroskedastic THEN robust_predictors + robust_intercept "
        "ELSE n_sig_predictors + sig_intercept END",
        "CASE WHEN heteroskedastic THEN 'HC3' ELSE 'OLS' END",
    ),
)
def tested_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep, plan = studies.hc3_study(incidents(spark, sf_dir), 2)
    return _robust_flat(robust.run_robust_sweep(sweep, plan, "tested"))


@query("hc3_sweep", _robust_sql("robust_predictors + robust_intercept", "'HC3'"))
def hc3_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep, plan = studies.hc3_study(incidents(spark, sf_dir), 2)
    return _robust_flat(robust.run_robust_sweep(sweep, plan, "hc3"))


@query(
    "robust_summary",
    f"""{_ROBUST_BASE} SELECT count(*) AS total_models, count_if(heteroskedastic) AS hc3_models,
  count_if(NOT heteroskedastic) AS ols_models, round(100.0::DOUBLE * count_if(heteroskedastic) / count(*), 6)
    AS hc3_percentage FROM judged""",
)
def robust_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep, plan = studies.hc3_study(incidents(spark, sf_dir), 2)
    summary = ranking.robust_summary(robust.run_robust_sweep(sweep, plan, "tested"))
    return rounded(summary.drop("hc3_ratio"), "hc3_percentage")


_WIDE_BASE = S.wide_robust(S.product_models(studies.HC3_TARGETS, studies.HC3_PREDICTORS, 3), 6)


@query("hc3_sweep_three", _robust_sql("robust_predictors + robust_intercept", "'HC3'").replace(_ROBUST_BASE, _WIDE_BASE))
def hc3_sweep_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three predictors, all subsets with their products: 35 models."""
    sweep, plan = studies.hc3_study(incidents(spark, sf_dir))
    return _robust_flat(robust.run_robust_sweep(sweep, plan, "hc3"))


@query(
    "robust_ratio",
    f"""{_ROBUST_BASE}, counted AS (
  SELECT 'all' AS models, count(*) AS total, count_if(heteroskedastic) AS hc3 FROM judged
  UNION ALL SELECT 'robust', count(*), count(*) FROM judged WHERE heteroskedastic
  UNION ALL SELECT 'none', 0, 0)
SELECT models, total AS total_models, hc3 AS hc3_models, total - hc3 AS ols_models,
  CASE WHEN total > 0 THEN round(100.0::DOUBLE * hc3 / total, 6) ELSE 0.0 END AS hc3_percentage,
  CASE WHEN total > hc3 THEN round(hc3::DOUBLE / (total - hc3), 6) ELSE 'Infinity'::DOUBLE END AS hc3_ratio FROM counted""",
)
def robust_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust against plain models: of all, of the robust ones alone, and of none."""
    path = scratch_path(spark, "tested-models")
    robust.run_robust_sweep(*studies.hc3_study(incidents(spark, sf_dir), 2), "tested").write.parquet(path)
    models = spark.read.parquet(path)
    sets = {"all": models, "robust": models.filter("estimation = 'HC3'"), "none": models.filter(F.lit(False))}
    found = None
    for name, own in sets.items():
        row = ranking.robust_summary(own).select(F.lit(name).alias("models"), "*")
        found = row if found is None else found.unionByName(row)
    return rounded(found, "hc3_percentage", "hc3_ratio")


_SHARES = (0.05, 0.5, 0.95)


@query(
    "residual_summaries",
    f"""{S.solve_models(S.interaction_models(studies.HC3_TARGETS, studies.HC3_PREDICTORS))},
{S.model_rows(S.interaction_models(studies.HC3_TARGETS, studies.HC3_PREDICTORS))},
e AS (SELECT model_id, y - my - b1 * d1 - b2 * d2 - b3 * d3 AS e FROM centred),
counted AS (
  SELECT model_id, CASE WHEN e = 0 THEN 0 ELSE sign(e) * (ceil(ln(abs(e)) / ln(1.02::DOUBLE)) + 40000) END AS bucket, count(*) AS n
  FROM e GROUP BY 1, 2
), running AS (
  SELECT *, sum(n) OVER (PARTITION BY model_id ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY model_id) AS total FROM counted
), reached AS (
  SELECT model_id, {', '.join(f"min(CASE WHEN upto >= ceil({x}::DOUBLE * total) THEN bucket END) AS q{i}" for i, x in enumerate(_SHARES))}
  FROM running GROUP BY model_id
)
SELECT model_id, n, mean_size, rmse, least, most,
  {', '.join(f"CASE WHEN q{i} = 0 THEN 0 ELSE round(sign(q{i}) * 1.02::DOUBLE ** (abs(q{i}) - 40000) * 2 / 2.02::DOUBLE, 6) END AS q{i}" for i in range(3))}
FROM (SELECT model_id, count(*) AS n, round(avg(abs(e)), 6) AS mean_size, round(sqrt(avg(e * e)), 6) AS rmse,
  round(min(e), 6) AS least, round(max(e), 6) AS most FROM e GROUP BY 1) JOIN reached USING (model_id)""",
)
def residual_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of every model of the small plan, in one pass."""
    found = residuals.residual_summary(*studies.hc3_study(incidents(spark, sf_dir), 2), _SHARES)
    names = [f"q{i}" for i in range(3)]
    out = found.select("model_id", "n", "mean_size", "rmse", "least", "most", *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return rounded(out, "mean_size", "rmse", "least", "most", *names)


#: More predictors than a machine word has bits, each with gaps of its own.
_MODULI = range(2, 70)
_WIDE_PREDICTORS = [f"mod{k}" for k in _MODULI]
_WIDE_CELLS = {f"mod{k}": f"CASE WHEN l_linenumber <> {k % 7 + 1} THEN CAST(l_orderkey % {k} AS DOUBLE) END" for k in _MODULI} | {
    "size": "CAST(l_partkey % 10 AS DOUBLE)",
    "price": "CASE WHEN l_suppkey % 9 <> 0 THEN CAST(l_extendedprice AS DOUBLE) / 1000 END",
}


@query(
    "wide_sweep",
    f"""WITH clean AS (SELECT {', '.join(f"{e} AS {S.q(n)}" for n, e in _WIDE_CELLS.items())} FROM lineitem),
{S.own_shape((S.model_id(0, [i]), "price", "price", [n, "size"], [S.q(n), "size"]) for i, n in enumerate(_WIDE_PREDICTORS))}, {S._SOLVE}
SELECT {_OLS_SQL} FROM ols""",
)
def wide_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model for each of 68 predictors with gaps of their own, per-model deletion."""
    cells = table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for n, e in _WIDE_CELLS.items()])
    sweep = ols.prepare(cells, [*_WIDE_PREDICTORS, "size"], ["price"], log_label=False, missing="per_model")
    return _flat(ols.run_sweep(sweep, plan_models(spark, ["price"], _WIDE_PREDICTORS, 1, always_include=["size"])))


@query("tested_sweep_three")
def tested_sweep_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten predictors with the rating dummies, at most three and their products: 1,050 models."""
    sweep, plan = studies.interaction_study(incidents(spark, sf_dir))
    return _robust_flat(robust.run_robust_sweep(sweep, plan, "tested"))


# ---- ranking ---------------------------------------------------------------

_LOGGED = f"{S.MAIN_SWEEP}, logged AS (SELECT *, round(r2, 4) AS r2_4 FROM ols)"
_PLACED = f"""{_LOGGED}, placed AS (SELECT *,
  row_number() OVER (PARTITION BY target ORDER BY r2_4 DESC, model_id) AS place,
  row_number() OVER (PARTITION BY target ORDER BY r2_4, model_id DESC) AS from_last FROM logged)"""


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with the four decimals a log keeps."""
    return rounded(main_models(spark, sf_dir), "r2", digits=4)


@query(
    "models_top_bottom",
    f"""{_PLACED} SELECT 'top' AS section, place, target, '[' || array_to_string(predictors, ', ') || ']' AS predictors,
  n_sig_predictors + sig_intercept AS significantvars, r2_4 AS r2 FROM placed WHERE place <= 10
UNION ALL SELECT 'bottom', from_last, target, '[' || array_to_string(predictors, ', ') || ']',
  n_sig_predictors + sig_intercept, r2_4 FROM placed WHERE from_last <= 5""",
)
def models_top_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = studies.ranking_tables(_logged(spark, sf_dir))[0]
    return report.select(
        "section",
        "place",
        F.col("traffictarget").alias("target"),
        F.col("predictorslist").alias("predictors"),
        "significantvars",
        F.col("R2").alias("r2"),
    )


_USED = f"{_PLACED}, used AS (SELECT target, unnest(predictors) AS predictor FROM placed WHERE place <= 10)"


@query(
    "predictor_influence", f"{_USED} SELECT target, predictor, count(*) AS frequency FROM used GROUP BY 1, 2"
)
def predictor_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.ranking_tables(_logged(spark, sf_dir))[1]


@query(
    "influence_over_targets", f"{_USED} SELECT predictor, count(*) AS frequency FROM used GROUP BY 1"
)
def influence_over_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.ranking_tables(_logged(spark, sf_dir))[2]


@query(
    "best_models",
    f"""{S.MAIN_SWEEP} SELECT target, {S.formula('')} AS formula, round(adj_r2, 6) AS adj_r2 FROM ols
ORDER BY round(adj_r2, 6) DESC, formula LIMIT 100""",
)
def best_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = rounded(main_models(spark, sf_dir), "adj_r2")
    return ranking.best_models(models).select("target", "formula", "adj_r2")


@query(
    "experiment_counts",
    f"{S.MAIN_SWEEP} SELECT target, p AS n_predictors, count(*) AS n_models FROM ols WHERE r2 IS NOT NULL GROUP BY 1, 2",
)
def experiment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = main_models(spark, sf_dir)
    return count_experiments(models.filter(F.col("r2").isNotNull()))


@query(
    "model_check",
    f"""{S.REVERSED_SWEEP} SELECT target, count(*) AS n_rows, 0::BIGINT AS n_repeated, 0::BIGINT AS n_off_plan,
  (129 - count(*))::BIGINT AS n_absent FROM ols GROUP BY 1""",
)
def model_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short sweep checked against the long plan: its models, and the ones it lacks."""
    predictors = WEATHER_PREDICTORS[5::-1]
    models = ols.run_sweep(*studies.log_study(incidents(spark, sf_dir), predictors, TRAFFIC_TARGETS, 2))
    return check_models(models, plan_models(spark, TRAFFIC_TARGETS, WEATHER_PREDICTORS, 3))


@query(
    "valid_models",
    f"""{S.MAIN_SWEEP} SELECT target, p <= 2 AND NOT list_has_any(predictors, ['GoodWeather', 'BadWeather',
  'NeutralWeather']) AS valid_predictors, count(*) AS n FROM ols WHERE p <= 2 GROUP BY 1, 2""",
)
def valid_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished models split by whether their predictors are in a vocabulary."""
    models = main_models(spark, sf_dir).filter(F.size("predictors") <= 2)
    checked = with_valid_predictors(models, WEATHER_PREDICTORS[:6])
    return checked.groupBy("target", "valid_predictors").agg(F.count("*").alias("n"))


_SCALED = ["l_quantity", "l_extendedprice", "l_tax"]


@query(
    "standardised_features",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"round(({n} - (SELECT avg({n}) FROM lineitem)) / (SELECT stddev_samp({n}) FROM lineitem), 6) + 0 AS {n}"
        for n in _SCALED
    )
    + " FROM lineitem",
)
def standardised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembled vectors with mean 0 and sample deviation 1."""
    lines = table(spark, sf_dir, "lineitem")
    vectors = standardise(assemble(lines.select("l_orderkey", "l_linenumber", *_SCALED), _SCALED))
    values = vector_to_array("scaled_features")
    scaled = vectors.select(
        "l_orderkey", "l_linenumber", *[values[i].alias(name) for i, name in enumerate(_SCALED)]
    )
    return rounded(scaled, *_SCALED)


@query("resumed_sweep", f"{S.MAIN_SWEEP} SELECT {_OLS_SQL} FROM ols")
def resumed_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main sweep in two runs over one log; the second runs only what is absent."""
    sweep, plan = main_sweep(spark, sf_dir)
    sweep = ols.staged(sweep, scratch_path(spark, "frame"))
    log = scratch_path(spark, "models")
    first = plan_models(spark, TRAFFIC_TARGETS, WEATHER_PREDICTORS, 2)
    resume_sweep(spark, log, first, lambda todo: ols.run_sweep(sweep, todo))
    return _flat(resume_sweep(spark, log, plan, lambda todo: ols.run_sweep(sweep, todo)))


# ---- files -----------------------------------------------------------------


@query(
    "text_log_roundtrip",
    f"""{S.MAIN_SWEEP} SELECT target, array_to_string(predictors, '|') AS predictors, round(rmse, 4) AS rmse,
  round(r2, 4) AS r2, round(adj_r2, 4) AS adj_r2, n_sig_predictors + sig_intercept AS significant_vars,
  {S.formula('')} AS formula FROM ols""",
)
def text_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep as a header-less text log, read back with numbers and arrays."""
    models = main_models(spark, sf_dir)
    quoted = F.concat(F.lit("['"), F.array_join("predictors", "', '"), F.lit("']"))
    log = models.select(
        "target",
        quoted.alias("predictors"),
        *[text.four_decimals(F.col(name)).alias(name) for name in _MEASURES],
        F.col("n_sig_with_intercept").alias("significant_vars"),
        "formula",
    )
    path = scratch_path(spark, "text-log")
    tables.write_csv(log, path, header=False)
    back = ranking.numeric_log(tables.read_headerless_csv(spark, path, MODEL_LOG_FULL))
    return rounded(back.withColumn("predictors", F.array_join("predictors", "|")), *_MEASURES, digits=4)


@query(
    "csv_roundtrip",
    f"""{S.BASE} SELECT "State", count(*) AS n, count("Severity") AS n_severity,
  round(sum("DelayFromFreeFlowSpeed(mins)"), 3) AS delay, count_if(trim("Weather_Conditions") <> '') AS n_conditions
FROM rated GROUP BY 1""",
)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["State", "Severity", "DelayFromFreeFlowSpeed(mins)", "Weather_Conditions"]
    rows = incidents(spark, sf_dir).select(*names)
    path = scratch_path(spark, "incidents-csv")
    tables.write_csv(rows, path)
    back = tables.read_typed_csv(spark, path, rows.schema, names[1:3])
    kept = F.when(~conditions.is_missing_text(F.col("Weather_Conditions")), 1)
    grouped = back.groupBy("State").agg(
        F.count("*").alias("n"),
        F.count("Severity").alias("n_severity"),
        F.sum("DelayFromFreeFlowSpeed(mins)").alias("delay"),
        F.count(kept).alias("n_conditions"),
    )
    return rounded(grouped, "delay", digits=3)


@query(
    "csv_by_target",
    f"""{_PLACED} SELECT target, '[' || array_to_string(predictors, ', ') || ']' AS predictors, r2_4 AS r2
FROM placed WHERE place <= 10""",
)
def csv_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One semicolon file per target, read back."""
    best = ranking.top_and_bottom(_logged(spark, sf_dir)).filter(F.col("section") == "top")
    out = best.select("target", text.list_to_text(F.col("predictors")).alias("predictors"), "r2")
    path = scratch_path(spark, "by-target")
    tables.write_csv_by(out, path, "target")
    reader = spark.read.schema("predictors string, r2 double, target string")
    return reader.option("header", True).option("sep", ";").csv(path).select("target", "predictors", "r2")


@query(
    "filled_table",
    f"""{S.BASE_READINGS}, filled AS (SELECT "State", {_FILL_SQL["first_seen"]} AS condition FROM readings)
SELECT condition, count(*) AS n, count(DISTINCT "State") AS n_states FROM filled GROUP BY 1""",
)
def filled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-null filters, fill, write, read back."""
    filled = studies.filled_incidents(readings(spark, sf_dir))
    path = scratch_path(spark, "filled")
    tables.write_parquet(filled, path, sort_by=["State", "StartTime"])
    return (
        tables.read_parquet(spark, path)
        .groupBy(F.col("Weather_Conditions").alias("condition"))
        .agg(F.count("*").alias("n"), F.count_distinct("State").alias("n_states"))
    )


# ---- small helpers ---------------------------------------------------------

_DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string"}
_EXAMPLES = {"nation": "n_nationkey", "customer": "c_custkey"}


def _examples_sql(name: str, key: str, columns: tuple[str, ...]) -> str:
    kind = "CASE column_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _DUCK_TYPES.items()) + " ELSE lower(column_type) END"
    first = f"(SELECT * FROM {name} ORDER BY {key} LIMIT 3)"
    told = " UNION ALL ".join(
        f"SELECT '{c}' AS name, array_to_string(list(coalesce(CAST({c} AS VARCHAR), '') ORDER BY {key}), '|') AS examples FROM {first}" for c in columns
    )
    return f"SELECT '{name}' AS source, name, {kind} AS type, examples FROM (DESCRIBE SELECT * FROM {name}) JOIN ({told}) ON column_name = name"


@query(
    "schema_and_preview",
    _examples_sql("nation", "n_nationkey", ("n_nationkey", "n_name", "n_regionkey"))
    + " UNION ALL "
    + _examples_sql("customer", "c_custkey", ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")),
)
def schema_and_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of two tables with their types and their values in the first rows."""
    found = None
    for name, key in _EXAMPLES.items():
        told = tables.schema_with_examples(table(spark, sf_dir, name), [key])
        examples = F.array_join(F.transform("examples", lambda x: F.coalesce(x, F.lit(""))), "|")
        own = told.filter(F.col("name") != "c_acctbal").select(F.lit(name).alias("source"), "name", "type", examples.alias("examples"))
        found = own if found is None else found.unionByName(own)
    return found


@query(
    "defaulted_dummies",
    f"""{S.BASE} SELECT CAST(weather_rating = 'good' AS INT) AS weather_good, CAST(weather_rating = 'bad' AS INT) AS weather_bad,
  0 AS weather_neutral, 0 AS weather_unheard, count(*) AS n FROM rated GROUP BY ALL""",
)
def defaulted_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dummies that a table lacks are added as zero; those it has are kept."""
    rated = clean.with_rating(incidents(spark, sf_dir))
    there = rated.select(*[(F.col("weather_rating") == k).cast("int").alias(f"weather_{k}") for k in ("good", "bad")])
    names = ["weather_good", "weather_bad", "weather_neutral", "weather_unheard"]
    return clean.ensure_columns(there, names).groupBy(*names).agg(F.count("*").alias("n"))


@query(
    "report_without_quotes",
    f"""{S.MAIN_SWEEP} SELECT target, '[' || array_to_string(predictors, ', ') || ']' AS predictors FROM ols WHERE p > 1""",
)
def report_without_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictor lists as written by a text log, with the quotes taken off for a report."""
    models = main_models(spark, sf_dir).filter(F.size("predictors") > 1)
    written = F.concat(F.lit("['"), F.array_join("predictors", "', \""), F.lit("\"]"))
    return models.select("target", text.without_quotes(written).alias("predictors"))


@query("run_labels", "SELECT strftime(ts, '%m%d%H%M') AS label, count(*) AS n FROM events GROUP BY 1")
def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label that a run at the time of an event would have."""
    labelled = table(spark, sf_dir, "events").select(text.run_label(F.col("ts")).alias("label"))
    return labelled.groupBy("label").agg(F.count("*").alias("n"))


_RATINGS = ["good", "bad", "neutral"]


@query(
    "document_ratings_from_table",
    """WITH words AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS entry FROM documents
), entries AS MATERIALIZED (
  SELECT entry, CASE WHEN substr(md5(entry), 2, 2) IN ('00', '01') THEN 1 WHEN substr(md5(entry), 2, 1) = '5' THEN 2 ELSE 3 END AS place
  FROM words WHERE substr(md5(entry), 1, 1) IN ('0', '1', '2', '3')
), rated AS (
  SELECT doc_id, min(place) AS place FROM (SELECT doc_id, lower(text) AS text FROM documents) d JOIN entries e ON contains(d.text, e.entry)
  GROUP BY doc_id
)
SELECT d.doc_id, CASE r.place WHEN 1 THEN 'good' WHEN 2 THEN 'bad' WHEN 3 THEN 'neutral' ELSE 'unknown' END AS rating
FROM documents d LEFT JOIN rated r ON r.doc_id = d.doc_id""",
)
def document_ratings_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rated by a dictionary of thousands of entries that lives in a table."""
    documents = table(spark, sf_dir, "documents")
    words = documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias("entry")).distinct()
    digest = F.md5("entry")
    rating = (
        F.when(F.substring(digest, 2, 2).isin("00", "01"), "good").when(F.substring(digest, 2, 1) == "5", "bad").otherwise("neutral")
    )
    entries = words.filter(F.substring(digest, 1, 1).isin("0", "1", "2", "3")).withColumn("rating", rating)
    rated = dictionary.rating_from_entries(documents.select("doc_id", "text"), "text", entries, _RATINGS, "rating")
    return rated.select("doc_id", "rating")


@query("csv_quoted_lines", "SELECT doc_id, source, length(text) AS n, sha256(text) AS digest FROM documents")
def csv_quoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with their line breaks and quotes as CSV, read back in splits."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    path = scratch_path(spark, "documents-csv")
    documents.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    back = read_quoted_csv(spark, path, "doc_id long, text string, source string")
    return back.select("doc_id", "source", F.length("text").alias("n"), F.sha2("text", 256).alias("digest"))
