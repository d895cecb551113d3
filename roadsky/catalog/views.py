"""Incident-shaped views over the driver's tables, in Spark and as SQL text.

``incidents``  lineitem joined with part: text times with offsets, text
               numbers with bad values, condition and speed words in all the
               forms the cleaning step has to cope with.
``readings``   events as a time series per user, condition missing where the
               value is low.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _offset_text(moment, offset):
    # by cast, not date_format: that would go through the session's time zone
    return F.concat(F.translate(moment.cast("string"), " ", "T"), F.lit(".000"), offset)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    tax, discount = F.col("l_tax"), F.col("l_discount")
    size = F.col("p_size").cast("double")
    kind, size_of = F.col("p_type"), F.col("p_size")
    open_line = F.col("l_linestatus") == "O"
    seconds = F.floor(price * 1.2).cast("long") - 6000
    # wall clock at the end, told in another offset than the start
    end = F.timestamp_add("SECOND", F.when(open_line, seconds + 3600).otherwise(seconds), "l_shipdate")
    condition = (
        F.when(F.col("p_name").startswith("hot"), "Blowing Embers")
        .when(kind == "ECONOMY", "Fair")
        .when(kind == "STANDARD", "Light Rain")
        .when(kind == "PROMO", "Cloudy")
        .when(kind == "SMALL", " Heavy Snow / Windy ")
        .when(kind == "MEDIUM", "mostly cloudy")
        .when(size_of < 20, F.lit(None))
        .when(size_of < 35, " ")
        .otherwise("Thunderstorm and Fog")
    )
    flag = F.col("l_returnflag")
    words = (
        F.when((flag == "A") & (tax > 0.065), F.lit(None))
        .when(flag == "A", "Fast")
        .when((flag == "N") & open_line, "moderate")
        .when(flag == "N", F.concat(F.lit("Moderate "), quantity.cast("string"), F.lit(" mph")))
        .when(open_line, " Slow 1.2.3 ")
        .otherwise("SLOW")
    )
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ID"),
        F.when(size_of == 50, "n/a").otherwise(F.col("l_linenumber").cast("string")).alias("Severity"),
        _offset_text(F.col("l_shipdate"), F.when(open_line, "-05:00").otherwise("+01:00")).alias(
            "StartTime"
        ),
        F.when(size_of == 49, "unknown")
        .otherwise(_offset_text(end, F.when(open_line, "-04:00").otherwise("+01:00")))
        .alias("EndTime"),
        (price * (1 - discount) / 10000).alias("Distance(mi)"),
        (quantity * tax * 10 - 2).alias("DelayFromTypicalTraffic(mins)"),
        F.when((discount > 0.025) & (discount < 0.035), "none")
        .otherwise(F.round(quantity * (1 + tax), 2).cast("string"))
        .alias("DelayFromFreeFlowSpeed(mins)"),
        words.alias("Congestion_Speed"),
        F.when(F.col("p_brand") != "Brand#25", F.col("p_brand")).alias("State"),
        (quantity * 1.5 + size * 0.25).alias("Temperature(F)"),
        F.when(tax < 0.075, quantity * 1.4 + tax * 100 - 5).alias("WindChill(F)"),
        (100 - size * 1.7 + discount * 50).alias("Humidity(%)"),
        (discount * 8 + 29.2 + size * 0.004).alias("Pressure(in)"),
        (10 - tax * 90 + discount * 3).alias("Visibility(mi)"),
        (F.col("p_retailprice") / 50 - 15).alias("WindSpeed(mph)"),
        F.when((tax > 0.035) & (tax < 0.045), "T")
        .otherwise(F.round(discount / 2 + tax, 4).cast("string"))
        .alias("Precipitation(in)"),
        condition.alias("Weather_Conditions"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ID"),
        F.col("user_id").alias("State"),
        F.col("ts").alias("StartTime"),
        "value",
        F.when(F.col("value") >= 15, F.col("event_type")).alias("Weather_Conditions"),
    )


INCIDENTS_SQL = """
incidents AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS "ID",
    CASE WHEN p_size = 50 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS "Severity",
    strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.000') || CASE WHEN l_linestatus = 'O' THEN '-05:00' ELSE '+01:00' END
      AS "StartText",
    floor(l_extendedprice * 1.2::DOUBLE) - 6000 AS seconds,
    p_size <> 49 AS has_end,
    l_extendedprice * (1 - l_discount) / 10000 AS "Distance(mi)",
    l_quantity * l_tax * 10 - 2 AS "DelayFromTypicalTraffic(mins)",
    CASE WHEN l_discount > 0.025 AND l_discount < 0.035 THEN NULL
         ELSE round(l_quantity * (1 + l_tax), 2) END AS "DelayFromFreeFlowSpeed(mins)",
    CASE WHEN l_returnflag = 'A' AND l_tax > 0.065 THEN NULL
         WHEN l_returnflag = 'A' THEN 'Fast'
         WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'moderate'
         WHEN l_returnflag = 'N' THEN 'Moderate ' || CAST(l_quantity AS VARCHAR) || ' mph'
         WHEN l_linestatus = 'O' THEN ' Slow 1.2.3 ' ELSE 'SLOW' END AS "Congestion_Speed",
    CASE WHEN p_brand <> 'Brand#25' THEN p_brand END AS "State",
    l_quantity * 1.5::DOUBLE + CAST(p_size AS DOUBLE) * 0.25::DOUBLE AS "Temperature(F)",
    CASE WHEN l_tax < 0.075 THEN l_quantity * 1.4::DOUBLE + l_tax * 100 - 5 END AS "WindChill(F)",
    100 - CAST(p_size AS DOUBLE) * 1.7::DOUBLE + l_discount * 50 AS "Humidity(%)",
    l_discount * 8 + 29.2::DOUBLE + CAST(p_size AS DOUBLE) * 0.004::DOUBLE AS "Pressure(in)",
    10 - l_tax * 90 + l_discount * 3 AS "Visibility(mi)",
    p_retailprice / 50 - 15 AS "WindSpeed(mph)",
    CASE WHEN l_tax > 0.035 AND l_tax < 0.045 THEN NULL
         ELSE round(l_discount / 2 + l_tax, 4) END AS "Precipitation(in)",
    CASE WHEN starts_with(p_name, 'hot') THEN 'Blowing Embers'
         WHEN p_type = 'ECONOMY' THEN 'Fair' WHEN p_type = 'STANDARD' THEN 'Light Rain'
         WHEN p_type = 'PROMO' THEN 'Cloudy' WHEN p_type = 'SMALL' THEN ' Heavy Snow / Windy '
         WHEN p_type = 'MEDIUM' THEN 'mostly cloudy' WHEN p_size < 20 THEN NULL
         WHEN p_size < 35 THEN ' ' ELSE 'Thunderstorm and Fog' END AS "Weather_Conditions"
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

READINGS_SQL = """
readings AS (
  SELECT event_id AS "ID", user_id AS "State", ts AS "StartTime", value,
    CASE WHEN value >= 15 THEN event_type END AS "Weather_Conditions"
  FROM events
)"""
