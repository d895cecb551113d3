"""Declared schemas. Files are read as text; types are put on by the cleaning step."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of an incident file, in file order.
INCIDENT_COLUMNS = """\
ID
Severity
Start_Lat
Start_Lng
StartTime
EndTime
Distance(mi)
DelayFromTypicalTraffic(mins)
DelayFromFreeFlowSpeed(mins)
Congestion_Speed
Description
Street
City
County
State
Country
ZipCode
LocalTimeZone
WeatherStation_AirportCode
WeatherTimeStamp
Temperature(F)
WindChill(F)
Humidity(%)
Pressure(in)
Visibility(mi)
WindDir
WindSpeed(mph)
Precipitation(in)
Weather_Event
Weather_Conditions
""".splitlines()

INCIDENT = T.StructType([T.StructField(name, T.StringType()) for name in INCIDENT_COLUMNS])

# The columns a model sweep works on.
WEATHER_PREDICTORS = [
    "Temperature(F)", "WindChill(F)", "Pressure(in)", "Humidity(%)", "WindSpeed(mph)",
    "Visibility(mi)", "GoodWeather", "BadWeather", "NeutralWeather",
]
TRAFFIC_TARGETS = [
    "Distance(mi)", "Severity", "DelayFromTypicalTraffic(mins)",
    "TrafficJamDuration(mins)", "SpeedNumeric",
]
WEATHER_NUMERIC = [
    "Temperature(F)", "WindChill(F)", "Humidity(%)", "Pressure(in)", "WindSpeed(mph)",
    "Precipitation(in)",
]
WEATHER_DUMMIES = ["weather_good", "weather_bad", "weather_neutral", "weather_unknown"]
JAM_TARGETS = [
    "Severity", "Traffic Jam Duration", "Distance(mi)", "DelayFromTypicalTraffic(mins)",
    "DelayFromFreeFlowSpeed(mins)", "speed_numeric",
]

# Header-less model logs: a full log has seven fields, a short one five.
MODEL_LOG_FULL = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("predictors", T.StringType()),
        T.StructField("rmse", T.StringType()),
        T.StructField("r2", T.StringType()),
        T.StructField("adj_r2", T.StringType()),
        T.StructField("significant_vars", T.StringType()),
        T.StructField("formula", T.StringType()),
    ]
)
MODEL_LOG_SHORT = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("predictors", T.StringType()),
        T.StructField("r2", T.StringType()),
        T.StructField("significant_vars", T.StringType()),
        T.StructField("formula", T.StringType()),
    ]
)

MODEL_RESULT = T.StructType(
    [
        T.StructField("model_id", T.LongType()),
        T.StructField("target", T.StringType()),
        T.StructField("predictors", T.ArrayType(T.StringType())),
        T.StructField("formula", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("coefficients", T.ArrayType(T.DoubleType())),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("pvalues", T.ArrayType(T.DoubleType())),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("adj_r2", T.DoubleType()),
        T.StructField("n_sig_with_intercept", T.IntegerType()),
        T.StructField("n_sig_predictors", T.IntegerType()),
        T.StructField("n_nonzero", T.IntegerType()),
        T.StructField("bp_stat", T.DoubleType()),
        T.StructField("bp_pvalue", T.DoubleType()),
        T.StructField("estimation", T.StringType()),
    ]
)
