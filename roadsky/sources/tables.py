"""Files in and out, with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadsky.functions.conditions import is_missing_text
from roadsky.operators.clean import to_doubles
from roadsky.schemas import INCIDENT
from roadsky.sources.quoted_csv import read_quoted_csv

# Texts that stand for "no value" in the incident files.
NULL_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
              "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet carries its own schema."""
    return spark.read.parquet(path)


def read_incident_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = INCIDENT,
    null_words: Sequence[str] = (),
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header, every column as text; no inference pass over the data.

    ``null_words`` are read as null. ``multi_line`` allows line breaks inside
    quotes, at the price of a second pass over the lines.
    """
    if multi_line:
        df = read_quoted_csv(spark, path, schema)
    else:
        df = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    if not null_words:
        return df
    texts = [field.name for field in df.schema if isinstance(field.dataType, T.StringType)]
    return df.withColumns({name: _blank_out(name, null_words) for name in texts})


def _blank_out(name: str, null_words: Sequence[str]):
    return F.when(~F.col(name).isin(*null_words), F.col(name))


def read_typed_csv(
    spark: SparkSession, path: str, schema: T.StructType, numbers: Sequence[str]
) -> DataFrame:
    """CSV with a header; ``numbers`` become double, bad and missing words null."""
    return to_doubles(read_incident_csv(spark, path, schema, NULL_WORDS), numbers)


def read_headerless_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV without a header; columns the file lacks are null."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("escape", '"').csv(path)


def read_if_exists(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_parquet(df: DataFrame, path: str, sort_by: Sequence[str] = ()) -> None:
    """Replace a table; ``sort_by`` orders rows inside each task for better pruning."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").parquet(path)


def append_parquet(df: DataFrame, path: str) -> None:
    """Add rows to a table, made on first use."""
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True, compression: str = "none", rows_a_file: int = 0) -> None:
    """Replace a CSV folder; ``rows_a_file`` bounds files that compression makes unsplittable."""
    writer = df.write.mode("overwrite").option("header", header).option("escape", '"')
    writer.option("compression", compression).option("maxRecordsPerFile", rows_a_file).csv(path)


def write_csv_by(df: DataFrame, path: str, by: str, separator: str = ";") -> None:
    """One folder per value of ``by``."""
    df.write.mode("overwrite").partitionBy(by).option("sep", separator).option("header", True).csv(path)


def describe_schema(df: DataFrame) -> list[tuple[str, str, bool]]:
    """Name, type and nullability of each column."""
    return [(field.name, field.dataType.simpleString(), field.nullable) for field in df.schema]


def schema_with_examples(df: DataFrame, order_by: list[str], rows: int = 3) -> DataFrame:
    """Per column its name, type and nullability, and its values in the first rows as texts."""
    first = preview(df.orderBy(*order_by), rows)
    kinds = [
        F.struct(
            F.lit(place).alias("place"), F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(nullable).alias("nullable"),
            F.col(f"`{name}`").cast("string").alias("value"),
        )
        for place, (name, kind, nullable) in enumerate(describe_schema(df))
    ]
    key = F.struct(*[F.col(f"`{name}`") for name in order_by]).alias("key")
    told = first.select(key, F.inline(F.array(*kinds)))
    values = F.array_sort(F.collect_list(F.struct("key", "value")))
    return told.groupBy("place", "name", "type", "nullable").agg(F.transform(values, lambda x: x["value"]).alias("examples"))


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows, for a look."""
    return df.limit(rows)


def present_text(df: DataFrame, name: str) -> DataFrame:
    """Rows whose text column is neither null nor blank."""
    return df.filter(~is_missing_text(F.col(name)))
