"""The table of finished models: what makes a sweep resumable.

A log is a folder. ``batches`` holds one written table per finished batch, and
``manifest`` a row for each batch that counts. A batch is written first and
listed after that, so a run that is lost at any moment leaves its listed
batches, and nothing of the one it was in: what is not listed is never read.
A batch that is listed twice counts once.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadsky.plans.subsets import pending_models
from roadsky.schemas import MODEL_RESULT
from roadsky.sources.tables import append_parquet, read_if_exists

MANIFEST = T.StructType(
    [
        T.StructField("batch", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("models", T.LongType()),
        T.StructField("written", T.TimestampType()),
    ]
)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The batches that count, the first listing of each."""
    listed = read_if_exists(spark, os.path.join(path, "manifest"), MANIFEST)
    first = F.min(F.struct("written", "folder", "models")).alias("first")
    return listed.groupBy("batch").agg(first).select("batch", "first.folder", "first.models", "first.written")


def finished_models(spark: SparkSession, path: str) -> DataFrame:
    """Models of the listed batches, none if there is no log yet."""
    folders = [row["folder"] for row in manifest(spark, path).orderBy("written", "batch").collect()]  # a row a batch
    if not folders:
        return spark.createDataFrame([], MODEL_RESULT)
    return spark.read.schema(MODEL_RESULT).parquet(*[os.path.join(path, "batches", folder) for folder in folders])


def commit_batch(spark: SparkSession, path: str, batch: str, models: DataFrame) -> None:
    """Write a batch, then list it. A batch that is listed already adds nothing."""
    if not manifest(spark, path).filter(F.col("batch") == batch).isEmpty():
        return
    folder = uuid.uuid4().hex
    written = os.path.join(path, "batches", folder)
    models.write.parquet(written)
    count = spark.read.schema(MODEL_RESULT).parquet(written).count()
    row = spark.range(1).select(
        F.lit(batch).alias("batch"), F.lit(folder).alias("folder"), F.lit(count).cast("long").alias("models"), F.current_timestamp().alias("written")
    )
    append_parquet(row.coalesce(1), os.path.join(path, "manifest"))


def resume_sweep(
    spark: SparkSession,
    path: str,
    plan: DataFrame,
    run: Callable[[DataFrame], DataFrame],
    batch_models: int | None = None,
) -> DataFrame:
    """Run the models the log lacks, a batch at a time, and return the whole log.

    ``batch_models``: models of a batch, about; all in one by default. Each
    batch is a run of its own over the data and is kept once it is done, so
    what a lost run has finished is not run again. ``run`` turns a plan into
    model results; it is not called where nothing is left to do.
    """
    pending = pending_models(plan, finished_models(spark, path))
    place = F.xxhash64("target", "formula")
    told = pending.agg(F.count("*").alias("n"), F.sum(place.cast("decimal(38,0)")).alias("sum")).first()
    if not told["n"]:
        return finished_models(spark, path)
    batches = 1 if not batch_models else -(-told["n"] // batch_models)
    for i in range(batches):
        todo = pending.filter(F.pmod(place, F.lit(batches)) == i)
        if batches == 1 or not todo.isEmpty():
            # the same pending models in as many batches have the same names
            commit_batch(spark, path, f"{told['n']}-{told['sum']}-{i}-{batches}", run(todo))
    return finished_models(spark, path)
