"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


def local_session(app_name: str = "roadsky", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches. On a cluster, ``spark-submit`` sets these."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of a generated method that the JVM still compiles; it interprets longer ones.
COMPILED_BYTES = 8000
_METHOD = "spark.sql.codegen.hugeMethodLimit"


def compiled_projections(spark: SparkSession) -> None:
    """Plans whose fused code would be too long a method to be compiled run by operator, whose code Spark splits.

    The projection of 50 to 100 model columns is such a method, and interpreted
    it is many times slower. A setting of the session; a smaller one is left as
    it is. Results do not depend on it.
    """
    if int(spark.conf.get(_METHOD)) > COMPILED_BYTES:
        spark.conf.set(_METHOD, str(COMPILED_BYTES))


#: Bytes of rows that go to Python at once, about: each batch is held by Spark, by Arrow and as objects of Python.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python by their bytes as well: ten thousand rows of text are far more than ten thousand numbers.

    A setting of the session; a smaller one is left as it is. Results do not depend on it.
    """
    held = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)))
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost with its executor.
    """
    try:
        folder = spark.conf.get("spark.checkpoint.dir", None)
    except PySparkException:
        folder = None
    context = spark.sparkContext
    folder = folder or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="roadsky-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path not used before, inside the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
