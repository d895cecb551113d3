import pytest
from pyspark.sql import types as T


def long(name):
    return T.StructField(name, T.LongType())


def text(name):
    return T.StructField(name, T.StringType())


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) rows as a frame with columns whose names clash with those that operators make up."""

    def make(rows):
        schema = T.StructType([long("doc_id"), text("text"), long("n_chars"), text("score"), long("n_hit"), text("fp"), text("_text")])
        full = [(i, t, len(t) if t is not None else None, "x", 7, "y", "z") for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make
