"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsky.session import BATCH_BYTES, bounded_batches, scratch_path  # noqa: F401

#: Characters of text that one vectorised step handles at once: arrays of a word a character, several at a time.
CHUNK_CHARS = 1_000_000
#: Rows of one equal key are dealt out to this many tasks at most.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut in the lineage that outlives executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    while name in columns:
        name = "_" + name
    return name


def write_bytes(uri: str, data: bytes) -> None:
    """A file in the shared folder, by its URI or path."""
    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(path) as out:
        out.write(data)


def read_bytes(uri: str) -> bytes:
    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_stream(path) as source:
        return source.read()


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; false for a null id."""
    text = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(text.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def spread_lookup(left: DataFrame, right: DataFrame, key: list[str], deal_by: list[Column]) -> DataFrame:
    """Left join of ``right`` (one row a key, no nulls in it) where any number of left rows may share a key.

    Left rows of a key are dealt to ``SALTS`` parts by a hash of ``deal_by``; the
    right row is repeated only for parts that occur. No task holds a whole key.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*deal_by), F.lit(SALTS)))
    parts = salted.groupBy(*key, "_salt").agg(F.lit(1).alias("_one")).drop("_one")
    return salted.join(parts.join(right, key), [*key, "_salt"], "left").drop("_salt")


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[slice]:
    """Slices of ``texts`` of about ``limit`` characters; one longer text makes a slice of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and held + n > limit:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))


def bounds(lengths: np.ndarray) -> np.ndarray:
    """Starts of consecutive pieces, with the end of the last one behind."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start+1, ... of each (start, count), one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)
