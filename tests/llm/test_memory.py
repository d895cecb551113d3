"""What a worker holds at once is bounded by bytes, not by rows."""

import tracemalloc

import numpy as np
import pandas as pd

from roadsky.llm import decontaminate, runlength
from roadsky.llm.common import BATCH_BYTES, chunks, table


def _texts(total, size=4_000):
    letters = np.random.default_rng(4).integers(97, 123, (total // size, size)).astype(np.uint8)
    letters[:, ::7] = 32
    return [row.tobytes().decode() for row in letters]


def _peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_batches_for_python_are_bounded_in_bytes(spark, tmp_path):
    spark.createDataFrame([(i, "x" * 20_000) for i in range(2_000)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(frames):
        for frame in frames:
            yield pd.DataFrame({"n": [len(frame)], "size": [int(frame["text"].str.len().sum())]})

    found = table(spark, str(tmp_path), "documents").mapInPandas(sizes, "n long, size long").collect()
    assert sum(row["n"] for row in found) == 2_000
    assert max(row["size"] for row in found) <= 2 * BATCH_BYTES


def test_spans_of_a_batch_take_a_bounded_step():
    raws = [t.encode() for t in _texts(4_000_000)]
    ids = list(range(len(raws)))

    def run():
        for part in chunks(raws):
            runlength.spans_of(ids[part], ids[part], raws[part])

    assert _peak(run) < 160 << 20


def test_benchmark_search_of_a_batch_takes_a_bounded_step(tmp_path):
    texts = _texts(2_000_000)
    path = str(tmp_path / "block.npz")
    decontaminate.write_bytes(path, decontaminate.pack_block([(1, texts[0])], 10))

    def run():
        cache = {}
        for part in chunks(texts, decontaminate.STEP_CHARS):
            decontaminate.find_matches(texts[part], [path], cache)

    assert _peak(run) < 40 << 20
