"""Files of the shared folder, read inside tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow.dataset as ds
from pyarrow import fs


def read_parquet(uri: str, columns: Sequence[str], rows: int = 1024) -> Iterator[list[dict]]:
    """Rows of a written table, some at a time. ``uri`` is a path or a URI that Arrow knows."""
    files, path = fs.FileSystem.from_uri(uri)
    for batch in ds.dataset(path, filesystem=files, format="parquet").to_batches(columns=list(columns), batch_size=rows):
        yield batch.to_pylist()
