"""Arrow batches in small parts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows that a Python function holds as objects at a time.
ROWS = 64


def slices(batch: pa.Array, rows: int = ROWS) -> Iterator[pa.Array]:
    """A batch in parts of at most ``rows``, without copies.

    A batch of long texts fills tens of megabytes; as Python objects, with the results beside them, several times that.
    """
    for begin in range(0, len(batch), rows):
        yield batch.slice(begin, rows)
