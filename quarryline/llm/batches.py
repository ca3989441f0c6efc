"""Arrow batches of texts in pieces that bound a worker's memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most rows of a piece, and about the most bytes of its texts.
ROWS, BYTES = 512, 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], *texts: str, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """All rows in order, as slices of at most ``rows`` rows and ``size`` bytes in the columns ``texts``.

    A row with more bytes is a piece of its own, so a worker holds one such text at a time.
    """
    for batch in batches:
        length = np.zeros(batch.num_rows, np.int64)
        for name in texts:
            length += pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(length), 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + size, "right"))))
            yield batch.slice(at, to - at)
            at = to
