"""Arrow batches cut to what a Python kernel should hold at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice. A longer text is taken alone, whole.
SLICE_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows with at most so many bytes in column ``text`` at once, or one row.

    Python's copies of texts, and of what is made of them, take many times their room, and a batch holds as many rows as
    its partition has, up to 10,000 or 64 MB.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
            yield batch.slice(i, j - i)
            i = j
        del batch  # before the next one is read


def spread_out(batch: pa.RecordBatch, keys: int, at: list[int], rows: list[tuple], kinds: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    """The first columns of batch, at the row that each of the new rows was made of, and those of the new rows."""
    cols = [*zip(*rows)] or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(at, pa.int64())) for i in range(keys)], *[pa.array(c, k) for c, k in zip(cols, kinds)]], [str(i) for i in range(keys + len(kinds))])
