"""Slices of Arrow batches by the size of their texts, so that a task's memory doesn't follow the batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in a slice, about; a single longer text is a slice of its own.
SLICE = 2 << 20


def by_size(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(column)
        if not len(texts) or texts.buffers()[1] is None:  # no text at all
            yield batch
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
        ends = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop
