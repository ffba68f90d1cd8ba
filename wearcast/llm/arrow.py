"""Helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: A batch is worked on in slices of about this many bytes of text; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000


def as_text(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """The texts as one array with 64-bit offsets; null becomes ''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, length) of consecutive runs of texts that hold about ``most`` bytes each."""
    size = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1])
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and held + n > most:
            yield start, i - start
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts) - start


def by_slice(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text",
             most: int = SLICE_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that hands ``work`` record batches of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_text(batch.column(batch.schema.get_field_index(text)))
            for first, n in slices(texts, most):
                out = work(batch.slice(first, n))
                if out is not None and out.num_rows:
                    yield out

    return run
