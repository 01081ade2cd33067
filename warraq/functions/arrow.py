"""Rows in and out of Arrow batches, a bounded number and size at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows that are there as objects at once, and bytes of texts and files after which a batch leaves.
ROWS, BYTES = 256, 4 << 20


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield from b.slice(k, ROWS).to_pylist()


def batched(found: Iterable[dict], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``ROWS``, that end once their texts and files have ``BYTES``."""
    out, size = [], 0
    for row in found:
        out.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, str | bytes))
        if len(out) == ROWS or size >= BYTES:
            yield pa.RecordBatch.from_pylist(out, kind)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, kind)
