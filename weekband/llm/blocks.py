"""Blocks of texts as bytes, and the runs of bytes in them, for operators that count words in tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that a task looks at together.
BLOCK_BYTES = 8 << 20
#: A-Z in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined up to `BLOCK_BYTES` of their column `text`; a longer text is not cut."""
    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if size >= BLOCK_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins, with the end of the last; NULL is empty."""
    texts = texts.fill_null("")
    start = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    start = start[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if raw is None else np.frombuffer(raw, dtype=np.uint8)[start[0] : start[-1]]
    return data, start - start[0]


class Runs:
    """The maximal runs of bytes `inside` within each text: `code` into `names` (A-Z lower-cased), first byte `at`, text `doc`."""

    def __init__(self, data: np.ndarray, start: np.ndarray, inside: np.ndarray) -> None:
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        own = start[:-1][start[:-1] < start[1:]]
        first[own] = inside[own]
        self.at = np.flatnonzero(first)
        letters = LOWER[data[inside]]
        offsets = np.append(np.cumsum(inside, dtype=np.int32)[self.at] - 1, len(letters)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(self.at), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
        self.names = coded.dictionary
        self.code = coded.indices.to_numpy()
        self.doc = np.searchsorted(start, self.at, side="right") - 1
