"""Words and bounded pieces of Arrow batches, shared by the operators that work on word sequences in tasks.

A word is a run of characters other than the six ASCII white spaces, which is how bytes.split() parts a text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that a task works on at once (one longer text is a piece of its own).
PIECE = 2 << 20


def give_back() -> None:
    """Return freed memory to the system: a worker lives on for other tasks and other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU only
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(ends):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
        give_back()


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_hashes(words: list[list[bytes]], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts in one array, and the texts' bounds in it (one more than texts)."""
    bounds = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=bounds[1:])
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words), repeat(seed)), np.uint64, int(bounds[-1])), bounds


def lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """A list column of n rows from values and the (ascending) row of each."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
