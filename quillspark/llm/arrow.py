"""Arrow helpers of the Python operators: bounded slices of a batch, words or units coded by a dictionary, and a
worker's memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once by a worker, a bound on its memory (one longer text is handled alone).
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The texts, a null as an empty one."""
    return pc.fill_null(batch.column(column), "")


def coded(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all items, the distinct items, and each row's place among the codes (one more than there are rows)."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    items = lists.flatten().dictionary_encode()
    return items.indices.to_numpy(), items.dictionary, offsets - offsets[0]


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between ASCII white space, A-Z lower-cased, as ``coded`` gives them."""
    return without_empty(*coded(pc.ascii_split_whitespace(pc.ascii_lower(texts))))


def without_empty(codes: np.ndarray, items: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    empty = pc.index(items, pa.scalar("", items.type)).as_py()
    if empty < 0:
        return codes, items, offsets
    keep = codes != empty
    return codes[keep], items, np.concatenate([[0], np.cumsum(keep)])[offsets]


def trim() -> None:
    """Gives back to the system what a worker no longer uses."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def trimmed(run: Callable) -> Callable:
    """The same function of batches, after which the worker is trimmed, as workers are kept for later stages."""

    def f(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return f


_held: dict = {}


def only(key: tuple, make: Callable):
    """What ``make`` gives, kept by a worker until another operator asks for something of its own."""
    if key not in _held:
        _held.clear()
        trim()
        _held[key] = make()
    return _held[key]
