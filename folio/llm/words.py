"""Words of whole texts, found over the bytes of an Arrow column at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken apart at once; a longer text is taken alone.
CHUNK = 8_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in parts of consecutive rows with at most so many bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def runs(texts: pa.Array, member: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, pa.StringArray]:
    """(row, word) of every maximal run of the bytes that ``member`` marks, A-Z in lower case; a null text has none."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.empty(0, np.int64), pa.array([], pa.string())
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets -= offsets[0]
    mask = member(data)
    before, after = np.zeros(size, bool), np.zeros(size, bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    before[offsets[:-1][offsets[:-1] < size]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    cut = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cut), pa.py_buffer(data[mask]))
    return np.searchsorted(offsets, starts, "right") - 1, words
