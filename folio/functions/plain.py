"""The tokens of text.normalize for a whole Arrow column at once, found over its bytes; for functions that run within Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folio.functions import text as T

#: Code points from here on are spaces to text.normalize.
LAST = 0xD800
ODD, STEP = 1, 500_000


@cache
def _table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point up to LAST: the letter it becomes, ODD if it becomes none or two, and of these how many and the letters; what is no letter or digit is a space."""
    folds = dict(zip(map(ord, T._folds()[0]), T._folds()[1]))
    folds |= dict.fromkeys(range(0x300, 0x370), "") | {ord(a): b for a, b in T.DOUBLE.items()}
    one, many, two = np.full(LAST + 1, 32, np.uint8), np.ones(LAST + 1, np.int64), np.full((LAST + 1, 2), 32, np.uint8)
    for c in range(LAST):
        out = [ord(x) if x.isascii() and x.isalnum() else 32 for x in chr(c).lower().translate(folds)]
        many[c], two[c, : len(out)], one[c] = len(out), out, out[0] if len(out) == 1 else ODD
    return one, many, two


def _letters(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters, digits and spaces of texts that stand one behind the other in UTF-8, and where each text begins and ends."""
    one, many, two = _table()
    if raw.max() < 128:
        return one[:128][raw], at
    try:
        code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # bytes that are no UTF-8 are characters that are no letters
        texts = [raw[a:b].tobytes().decode(errors="replace").encode() for a, b in zip(at[:-1], at[1:])]
        return _letters(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, texts)))]))
    more = np.flatnonzero((raw & 0xC0) == 0x80)  # all but the first byte of a character
    at = at - np.searchsorted(more, at)
    code = np.minimum(code, LAST)
    out = one[code]
    odd = np.flatnonzero(out == ODD)
    if not len(odd):
        return out, at
    times = np.ones(len(out), np.int8)
    times[odd] = many[code[odd]]
    upto = np.concatenate([[0], np.cumsum(many[code[odd]] - 1)])  # by how much what stands behind moves
    out = np.repeat(out, times)
    for k in range(2):
        own = many[code[odd]] == 2
        out[(odd + upto[:-1])[own] + k] = two[code[odd[own]], k]
    return out, at + upto[np.searchsorted(odd, at)]


def _words(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    if not len(raw):
        return np.zeros(len(texts), np.int64), pa.array([], pa.string())
    data, at = _letters(raw, at - at[0])
    mask = data != 32
    begins, ends = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1]
    ends[:-1] &= ~mask[1:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # a word ends where its text ends
    begins[edge], ends[edge - 1] = mask[edge], mask[edge - 1]
    starts = np.flatnonzero(begins)
    cut = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(ends) + 1 - starts, out=cut[1:])
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cut), pa.py_buffer(data[mask]))
    return np.diff(np.searchsorted(starts, at)), found


def words(texts: pa.Array) -> tuple[np.ndarray, pa.StringArray]:
    """The number of tokens of each text, none in a null one, and all tokens one after the other. About ``STEP`` bytes are looked at at once."""
    texts = pa.RecordBatch.from_arrays([pc.fill_null(texts.cast(pa.string()), "")], names=["text"])
    found = [_words(piece.column(0)) for piece in pieces(texts, "text", STEP, len(texts))]
    return np.concatenate([np.empty(0, np.int64), *(n for n, _ in found)]), pa.concat_arrays([pa.array([], pa.string()), *(w for _, w in found)])


def pieces(batch: pa.RecordBatch, column: str, most: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows: at most so many rows, and so many bytes of text or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(at, to - at)
        at = to
