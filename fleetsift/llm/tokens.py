"""Words of whole batches of texts at once, cut on the bytes of the column they arrive in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is true for bytes inside the ranges, ends included."""
    found = np.zeros(256, bool)
    for low, high in ranges:
        found[low:high + 1] = True
    return found


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column in one piece and the edges of its texts; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    edges = np.frombuffer(texts.buffers()[1], width)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if data is None or not len(edges) or edges[0] == edges[-1]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[edges[0]: edges[-1]], edges - edges[0]


def stretches(edges: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of texts [a, b) that hold limit bytes or one text."""
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + limit, "right")) - 1)
        yield a, b
        a = b


def cut_words(data: np.ndarray, edges: np.ndarray, is_word: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, where each starts in data, number of words before every edge); A-Z lower-cased.

    A word is a run of bytes for which is_word holds, inside one text. The table must treat all bytes
    of 128 and more alike, so that no character is cut.
    """
    low = _LOWER[data]
    inside = is_word[low]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[edges[:-1]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    kept = low[inside]
    places = np.cumsum(inside, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    offsets = np.append(places[starts] - 1, len(kept)) if len(starts) else np.zeros(1, np.int64)
    del places, before, low
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept))
    return words, starts, np.searchsorted(starts, edges)


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word and the distinct words they stand for."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
