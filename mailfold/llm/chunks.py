"""Columnar work on white-space chunks: each distinct chunk of a batch is handled once.

A text is split at ASCII white space by Arrow, the chunks are dictionary-encoded,
a Python function turns each distinct chunk into a small array, and numpy
gathers those arrays back into text order.  Memory is bounded by the slice of
texts at hand (``common.text_slices``) and by the caches' entry limits; the
limits change the time taken, never a result.
"""

from __future__ import annotations

import numpy as np

CACHE_ENTRIES = 200_000


class Cache(dict):
    """A dict that starts anew when it holds ``limit`` entries."""

    def __init__(self, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.limit = limit

    def put(self, key, value):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class Generations:
    """A cache of at most about ``limit`` entries that forgets the ones not asked for lately.

    New entries fill one dict; when it holds half of the limit it becomes the old one,
    whose entries move back when they are asked for.
    """

    def __init__(self, limit: int = CACHE_ENTRIES):
        self.half, self.new, self.old = max(limit // 2, 1), {}, {}

    def get(self, key):
        known = self.new.get(key)
        if known is None:
            known = self.old.get(key)
            if known is not None:
                self.put(key, known)
        return known

    def put(self, key, value):
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value


def split_chunks(texts, as_list: bool = True):
    """(codes, distinct chunks, row offsets) of an Arrow string array; null counts as empty.

    The chunks come as a list, or else as an Arrow array.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    filled = pc.fill_null(texts, "")
    # 64-bit offsets: a slice may hold one text of any length
    parts = pc.ascii_split_whitespace(filled.cast(pa.large_string()))
    offsets = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    chunks = coded.dictionary
    return codes, chunks.to_pylist() if as_list else chunks, offsets - offsets[0]


def gather(codes, offsets, pieces, dtype):
    """Concatenate ``pieces[code]`` (bytes of ``dtype`` items) in code order.

    Returns the items and each row's start in them (one more entry than rows).
    """
    item = np.dtype(dtype).itemsize
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // item
    flat = np.frombuffer(b"".join(pieces), dtype)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(pieces) else lengths
    counts = lengths[codes]
    ends = np.concatenate(([0], np.cumsum(counts)))
    where = np.repeat(starts[codes] - ends[:-1], counts) + np.arange(ends[-1])
    return flat[where], ends[offsets]
