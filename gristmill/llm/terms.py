"""Terms of whole texts as Arrow arrays, and their places in a vocabulary, for operators that stream texts past a bounded term list.

A term is a run of ASCII letters, ASCII digits and characters beyond ASCII; only A-Z are lower-cased.
In UTF-8 every byte of the latter is above 0x7F, so terms are found in bytes, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Texts are cut into terms so many bytes at a time; a longer text is a piece of its own.
_PIECE = 1 << 22


def terms_of(text: Column) -> Column:
    """Array of the terms of a text in order; null gives an empty array."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), 0)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, stop) of consecutive rows whose texts have about _PIECE bytes together."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > _PIECE:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in order, and the row of each."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer((texts.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[ends[0] : ends[-1]].translate(_TABLE), np.uint8)
    ends = ends - ends[0]
    inside = data != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    kept = np.cumsum(inside)
    offsets = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return words, np.searchsorted(ends, starts, side="right") - 1


def places(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Each word's place in the vocabulary, -1 of those that it lacks."""
    return pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
