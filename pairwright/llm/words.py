"""Words of texts and their names, a batch at a time.

A text's words are split and numbered by Arrow's own kernels; names are BLAKE2b digests of the distinct
words, so that no two words can be made to share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_same = np.arange(256, dtype=np.uint8)
#: What each byte is read as. Words are what ASCII white space leaves.
PLAIN = _same.copy()
LOWER = _same.copy()
LOWER[65:91] += 32
#: Letters, digits and all beyond ASCII; everything else is white space.
LETTERS = np.where(((_same >= 48) & (_same < 58)) | ((LOWER >= 97) & (LOWER < 123)) | (_same >= 128), LOWER, 32).astype(np.uint8)


def portions(texts: pa.Array, budget: int) -> Iterator[tuple[int, int]]:
    """(first row, end) of runs of about ``budget`` bytes: a run of more is one text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(size):
        before = int(size[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + budget, side="right")))
        yield start, end
        start = end


def split(texts: pa.Array, table: np.ndarray = PLAIN) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, the number of each word of all texts, words per text); a null has none."""
    own = pa.concat_arrays([pc.fill_null(texts, "")])  # offsets of its own
    if len(own) == 0:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    if table is not PLAIN:
        _, offsets, data = own.buffers()
        read = table[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
        own = pa.StringArray.from_buffers(len(own), offsets, pa.py_buffer(read), offset=own.offset)
    lists = pc.ascii_split_whitespace(own)
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(own)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not some.all():
        flat, doc = flat.filter(pa.array(some)), doc[some]
    if not len(flat):
        return [], np.zeros(0, np.int64), np.zeros(len(own), np.int64)
    coded = flat.dictionary_encode()
    _, offsets, data = coded.dictionary.buffers()
    cut = np.frombuffer(offsets, np.int32)[coded.dictionary.offset :][: len(coded.dictionary) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], coded.indices.to_numpy().astype(np.int64), np.bincount(doc, minlength=len(own))


def names(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit lanes of each word's name."""
    data = b"".join([blake2b(w, digest_size=16).digest() for w in words])
    both = np.frombuffer(data, np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def word_names(texts: pa.Array, table: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(both lanes of the name of every word of all texts, words per text)."""
    distinct, codes, counts = split(texts, table)
    a, b = names(distinct)
    return a[codes], b[codes], counts
