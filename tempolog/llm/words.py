"""Lower-cased words of whole texts as numpy arrays of their bounds, a piece of a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of texts whose words are looked at together; a longer text is a piece of its own.
PIECE_BYTES = 8 << 20


def _letters() -> np.ndarray:
    """Of every byte what a word holds of it: digits, a-z for A-Z and a-z, bytes beyond ASCII; 0 for what parts words."""
    kept = np.zeros(256, np.uint8)
    for low, high, shift in ((ord("0"), ord("9"), 0), (ord("a"), ord("z"), 0), (ord("A"), ord("Z"), 32), (128, 255, 0)):
        kept[low : high + 1] = np.arange(low, high + 1) + shift
    return kept


LETTERS = _letters()


def bytes_and_offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts one after the other, and where each begins (and the last ends)."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of some texts: ``data`` lower-cased with 0 between words, bounds of each word, number of words of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def array(self) -> pa.Array:
        """The words themselves."""
        ends = np.concatenate(([0], np.cumsum(self.ends - self.starts)))
        return pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(ends), pa.py_buffer(self.data[self.data != 0])])


def words_of(texts: pa.Array) -> Words:
    """Words of texts without nulls; a word does not go on in the next text."""
    raw, offsets = bytes_and_offsets(texts)
    data = LETTERS[raw]
    inside = data != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    last[begins[begins > 0] - 1] = inside[begins[begins > 0] - 1]
    starts = np.flatnonzero(first)
    return Words(data, starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, offsets)))


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[Words]:
    """Words of consecutive texts of about ``most`` bytes together; every text is in one piece."""
    _, offsets = bytes_and_offsets(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield words_of(texts.slice(at, end - at))
        at = end
