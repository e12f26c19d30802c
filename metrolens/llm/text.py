"""Words, lines and word hashes of UTF-8 texts, vectorised over a batch.

Words are ``[^\\x20\\x09-\\x0D]+`` (bytes other than ASCII white space). All
hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column (null: empty), each text
    followed by a newline, so that neither a word nor a line crosses from one
    text into the next."""
    texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    return buf, offsets


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.frombuffer(buf.tobytes().lower(), np.uint8)


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    return spans(~space)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes a step; spans that have
    ended drop out, so the work follows the number of bytes."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))
    length = ends - starts
    out = length.astype(np.uint64) * _GOLD
    live = np.flatnonzero(length > 0)
    step = 0
    while len(live):
        chunk = eight[starts[live] + step]
        left = length[live] - step
        short = left < 8
        if short.any():
            keep = (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            chunk = np.where(short, chunk & keep, chunk)
        out[live] = mix64(out[live] ^ mix64(chunk))
        step += 8
        live = live[left > 8]
    return out


class Words:
    """The words of a batch of texts: spans in ``buf``, hashes, text numbers."""

    def __init__(self, column: pa.Array, lower: bool):
        self.buf, self.offsets = buffer_of(column)
        if lower:
            self.buf = lower_ascii(self.buf)
        self.starts, self.ends = word_spans(self.buf)
        self.hashes = span_hashes(self.buf, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.offsets)     # first word of each text; one more at the end
        self.counts = np.diff(self.first)
        self.texts = len(self.counts)
        self.text = np.repeat(np.arange(self.texts), self.counts)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, offsets): the distinct ``n``-word shingles of each text, sorted.

    A text with fewer than ``n`` words has its whole word sequence as its one
    shingle; a text without words has none.
    """
    h, count = words.hashes, words.counts
    rolled = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        rolled = mix64(rolled + h[k:k + len(rolled)])
    pieces, offsets = [], np.zeros(words.texts + 1, np.int64)
    for i in range(words.texts):
        s, c = words.first[i], count[i]
        if c >= n:
            got = np.unique(rolled[s:s + c - n + 1])
        elif c:
            got = np.array([c], np.uint64)
            for k in range(c):
                got = mix64(got + h[s + k])
        else:
            got = h[:0]
        pieces.append(got)
        offsets[i + 1] = offsets[i] + len(got)
    return (np.concatenate(pieces) if pieces else h[:0]), offsets
