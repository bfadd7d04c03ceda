"""Vectorised word tables over Arrow text columns.

Every text operator of this subpackage reads its words through :func:`word_table`:
the UTF-8 bytes of a slice of documents are classified with a 256-entry delimiter
table, word boundaries come from that mask, and all words are hashed together, eight
bytes at a time, so no Python code runs per word.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
SLICE_BYTES = 1 << 20


def _table(inside) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(inside)] = True
    return out


#: Delimiters of the class ``[^\x20\x09-\x0D]+``.
SPACES = _table([0x20, *range(0x09, 0x0E)])
#: Delimiters of the class ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (texts are lower-cased first).
PUNCTUATION = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (wraps silently)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


#: Longer words are hashed one by one; the others eight bytes at a time, all words at once.
LONG_WORD = 512
_SPREAD = U64(0xA24BAED4963EE407)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``.

    Each eight bytes are xored into the state, which then goes through a bijection: words of up
    to eight bytes and equal length never collide, others by chance alone (no structure of the
    text, like two mirrored runs of letters, makes the products cancel as in a polynomial).
    """
    size = end - start
    out = mix((size.astype(U64) + U64(1)) * _SPREAD)
    short = np.flatnonzero(size <= LONG_WORD)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    at, left = start[short], size[short]
    while len(short):
        chunk = np.ascontiguousarray(eight[at]).view("<u8").ravel()
        some = left < 8
        chunk[some] &= (U64(1) << (U64(8) * left[some].astype(U64))) - U64(1)
        out[short] = mix(out[short] * _SPREAD ^ chunk)
        more = left > 8
        short, at, left = short[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] ^= U64(xxhash.xxh64_intdigest(data[start[k] : end[k]].tobytes()))
    return out


@dataclass
class WordTable:
    """Words of some documents, in order: ``first[d]:first[d+1]`` are those of document ``d``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined UTF-8 bytes of the texts, and where each begins (one more entry than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    values = texts.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive runs of rows of about ``limit`` bytes of text; one longer text is a run of its own."""
    if not batch.num_rows:
        return
    _, offsets = raw_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_table(texts: pa.Array, delimiters: np.ndarray = SPACES, lower: bool = False) -> WordTable:
    data, offsets = raw_bytes(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = ~delimiters[data]
    opens = np.zeros(n + 1, dtype=bool)
    opens[offsets] = True  # the end of the last text closes a word too
    edge = np.empty(n, dtype=bool)
    if n:
        edge[0] = True
        edge[1:] = ~inside[:-1]
    start = np.flatnonzero(inside & (edge | opens[:-1]))
    if n:
        edge[-1] = True
        edge[:-1] = ~inside[1:]
    end = np.flatnonzero(inside & (edge | opens[1:])) + 1
    first = np.searchsorted(start, offsets)
    return WordTable(data, offsets, start, end, first, word_hashes(data, start, end))


def windows(table: WordTable, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and first word of every run of ``width`` words of one document."""
    h = table.hash
    n = len(h) - width + 1
    if n <= 0:
        empty = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=U64), empty, empty
    doc = table.doc
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    joined = np.zeros(n, dtype=U64)
    for k in range(width):
        joined = joined * U64(0x9FB21C651E98DF25) + h[k : k + n]
    return mix(joined[at] ^ U64(width)), doc[at], at


def shingle_sets(table: WordTable, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and where each document's begin.

    A document with 1..width-1 words has its whole sequence as one shingle; without words, none.
    """
    h, doc, _ = windows(table, width)
    short = np.flatnonzero((table.counts > 0) & (table.counts < width))
    if len(short):
        more = np.zeros(len(short), dtype=U64)
        left = table.counts[short]
        for k in range(width - 1):
            on = left > k
            more[on] = more[on] * U64(0x9FB21C651E98DF25) + table.hash[table.first[short[on]] + k]
        more = mix(more ^ (left.astype(U64) + U64(1 << 32)))
        h, doc = np.concatenate([h, more]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(table.first)))


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[d]:first[d+1]]``; empty segments give 0."""
    total = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype == U64 else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
