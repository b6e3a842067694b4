"""Words of many texts at once, as arrays over the UTF-8 buffer of an Arrow column.

Word boundaries and 64-bit word hashes come from whole-buffer numpy passes; no
Python string is made. ``text_blocks`` bounds the bytes that one pass holds.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1_000_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _inverse(base: np.uint64) -> np.uint64:
    return _U(pow(int(base), -1, 1 << 64))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i < n (kept, and grown when needed)."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, _inverse(base), np.uint64)
        up[0] = down[0] = 1
        have = _powers[int(base)] = (np.cumprod(up), np.cumprod(down))
    return have


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Polynomial hash of every span [start, end) of a uint64 array, equal for equal contents anywhere."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BASE)


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Freed memory goes back to the system: Python workers outlive their tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def text_blocks(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of at most ``limit`` bytes of text (or one row), with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8_column(batch.column(name))
        row = 0
        while row < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
            stop = min(max(stop, row + 1), batch.num_rows)
            yield batch.slice(row, stop - row), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
            row = stop
        give_back()


def _cut_after(data: np.ndarray, at: int, gap: np.ndarray) -> int:
    """The first place from ``at`` on that is inside no word, or the end."""
    while at < len(data):
        free = np.flatnonzero(gap[data[at : at + 4096]])
        if len(free):
            return at + int(free[0])
        at += 4096
    return len(data)


def _words_after(data: np.ndarray, at: int, gap: np.ndarray, words: int) -> int:
    """Where the ``words`` next words after ``at``, a place in a gap, have ended."""
    size = 64 * (words + 1)
    while True:
        inside = ~gap[data[at : at + size]]
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        if len(ends) >= words:
            return at + (int(ends[words - 1]) if words else 0)
        if at + size >= len(data):
            return len(data)
        size *= 4


def text_pieces(
    batches: Iterator[pa.RecordBatch], name: str, gap: np.ndarray, after: int, mapped: np.ndarray | None = None, limit: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int, int, bool]]:
    """Blocks of texts of at most ``limit`` bytes; a longer text comes in pieces, so that memory is bounded by the limit and the longest word.

    Yields rows, bytes (through the table ``mapped``), offsets of the texts,
    the place of the piece in its text, the bytes whose words belong to the
    piece, and whether the rows end here. Behind those bytes a piece shows the
    ``after`` words that follow, for windows that begin in it.
    """
    for batch, data, offsets in text_blocks(batches, name, limit):
        if mapped is not None:
            data = mapped[data]
        if len(data) <= limit:
            yield batch, data, offsets, 0, len(data), True
            continue
        at = 0
        while True:
            cut = _cut_after(data, min(at + limit, len(data)), gap)
            end = _words_after(data, cut, gap, after)
            yield batch, data[at:end], np.array([0, end - at]), at, cut - at, cut == len(data)
            if cut == len(data):
                break
            at = cut


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (bytes outside ``gap``: space, \\t, \\n, \\v, \\f, \\r), and where each text's words begin."""
    size = len(data)
    inside = np.zeros(size + 2, np.int8)
    inside[1:-1] = ~gap[data]
    step = np.diff(inside)
    cut = np.zeros(size + 1, bool)
    cut[offsets] = True
    both = cut[1:-1] & (inside[1:-2] == 1) & (inside[2:-1] == 1) if size > 1 else np.zeros(0, bool)
    joins = np.flatnonzero(both) + 1  # one word ends and the next begins where texts touch
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(joins):
        starts, ends = np.sort(np.concatenate([starts, joins])), np.sort(np.concatenate([ends, joins]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(BYTE_VALUE[data], starts, ends)


LONG_WORD = 32


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words of which long ones are digests.

    A polynomial modulo 2**64 cannot tell some long words of regular build
    apart, whatever its base; below LONG_WORD bytes there are none of them.
    """
    out = word_hashes(data, starts, ends)
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def digest_halves(contents: Iterable[bytes]) -> np.ndarray:
    """A 128-bit digest of every content, as two int64 columns."""
    found = b"".join(hashlib.blake2b(c, digest_size=16).digest() for c in contents)
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def joined_words(data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    """The words of every text, joined by one space."""
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield b" ".join(data[a:b].tobytes().split())  # at the same six bytes as SPACE
