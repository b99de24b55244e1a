"""Vectorised word codes: the words of a batch of texts as 64-bit numbers, without a Python step per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x100000001B3 * 2 + 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = []
#: Texts are coded in batches of about this many bytes, so memory is bounded by this and the longest text. About forty
#: bytes are at work for each.
BATCH_BYTES = 256_000
#: Power tables up to this length are kept for the next batch; longer ones, for a very long text, are made for it alone.
KEPT_POWERS = 1 << 19
#: Rows of an Arrow batch that become Python objects at a time.
SLICE_ROWS = 256


def release() -> None:
    """Give freed memory back to the system, so that a worker that waits for its next task holds little of the last."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it has no such call
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a code depends on every bit of its source."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    inverse = U(pow(int(_BASE), -1, 1 << 64))
    made = [np.cumprod(np.full(max(n, 1 << 16), b, U)) for b in (_BASE, inverse)]
    if n <= KEPT_POWERS:
        _powers[:] = made
    return made[0], made[1]


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, bytes): a code for each word; where each text's words start (one entry more than texts); where each word ends in the joined bytes."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    forward, inverse = _power_tables(len(raw) + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum((raw.astype(U) + U(1)) * forward[: len(raw)])))
    codes = mix((total[end] - total[begin]) * inverse[begin] + U(0x9E3779B97F4A7C15) * (end - begin).astype(U))
    return codes, np.concatenate(([0], np.searchsorted(begin, ends_of_text))), end


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """A code for each run of `width` consecutive words (doubling: a few passes for any width)."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    parts, have, at, power = None, 0, codes, 1
    left = width
    while left:
        if left & 1:
            piece = at[have : have + n]
            parts = piece if parts is None else mix(parts * U(0x9E3779B97F4A7C15) + piece)
            have += power
        left >>= 1
        if left:
            at = mix(at[:-power] * U(0xD6E8FEB86659FD93) + at[power:])
            power *= 2
    return parts if width > 1 else codes.copy()


def batched(rows: Iterator[tuple], text_at: int) -> Iterator[list[tuple]]:
    """Group rows so that their texts hold about BATCH_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text_at])
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def arrow_rows(batches, *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches, a slice at a time; texts as UTF-8 bytes (null: none)."""
    for b in batches:
        columns = [b.column(n) for n in names]
        for lo in range(0, b.num_rows, SLICE_ROWS):
            cols = []
            for c in columns:
                part = c.slice(lo, SLICE_ROWS)
                if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
                    part = part.cast(pa.large_binary() if pa.types.is_large_string(c.type) else pa.binary())
                    cols.append([x or b"" for x in part.to_pylist()])
                else:
                    cols.append(part.to_pylist())
            yield from zip(*cols, strict=True)
    release()


def runs_of(rows: Iterator[tuple], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows that share their first `width` fields, as (fields, rows): for partitions sorted by those fields."""
    key, held = None, []
    for row in rows:
        if row[:width] != key:
            if held:
                yield key, held
            key, held = row[:width], []
        held.append(row)
    if held:
        yield key, held
