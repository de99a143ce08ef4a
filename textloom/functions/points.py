"""Code points of Arrow strings as numpy arrays, for helpers that look at many characters at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def code_points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all ``strings`` in a row, and where each string begins, with the end as the last place; null is empty."""
    raw = strings.cast(pa.large_binary()).fill_null(b"")
    if not len(raw):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    ends = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        return code_points(pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string()))
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)))
    return points, before[ends - ends[0]]


def row_slices(strings: pa.Array, rows: int, size: int) -> list[tuple[int, int]]:
    """Runs of at most so many rows and bytes, a row at least."""
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(pc.binary_length(strings).fill_null(0).to_numpy(zero_copy_only=False))))
    out, at = [], 0
    while at < len(strings):
        out.append((at, min(len(strings), at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1))))
        at = out[-1][1]
    return out


def gram_sets(strings: pa.Array, size: int, apart: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct runs of ``size`` (up to 3) characters of each string, without runs that hold ``apart``."""
    points, at = code_points(strings)
    count = np.maximum(np.diff(at) - size + 1, 0)
    start = np.arange(int(count.sum())) + np.repeat(at[:-1] - (np.cumsum(count) - count), count)
    row = np.repeat(np.arange(len(strings)), count)
    if apart is not None:
        parted = points == ord(apart)
        whole = ~np.any([parted[start + k] for k in range(size)], axis=0)
        start, row = start[whole], row[whole]
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    number = np.cumsum(seen, dtype=np.int32)[points] - 1
    base = max(1, len(alphabet))
    if max(1, len(strings)) * base**size < 1 << 63:  # (row, run) as one number in the digits of the alphabet
        both = row
        for k in range(size):
            both = both * base + number[start + k]
        both = _distinct(both)
        rest, code = both, np.zeros(len(both), np.uint64)
        for k in range(size):
            rest, digit = np.divmod(rest, base)
            code |= alphabet[digit].astype(np.uint64) << np.uint64(21 * k)
        return rest, code
    code = np.zeros(len(start), np.uint64)
    for k in range(size):
        code = (code << np.uint64(21)) | points[start + k].astype(np.uint64)
    names, code = np.unique(code, return_inverse=True)
    both = _distinct(row * len(names) + code)
    return both // len(names), names[both % len(names)]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))]
