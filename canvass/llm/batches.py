"""Arrow batches of (id, text) cut into pieces of bounded size, and byte arithmetic on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

Chunk = tuple[list, list[str]]


def chunks(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[Chunk]:
    """Ids and texts (null: empty) whose lengths add up to ``most`` characters, or one longer text."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            t = t or ""
            if texts and size + len(t) > most:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if texts:
        yield ids, texts


def joined(parts: list[bytes], gap: bytes = b"\0") -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a gap after each part, and the parts' starts plus the total length."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + len(gap)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    return np.frombuffer(gap.join([*parts, b""]), np.uint8), starts


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of the public splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        size = max(n, 1 << 21)
        for name, base in (("p", _ODD), ("q", pow(_ODD, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["q"]


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any range of ``data`` in constant time (see ``range_hash``)."""
    power, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, equal for equal bytes wherever they stand."""
    _, inverse = _powers(len(sums))
    return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


#: The ASCII white space that separates words.
_SPACE = np.zeros(256, bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many words lie before each part (one entry more than parts)."""
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return begin, end, np.searchsorted(begin, starts)
