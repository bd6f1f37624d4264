"""Words of many texts at once: byte positions and 64-bit hashes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes scanned at a time; a longer text is cut between words.
CHUNK = 1 << 21

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK + 1, 1 << (n - 1).bit_length())
    if size not in _powers:
        def table(base):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)
        _powers.clear()
        _powers[size] = table(_BASE), table(_INVERSE)
    return _powers[size]


def flat_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets between them; NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def _scan(data: np.ndarray, bounds: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one stretch; no word crosses a bound."""
    if lower:
        data = _LOWER[data]
    inside = ~_BLANK[data]
    n = len(data)
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner] = True
    starts = np.flatnonzero(first & inside)
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[inner - 1] = True
    ends = np.flatnonzero(last & inside) + 1
    power, inverse = _power_tables(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * inverse[starts])


def scan_words(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray,
                                                                          np.ndarray, np.ndarray]]:
    """For runs of texts: first and past-last text, offsets of each text's words, then starts, ends, hashes.

    Starts and ends are bytes from the start of the text. Equal words have equal
    hashes wherever they stand, in any task. A run holds about ``CHUNK`` bytes, or
    one longer text whose words are gathered piece by piece.
    """
    data, at = flat_text(texts)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        lo, hi = int(at[i]), int(at[j])
        pieces, p = [], lo
        while p < hi:
            q = hi if hi - p <= CHUNK else _cut(data, p + CHUNK, hi)
            starts, ends, hashes = _scan(data[p:q], at[i:j + 1] - p, lower)
            pieces.append((starts + p, ends + p, hashes))
            p = q
        if pieces:
            starts, ends, hashes = (np.concatenate(x) if len(pieces) > 1 else x[0] for x in zip(*pieces, strict=True))
        else:
            starts = ends = np.zeros(0, np.int64)
            hashes = np.zeros(0, np.uint64)
        offsets = np.searchsorted(starts, at[i:j + 1])
        home = np.repeat(at[i:j], np.diff(offsets))
        yield i, j, offsets, starts - home, ends - home, hashes
        i = j


def _cut(data: np.ndarray, p: int, hi: int) -> int:
    """The next blank at or after p, so that a piece ends between words."""
    while p < hi:
        found = np.flatnonzero(_BLANK[data[p:p + 65536]])
        if len(found):
            return p + int(found[0])
        p += 65536
    return hi


_STEPS = [np.uint64(int(mix(np.array([k + 1], np.uint64))[0]) | 1) for k in range(64)]


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside each text, in order, and the offsets of each text's runs.

    A text with fewer words, but at least one, has one run of all of them.
    """
    counts = np.diff(offsets)
    if len(hashes) >= size:
        m = len(hashes) - size + 1
        total = np.zeros(m, np.uint64)
        for k in range(size):
            total += hashes[k:k + m] * _STEPS[k]
        doc = np.repeat(np.arange(len(counts)), counts)
        full = mix(total)[doc[:m] == doc[size - 1:]]
    else:
        full = np.zeros(0, np.uint64)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(runs)])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return full, out_at
    out = np.empty(out_at[-1], np.uint64)
    mask = np.ones(out_at[-1], bool)
    mask[out_at[short]] = False
    out[mask] = full
    for d in short:
        own = hashes[offsets[d]:offsets[d + 1]]
        value = np.uint64(len(own))
        with np.errstate(over="ignore"):
            for k, h in enumerate(own):
                value += h * _STEPS[k]
        out[out_at[d]] = mix(np.array([value]))[0]
    return out, out_at
