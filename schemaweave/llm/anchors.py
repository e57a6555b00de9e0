"""Content-defined anchors: places that equal passages choose alike, wherever they stand.

Each window of `span` consecutive k-grams elects the leftmost k-gram with the least hash,
so a passage of span + k - 1 items elects the same place in every copy. A passage that
occurs twice therefore has an anchor whose k-gram occurs twice; all others can be left out.
"""

from __future__ import annotations

import numpy as np

from schemaweave.llm.arrays import U64, _power, mixed

_CHUNK = 1 << 19
_PLACE = U64((1 << 20) - 1)


def rolling_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every `width` consecutive items (at most 2**20 of them)."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(len(items) + 1, U64)
    np.cumsum((items.astype(U64) + U64(1)) * _power("up", len(items))[: len(items)], out=total[1:])
    return mixed((total[width:] - total[:-width]) * _power("down", n)[:n])


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every `span` consecutive values."""
    done = 1
    while done < span:
        step = min(done, span - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def elect(items: np.ndarray, bounds: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in ascending order: place, hash of the k-gram, first and last window that elects it.

    bounds: items before each row. Only windows within a row count.
    """
    window = span + k - 1
    stop = np.repeat(bounds[1:], np.diff(bounds))
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(items) - window + 1, _CHUNK):
        part = items[at : at + _CHUNK + window - 1]
        grams = rolling_hashes(part, k)
        key = (grams & ~_PLACE) | np.arange(len(grams), dtype=U64)
        best = (_least(key, span) & _PLACE).astype(np.int64)
        first = np.flatnonzero(at + np.arange(len(best)) + window <= stop[at : at + len(best)])
        best = best[first]
        if len(best):
            new = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
            last = first[np.append(new[1:], len(best)) - 1]
            found.append((best[new] + at, grams[best[new]], first[new] + at, last + at))
    place, value, first, last = map(np.concatenate, zip(*found, strict=True))
    if not len(place):
        return place, value, first, last
    new = np.append(True, place[1:] != place[:-1])  # an anchor may go on into the next chunk
    end = np.append(np.flatnonzero(new)[1:], len(place)) - 1
    return place[new], value[new], first[new], last[end]
