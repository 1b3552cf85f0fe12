"""Content-chosen anchors of byte windows: equal windows choose the same anchor, wherever they stand.

Every window of ``size`` bytes is assigned the k-gram with the smallest hash inside it (the rightmost of equal ones). Windows
in a row that share their anchor form a run. Two equal windows have equal anchors at equal distance, so a window can
only occur again where its anchor's hash does.
"""

from __future__ import annotations

import numpy as np

from plumbline.llm.common import cached_powers, mix

GRAM = 64
CHUNK = 1 << 18
_LOW = np.uint64((1 << 20) - 1)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    n = len(raw)
    power, inverse = cached_powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return mix((total[GRAM:] - total[: n - GRAM + 1]) * inverse[: n - GRAM + 1])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row: prefix and suffix minima of blocks, two passes."""
    n = len(values)
    fill = -n % width
    blocks = np.concatenate((values, np.full(fill, np.iinfo(values.dtype).max, values.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _runs(raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes = _gram_hashes(raw)
    width = size - GRAM + 1
    place = np.arange(len(hashes), dtype=np.uint64)
    keyed = (hashes & ~_LOW) | (_LOW - place)
    least = _sliding_min(keyed, width)
    anchor = (_LOW - (least & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.concatenate((first, [len(anchor)])))
    return hashes[anchor[first]], first, count


def window_runs(raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of each run of a text; long texts go in chunks."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= CHUNK:
        return _runs(raw, size)
    parts = []
    for low in range(0, n, CHUNK):
        hashes, first, count = _runs(raw[low : min(low + CHUNK, n) + size - 1], size)
        parts.append((hashes, first + low, count))
    return tuple(np.concatenate(p) for p in zip(*parts))
