"""Vectorised rolling hashes of byte strings and the anchors that windows of bytes agree on."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, size: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < size:
        have = np.empty(max(size, 1 << 16), dtype=np.uint64)
        have[0] = 1
        done = 1
        while done < len(have):  # doubling: the next stretch is the first one times base ** done
            more = min(done, len(have) - done)
            have[done : done + more] = have[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        _powers[base] = have
    return have[:size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a polynomial hash over the word (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial hash (modulo 2**64) of the first i bytes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _power_table(_BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), whatever their places."""
    return mix((prefix[end] - prefix[start]) * _power_table(_INVERSE, len(prefix))[start] + (end - start).astype(np.uint64))


def gram_hashes(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-byte string, by its start; the high bits are the well spread ones."""
    n = len(prefix) - k
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = prefix[k:] - prefix[:n]
    out *= _power_table(_INVERSE, len(prefix))[:n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    return out


_PLACE_BITS = 24
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
MAX_BLOCK = 1 << _PLACE_BITS


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value of each run of ``width`` values, the leftmost of equals.

    The place takes the low 24 bits of what is compared, so the minimum carries it (van Herk's two
    sweeps); values that agree in their 40 high bits count as equal. At most MAX_BLOCK values.
    """
    n = len(values)
    if n < width:
        return np.empty(0, dtype=np.int64)
    if n > MAX_BLOCK:
        raise ValueError("more values than a place can hold")
    rows = -(-n // width)
    keyed = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.bitwise_and(values, ~_PLACE, out=keyed[:n])
    keyed[:n] |= np.arange(n, dtype=np.uint64)
    keyed = keyed.reshape(rows, width)
    ahead = np.minimum.accumulate(keyed, axis=1).ravel()
    behind = np.minimum.accumulate(keyed[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & _PLACE).astype(np.int64)
