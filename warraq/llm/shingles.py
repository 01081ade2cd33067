"""Sets of word shingles as sorted 64-bit numbers, for many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_random = np.random.Generator(np.random.PCG64(20))
#: A random number for each byte, and odd multipliers for places in a word and in a shingle.
BYTE = _random.integers(0, 2**64, 256, np.uint64)
STEP, PLACE = _random.integers(0, 2**64, 2, np.uint64) | np.uint64(1)
INVERSE = np.uint64(pow(int(STEP), -1, 2**64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """Powers of a multiplier and of its inverse, modulo 2 ** 64."""
    have = _powers[which]
    if len(have) < n:
        steps = np.full(max(n, 2 * len(have)), STEP if which == "up" else INVERSE, np.uint64)
        steps[0] = 1
        _powers[which] = have = np.multiply.accumulate(steps)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted.

    Words are stretches without ASCII white space, A to Z lowered. A text with
    fewer than ``width`` words has one shingle, the whole sequence; a text
    without words, or null, has none. Two different shingles get an equal
    number with a chance of 2 ** -64.
    """
    data = [(t or "").encode() for t in texts]
    joined = LOWER[np.frombuffer(b"\n".join(data) + b"\n", np.uint8)]
    size = np.array([len(d) + 1 for d in data])
    first_byte = np.cumsum(size) - size
    space = SPACES[joined]
    word = ~space
    start = np.flatnonzero(word & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(word & np.concatenate([space[1:], [True]])) + 1
    if not len(start):
        return [np.empty(0, np.uint64) for _ in texts]
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(BYTE[joined] * _power("up", len(joined)), out=sums[1:])
    words = mixed((sums[end] - sums[start]) * _power("down", len(joined))[start] + (end - start).astype(np.uint64))
    owner = np.searchsorted(first_byte, start, side="right") - 1
    per = np.bincount(owner, minlength=len(texts))
    first_word = np.cumsum(per) - per
    n = len(words) - width + 1
    out = []
    if n > 0:
        place, rolled = np.uint64(1), np.zeros(n, np.uint64)
        for k in range(width):
            rolled += words[k : n + k] * place
            place = np.uint64(int(place) * int(PLACE) % 2**64)
        rolled = mixed(rolled)
    for k, s in zip(per.tolist(), first_word.tolist(), strict=True):
        if k >= width:
            out.append(np.unique(rolled[s : s + k - width + 1]))
        elif k:
            total = 0
            for w in reversed(words[s : s + k].tolist()):
                total = (total * int(PLACE) + w) % 2**64
            out.append(mixed(np.array([total + k], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def fingerprint(sorted_set: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    d = xxhash.xxh3_128_intdigest(sorted_set.tobytes())
    return (d >> 64) - (1 << 63), (d & (2**64 - 1)) - (1 << 63)
