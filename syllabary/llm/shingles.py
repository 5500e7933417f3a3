"""Word shingles of many texts at once, and their HyperMinHash sketches, with array operations only."""

from __future__ import annotations

import re

import numpy as np

#: Registers of a sketch (a power of two), bits of the mantissa in each.
REGISTERS, MANTISSA = 512, 10
#: Coarse registers (each the first filled one of neighbours, which is their minimum), and how many make a band.
COARSE, ROWS = 128, 5

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_u = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


#: Bytes that are hashed at once, but for the rest of a word; longer tables of powers than for that and ``SPARE`` are not kept.
PIECE, SPARE = 1 << 20, 1 << 12
_powers: list[tuple[np.ndarray, np.ndarray]] = []
_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_ODD, _INVERSE):
        rest = np.full(n, base, np.uint64)
        rest[0] = 1
        out.append(np.multiply.accumulate(rest))
    return out[0], out[1]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    if n > PIECE + SPARE:
        return _made_powers(n)
    if not _powers:
        _powers.append(_made_powers(PIECE + SPARE))
    return _powers[0][0][:n], _powers[0][1][:n]


def _hashed(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of a piece, where each begins)."""
    data = np.frombuffer(piece, np.uint8)
    space = _SPACE[data]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _u(1)) * power[: len(data)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64)), begins


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, in order; words of each text). A-Z count as a-z where ``lower``.

    Each hash is a polynomial of the word's bytes modulo 2^64, from differences of one running sum over a piece of the texts.
    """
    joined = b"\n".join([*texts, b""])
    if lower:
        joined = joined.translate(_LOWER)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    hashes, begins, start = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while start < len(joined):  # a piece ends with white space, so no word lies in two
        found = _BREAK.search(joined, min(start + PIECE, len(joined)) - 1)
        stop = found.end() if found else len(joined)
        own, at = _hashed(joined[start:stop])
        hashes.append(own)
        begins.append(at + start)
        start = stop
    edges = np.concatenate([[0], np.cumsum(lengths)])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(begins), edges))


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashed shingles of each text; one for all words together where they are fewer than ``width``."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    keys = np.zeros(len(words), np.uint64)
    whole = len(words) - width + 1
    if whole > 0:
        for j in range(width):
            keys[:whole] += mixed(words[j : j + whole] + _u(j + 1)) * _u(2 * j + 1)
        keys = mixed(keys)
    out = []
    for start, end, n in zip((ends - counts).tolist(), ends.tolist(), counts.tolist(), strict=True):
        if n >= width:
            own = np.sort(keys[start : end - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n:
            few = sum((mixed(words[start + j : start + j + 1] + _u(j + 1)) * _u(2 * j + 1) for j in range(n)), np.zeros(1, np.uint64))
            out.append(mixed(few + _u(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketch(own: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set of hashes; 0: empty.

    The leading bits of a hash choose its register. A register keeps the smallest of the other bits as the number of its leading
    zeros, plus one, and the ``MANTISSA`` bits after its leading one.
    """
    out = np.zeros(REGISTERS, np.uint16)
    if not len(own):
        return out
    bits = REGISTERS.bit_length() - 1
    at = (own >> _u(64 - bits)).astype(np.int64)
    first = np.concatenate([[True], at[1:] != at[:-1]])  # the smallest of each register, as the hashes are sorted
    rest = own[first] << _u(bits)
    zeros = np.minimum(52 - np.frexp((rest >> _u(12)).astype(np.float64))[1], 40)
    mantissa = ((rest << (zeros + 1).astype(np.uint64)) >> _u(64 - MANTISSA)).astype(np.uint16)
    out[at[first]] = (zeros + 1).astype(np.uint16) << np.uint16(MANTISSA) | mantissa
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """Keys of the bands of each row of registers; 0 for a band that holds nothing."""
    groups = registers.reshape(len(registers), COARSE, -1)
    at = (groups > 0).argmax(2)
    coarse = np.take_along_axis(groups, at[:, :, None], 2)[:, :, 0].astype(np.uint64)
    coarse = np.where(coarse > 0, coarse << _u(8) | at.astype(np.uint64), _u(0))
    used = coarse[:, : COARSE // ROWS * ROWS].reshape(len(registers), -1, ROWS)
    keys = np.zeros(used.shape[:2], np.uint64)
    for j in range(ROWS):
        keys = mixed(keys * _u(_ODD) + used[:, :, j] + _u(j + 1))
    keys = mixed(keys + np.arange(keys.shape[1], dtype=np.uint64)) | _u(1)
    return np.where(used.any(2), keys, _u(0))


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard similarity, its standard error at a similarity near 0.85) of rows of registers of sets of n_a and n_b elements.

    Equal registers of unequal elements are expected as the published approximation for HyperMinHash says, and taken off. The
    error allows for the share of the union that the registers hold: of small sets they hold nearly all.
    """
    filled = np.maximum(((a > 0) | (b > 0)).sum(-1), 1)
    equal = ((a == b) & (a > 0)).sum(-1)
    more, less = np.maximum(n_a, n_b).astype(float), np.minimum(n_a, n_b).astype(float)
    ratio = less / np.maximum(more, 1)
    chance = 0.169919487159739 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    found = np.maximum(0.0, (equal / filled - chance) / (1 - chance))
    union = np.maximum((n_a + n_b) / (1 + 0.85), 1)
    error = np.sqrt(0.85 * 0.15 / filled * np.clip(1 - filled / union, 0.02, 1)) + 1 / filled / 2
    return found, error


def jaccard_parts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and of the union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
