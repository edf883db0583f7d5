"""Draws of a bootstrap in bulk: MD5 of many short texts at a time, for Arrow tasks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

_ADD = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_LEFT = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
#: Texts hashed at a time, so that their words stay in a core's cache; positions whose digits are kept; bytes of a text in one block.
CHUNK, STRIPE, BLOCK = 16_384, 262_144, 55


def _first_words(words: list) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of MD5 over one block each; a word of the block is a number or an array."""
    n = max(len(w) for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, high = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word, fixed = words[_WORD[i]], _ADD[i]
        if isinstance(word, np.ndarray):
            np.add(f, word, out=f)
        else:
            fixed = fixed + word & 0xFFFFFFFF
        np.add(f, np.uint32(fixed), out=f)
        np.left_shift(f, np.uint32(_LEFT[i]), out=high)
        np.right_shift(f, np.uint32(32 - _LEFT[i]), out=f)
        np.bitwise_or(f, high, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return a + np.uint32(0x67452301), b + np.uint32(0xEFCDAB89)


def _tails(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digits of numbers and the end mark, a row of bytes each, and how many digits there are."""
    digits = positions.astype(f"S{len(str(int(positions[-1])))}").view(np.uint8).reshape(len(positions), -1)
    lengths = np.count_nonzero(digits, axis=1)
    tails = np.zeros((len(positions), digits.shape[1] + 1), np.uint8)
    tails[:, :-1] = digits
    tails[np.arange(len(positions)), lengths] = 0x80
    return tails, lengths


def _aligned(tails: np.ndarray, offset: int) -> np.ndarray:
    """Rows of bytes as columns of words, after ``offset`` bytes of zero."""
    width = -(-(offset + tails.shape[1]) // 4) * 4
    padded = np.zeros((len(tails), width), np.uint8)
    padded[:, offset : offset + tails.shape[1]] = tails
    return np.ascontiguousarray(padded.view("<u4").T)


def _uniforms(prefix: bytes, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text, ``prefix`` and a tail, a number in [0, 1) from the first 52 bits of its MD5."""
    head, at = np.frombuffer(prefix.ljust(64, b"\0"), "<u4").tolist(), len(prefix) // 4
    block: list = [*head]
    for k, word in enumerate(words[: 14 - at]):
        block[at + k] = word | np.uint32(head[at + k])
    block[14] = (8 * (len(prefix) + lengths)).astype(np.uint32)
    a, b = (w.byteswap() for w in _first_words(block))
    return ((a.astype(np.uint64) << np.uint64(20)) | (b >> np.uint32(12))).astype(np.float64) / float(1 << 52)


def _plain(prefix: bytes, positions: np.ndarray) -> np.ndarray:
    """The same for texts of any length, one at a time."""
    hashed = (hashlib.md5(prefix + str(p).encode()).hexdigest() for p in positions.tolist())
    return np.array([int(h[:13], 16) for h in hashed], np.float64) / float(1 << 52)


def draws(prefix: str, replicates: list[int], n: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(replicates, indices) with a row of indices for each replicate: floor(u * n) for each of the positions ``low`` to ``high``,
    u from the MD5 of 'prefix:replicate:position'.  A replicate comes once for each run of positions."""
    start = f"{prefix}:".encode()
    for first in range(low, high, STRIPE):
        positions = np.arange(first, min(first + STRIPE, high))
        tails, lengths = _tails(positions)
        kept: dict[int, np.ndarray] = {}
        together = max(1, CHUNK // len(positions))
        by_digits: dict[int, list[int]] = {}
        for rep in replicates:
            by_digits.setdefault(len(str(rep)), []).append(rep)
        for digits, reps in by_digits.items():
            fits = len(start) + digits + 1 + int(lengths[-1]) <= BLOCK
            for k in range(0, len(reps), together if fits else 1):
                some = reps[k : k + (together if fits else 1)]
                head = f"{some[0]}:".encode()
                if not fits:
                    u = _plain(start + head, positions)
                elif len(some) > 1:
                    heads = np.frombuffer("".join(f"{r}:" for r in some).encode(), np.uint8).reshape(len(some), 1, -1)
                    both = np.concatenate([np.broadcast_to(heads, (len(some), len(tails), heads.shape[2])), np.broadcast_to(tails, (len(some), *tails.shape))], axis=2)
                    u = _uniforms(start, _aligned(both.reshape(-1, both.shape[2]), len(start) % 4), np.tile(lengths + len(head), len(some)))
                else:
                    offset = len(start + head) % 4
                    if offset not in kept:
                        kept[offset] = _aligned(tails, offset)
                    parts = (slice(j, j + CHUNK) for j in range(0, len(positions), CHUNK))
                    u = np.concatenate([_uniforms(start + head, kept[offset][:, p], lengths[p]) for p in parts])
                yield np.array(some), np.floor(u * n).astype(np.int64).reshape(len(some), -1)
