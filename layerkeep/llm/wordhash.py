"""Words of many texts at once as numbers, and Rabin-Karp hashes of runs of words.

A word is the BLAKE2b digest of its UTF-8. A run is a polynomial over its words
modulo a prime, evaluated by doubling: the hash of 2k words is that of the
first k, times a power of the base, plus that of the last k. There are two
such hashes: one of 61 bits modulo 2^61 - 1, and one of 31 bits modulo 2^31 - 1
for those who need more. Prime moduli leave no texts, such as Thue-Morse words,
that collide whatever the base.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa

WIDE, NARROW = 2**61 - 1, 2**31 - 1
WIDE_BASE, NARROW_BASE = 0x0D3A_61C5_92F7_4B1E, 0x5B1D_37A9

#: A-Z as a-z, other bytes as they are.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text, and for each word its numbers below ``WIDE`` and ``NARROW``); words part at white space."""
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    parts = [(x.translate(LOWER) if lower else x).split() for x in raw]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    coded = pa.array(list(chain.from_iterable(parts)), pa.large_binary()).dictionary_encode()
    digests = b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in coded.dictionary.to_pylist()])
    at = coded.indices.to_numpy()
    numbers = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return counts, (numbers[:, 0] % np.uint64(WIDE))[at], (numbers[:, 1] % np.uint64(NARROW))[at]


def wide_times(a: np.ndarray, c: int) -> np.ndarray:
    """a * c modulo ``WIDE``, from products of at most 62 bits."""
    u = np.uint64
    c1, c0 = u(c >> 31), u(c & 0x7FFFFFFF)
    a1, a0 = a >> u(31), a & u(0x7FFFFFFF)
    middle = a1 * c0
    middle += a0 * c1
    a1 *= c1
    a1 += a1
    a0 *= c0
    a1 += a0
    a1 += middle >> u(30)
    middle &= u(0x3FFFFFFF)
    middle <<= u(31)
    a1 += middle
    return folded(a1, 61)


def narrow_times(a: np.ndarray, c: int) -> np.ndarray:
    """a * c modulo ``NARROW``."""
    return folded(folded(a * np.uint64(c), 31), 31)


def folded(x: np.ndarray, bits: int) -> np.ndarray:
    """A number of less than 2^64 (for 61 bits) or 2^62 (for 31) nearer to below the Mersenne prime of so many bits."""
    p = np.uint64((1 << bits) - 1)
    out = x & p
    x >>= np.uint64(bits)
    out += x
    out[out == p] = 0
    return np.where(out > p, out - p, out) if bits == 61 else out


def runs(numbers: np.ndarray, size: int, wide: bool = True) -> np.ndarray:
    """The hash of every ``size`` consecutive words: len(numbers) - size + 1 of them."""
    n = len(numbers)
    if n < size or not size:
        return np.zeros(0, np.uint64)
    prime, base = (WIDE, WIDE_BASE) if wide else (NARROW, NARROW_BASE)

    def joined(left: np.ndarray, right: np.ndarray, k: int, length: int) -> np.ndarray:
        """Hashes of runs of left's length, then ``length`` words of ``right``."""
        ahead = right[k : k + n]
        power = pow(base, length, prime)
        out = (wide_times if wide else narrow_times)(left[: len(ahead)], power)
        out += ahead
        return folded(out, 61 if wide else 31)

    out, have, power, k = None, 0, numbers, 1
    while True:
        if size & k:
            out, have = (power, k) if out is None else (joined(out, power, have, k), have + k)
        if have == size:
            return out
        power, k = joined(power, power, k, k), 2 * k
