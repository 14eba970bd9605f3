"""MD5 of many short keys at once, equal to ``hash_key``, for tasks that make several keys of one row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

from ..roles import ContractError

#: Bits of a digest that are used, keys that are hashed at once, and the longest key (one block of MD5).
WORD, AT_ONCE, LONGEST = 52, 1 << 16, 55
#: Tails that are hashed at once, so that the arrays of a step stay in a core's cache.
TAILS = 1 << 14
_ADDED = [int(abs(np.sin(np.float64(i + 1))) * 2**32) for i in range(64)]
_TURNED = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_words(words: Sequence[int | np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests of ``n`` blocks; each of the 16 ``words`` is a number or an array."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, low = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            at = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        word, added = words[at], _ADDED[i]
        if isinstance(word, np.ndarray):
            np.add(a, word, out=a)
        else:
            added = (added + word) % (1 << 32)
        np.add(a, np.uint32(added), out=a)
        np.right_shift(a, np.uint32(32 - _TURNED[i]), out=low)
        np.left_shift(a, np.uint32(_TURNED[i]), out=a)
        np.bitwise_or(a, low, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])


@lru_cache(maxsize=2)
def _numerals(upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits and the mark that ends a key, as bytes of a number, and how many digits."""
    if upto > 10_000_000:
        raise ContractError("a counter has too many digits")
    texts = [str(j).encode() for j in range(upto)]
    return np.array([int.from_bytes(t + b"\x80", "little") for t in texts], np.uint64), np.array([len(t) for t in texts], np.uint32)


def counted_bits(prefixes: Sequence[str], counts: np.ndarray, first: int = 0) -> np.ndarray:
    """The first ``WORD`` bits of the MD5 of each prefix followed by a number, for ``counts`` numbers from ``first`` on."""
    keys, counts = [p.encode() for p in prefixes], np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.uint64)
    if max(map(len, keys)) + len(str(first + int(counts.max()))) > LONGEST:
        raise ContractError("a key is too long")
    blocks = np.frombuffer(b"".join(k.ljust(64, b"\0") for k in keys), "<u4").reshape(-1, 16)
    lengths, ends = np.array([len(k) for k in keys], np.int64), counts.cumsum()
    digits, many = _numerals(1 << (first + int(counts.max())).bit_length())
    out = np.empty(total, np.uint64)
    for start in range(0, total, AT_ONCE):
        at = np.arange(start, min(start + AT_ONCE, total))
        key = np.searchsorted(ends, at, "right")
        j = at - (ends - counts)[key] + first
        own, places = lengths[key], range(int(lengths.min()) // 4, int(lengths.max()) // 4 + 3)
        words = [blocks[key, k] if k in places or (blocks[:, k] != blocks[0, k]).any() else int(blocks[0, k]) for k in range(14)]
        for length in np.unique(own).tolist():
            rows = slice(None) if lengths.min() == lengths.max() else np.nonzero(own == length)[0]
            value, shift, k = digits[j[rows]], length % 4 * 8, length // 4
            low = value << np.uint64(shift)
            for word, part in ((k, low.astype(np.uint32)), (k + 1, (low >> np.uint64(32)).astype(np.uint32)), (k + 2, (value >> np.uint64(64 - shift)).astype(np.uint32) if shift else None)):
                if part is not None and word < 14:
                    words[word][rows] |= part
        a, b = _first_words([*words, 8 * (own.astype(np.uint32) + many[j]), 0], len(at))
        out[at] = _bits(a, b)
    return out


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.byteswap().astype(np.uint64) << np.uint64(20) | b.byteswap().astype(np.uint64) >> np.uint64(12)


def tailed_bits(prefixes: Sequence[str], tails: Sequence[str]) -> Iterator[np.ndarray]:
    """For each prefix the first ``WORD`` bits of the MD5 of it followed by each of ``tails``.  The words of tails are laid out once
    for all prefixes of a length; keys of more than a block are hashed one by one."""
    ends = np.array([t.encode() for t in tails], object)
    size = np.array([len(t) for t in ends], np.int64)
    groups = [(length, np.nonzero(size == length)[0]) for length in np.unique(size).tolist()]
    parts = [(length, rows[at : at + TAILS]) for length, rows in groups for at in range(0, len(rows), TAILS)]
    laid: dict[int, list] = {}
    before = None
    for prefix in map(str.encode, prefixes):
        if len(prefix) != before:
            laid, before = {}, len(prefix)
        out = np.empty(len(ends), np.uint64)
        head = np.frombuffer(prefix.ljust(64, b"\0")[:64], "<u4").tolist()
        for i, (length, rows) in enumerate(parts):
            if before + length > LONGEST:
                out[rows] = [int.from_bytes(hashlib.md5(prefix + t).digest()[:8], "big") >> 64 - WORD for t in ends[rows]]
                continue
            if i not in laid:
                block = np.zeros((len(rows), 64), np.uint8)
                block[:, before : before + length] = np.frombuffer(b"".join(ends[rows]), np.uint8).reshape(len(rows), length)
                block[:, before + length] = 0x80
                laid[i] = list(block.view("<u4").T[: (before + length) // 4 + 1].copy())
            first, own = before // 4, laid[i]
            words = [head[k] if k < first else own[k] | np.uint32(head[k]) if k == first else own[k] if k < len(own) else 0 for k in range(14)]
            out[rows] = _bits(*_first_words([*words, 8 * (before + length), 0], len(rows)))
        yield out
