"""Vectorised word scanning of whole UTF-8 texts with numpy.

A byte table says what every byte is: 0 a separator, else the byte it counts
as. Words are hashed many at a time, eight bytes in each step; a text longer
than a window is cut at separators only.
"""

from __future__ import annotations

import hashlib

import numpy as np

WINDOW = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: White space of words: x20 and x09-x0D; A-Z counts as a-z.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[0x20, *range(0x09, 0x0E)]] = 0
PLAIN[65:91] += 32
PLAIN[0] = 65  # a NUL byte belongs to a word; no other byte maps to 65

#: As PLAIN, and ASCII punctuation separates as well.
LETTERS = PLAIN.copy()
LETTERS[[b for b in range(256) if b < 128 and not chr(b).isalnum()]] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    size = max(WINDOW * 2, n)
    if size not in _powers:
        _powers.clear()
        ups = np.full(size, _P, dtype=np.uint64)
        downs = np.full(size, _PINV, dtype=np.uint64)
        ups[0] = downs[0] = 1
        _powers[size] = (np.cumprod(ups, dtype=np.uint64), np.cumprod(downs, dtype=np.uint64))
    return _powers[size]


_C = [np.uint64(c) for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25)]

#: Bytes from which a word is hashed by blake2b; up to them its 8-byte chunks are chained.
LONG = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_CHAIN = np.uint64(0xD1342543DE82EF95)


def _chunk(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ``size`` bytes (8 at most) from place ``at`` on, as whole numbers; ``words`` are the bytes in aligned eights."""
    cell = at >> 3
    shift = (at & 7).astype(np.uint64) << np.uint64(3)
    # The upper part is shifted in two steps, since a shift by 64 is none.
    return (words[cell] >> shift | (words[cell + 1] << np.uint64(1)) << (np.uint64(63) - shift)) & _MASKS[size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans of a byte array. A span's hash depends on its own bytes only.

    Every chunk goes through a one-to-one mix before the next is added, so that spans of one
    length up to 8 never collide and longer ones have no collisions by their form.
    """
    words = np.zeros(len(data) // 8 + 2, np.uint64)
    words.view(np.uint8)[: len(data)] = data
    size = ends - starts
    start = (seed * int(_C[1]) + int(_CHAIN)) & (1 << 64) - 1
    out = mix(_chunk(words, starts, np.minimum(size, 8)) + np.uint64(start))
    more = np.flatnonzero(size > 8)
    at = 8
    while len(more) and at < LONG:
        out[more] = mix(out[more] * _CHAIN + _chunk(words, starts[more] + at, np.minimum(size[more] - at, 8)))
        at += 8
        more = more[size[more] > at]
    for i in more.tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        out[i] = int.from_bytes(digest.digest(), "little")
    return mix(out + size.astype(np.uint64) * _C[2])


def _scan(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """starts and ends of the words of one window that ends in a separator."""
    inside = np.empty(len(kept) + 1, bool)
    inside[0] = False
    np.not_equal(kept, 0, out=inside[1:])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def _pieces(texts: list[bytes], table: np.ndarray):
    """(text number, window) such that no word is cut."""
    for i, t in enumerate(texts):
        if len(t) <= WINDOW:
            yield i, t
            continue
        at = 0
        while at < len(t):
            end = min(len(t), at + WINDOW)
            while end < len(t):
                gaps = np.flatnonzero(table[np.frombuffer(t, np.uint8, end - at, at)] == 0)
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                    break
                end = min(len(t), end + WINDOW)
            yield i, t[at:end]
            at = end


def windows(texts: list[bytes], table: np.ndarray = PLAIN):
    """Windows over many texts: (bytes, word starts, word ends, word hashes, text number of each word)."""
    for raw, kept, starts, ends, owner in _spans(texts, table):
        yield kept, starts, ends, span_hashes(kept, starts, ends), owner


def _spans(texts: list[bytes], table: np.ndarray):
    """(bytes, bytes as the table counts them, word starts, word ends, text number of each word) of each window."""
    group: list[bytes] = []
    owner: list[int] = []
    size = 0

    def scan():
        raw = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
        kept = table[raw]
        starts, ends = _scan(kept)
        bounds = np.cumsum([0] + [len(g) + 1 for g in group])
        return raw, kept, starts, ends, np.repeat(np.asarray(owner), np.diff(np.searchsorted(starts, bounds)))

    for i, piece in _pieces(texts, table):
        if group and size + len(piece) > WINDOW:
            yield scan()
            group, owner, size = [], [], 0
        group.append(piece)
        owner.append(i)
        size += len(piece) + 1
    if group:
        yield scan()


def word_hashes(texts: list[bytes], table: np.ndarray = PLAIN, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes of all words of all texts in order, and offsets of each text (one more than texts).

    Further tables, which separate at the same bytes, give further arrays of hashes
    of the same words; the offsets stand last.
    """
    parts: list[list[np.ndarray]] = [[] for _ in range(1 + len(others))]
    at = np.zeros(len(texts) + 1, np.int64)
    for raw, kept, starts, ends, owner in _spans(texts, table):
        parts[0].append(span_hashes(kept, starts, ends))
        for own, other in zip(parts[1:], others, strict=True):
            own.append(span_hashes(other[raw], starts, ends))
        at[1:] += np.bincount(owner, minlength=len(texts))
    return *(np.concatenate(p) if p else np.empty(0, np.uint64) for p in parts), np.cumsum(at)




def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, k at most 8; run i starts at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n] * _C[0]
    for j in range(1, k):
        out = out + words[j : n + j] * _C[j]
    return mix(out + np.uint64(k))


def shingle_sets(texts: list[bytes], k: int = 5, table: np.ndarray = PLAIN) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; a text of fewer words has one, none has none."""
    words, at = word_hashes(texts, table)
    runs = ngram_hashes(words, k)
    out = []
    for i in range(len(texts)):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
        elif b > a:
            out.append(ngram_hashes(words[a:b], b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def groups(texts: list, limit: int = 8 << 20):
    """Slices (lo, hi) of a batch whose texts together stay near ``limit`` characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)
