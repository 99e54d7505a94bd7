"""Byte-level BPE ids of many texts at once.

The ids are those of a ``tokenizers`` file (add_special_tokens=False, special
strings as ordinary text). Texts are split into pieces with numpy over all their
characters; each distinct piece is encoded once by tiktoken with the file's own
vocabulary and kept in a bounded cache. Texts with characters for which the
split rule is not plainly decided by the table (apostrophes, rare white space,
anything from U+0250) go through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array

import numpy as np

from .textscan import span_hashes

LIMIT = 0x250
#: Pieces kept by a worker before the cache starts anew.
CACHE = 150_000
#: Characters of a piece that is kept.
LONGEST = 256
#: Characters that are split at once.
CHARS = 1 << 20
_L, _N, _S, _O, _BAD = 1, 2, 3, 4, 0


def _classes() -> np.ndarray:
    out = np.zeros(LIMIT, np.uint8)
    for c in range(LIMIT):
        kind = unicodedata.category(chr(c))
        if c in (0x20, *range(0x09, 0x0E)):
            out[c] = _S
        elif c == 0x27 or 0x1C <= c <= 0x1F or c in (0x85, 0xA0) or kind == "Cn":
            out[c] = _BAD
        else:
            out[c] = {"L": _L, "N": _N}.get(kind[0], _O)
    return out


CLASSES = _classes()


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes lists of texts with the ids of a byte-level ``tokenizers`` file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken

        self.path, self._exact = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        chars = _byte_chars()
        ranks = {bytes(chars[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        # Pieces come ready split, so the pattern takes each whole.
        self.pieces = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache: dict[str, bytes] = {}

    @property
    def exact(self):
        """``tokenizers`` itself, loaded when the first text needs it."""
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.path)
            self._exact.encode_special_tokens = True
        return self._exact

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32), and the offsets of each text (one more than texts)."""
        parts: list = [None] * len(texts)
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > CHARS:
                self._group(texts, group, parts)
                group, size = [], 0
            group.append(i)
            size += len(t)
        if group:
            self._group(texts, group, parts)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=at[1:])
        return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), at

    def _group(self, texts: list[str], group: list[int], parts: list) -> None:
        joined = "".join(texts[i] for i in group)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where(chars < LIMIT, CLASSES[np.minimum(chars, LIMIT - 1)], _BAD)
        at = np.cumsum([0] + [len(texts[i]) for i in group])
        bad = np.concatenate(([0], np.cumsum(kind == _BAD)))
        odd = bad[at[1:]] > bad[at[:-1]]
        if odd.any():
            for g in np.flatnonzero(odd):
                parts[group[g]] = np.array(self.exact.encode(texts[group[g]], add_special_tokens=False).ids, np.uint32)
            plain = [group[g] for g in np.flatnonzero(~odd)]
            if plain:
                self._group(texts, plain, parts)
            return
        if not len(chars):
            for i in group:
                parts[i] = np.empty(0, np.uint32)
            return
        got = self._split(joined, chars, kind, at[:-1][np.diff(at) > 0], at)
        if got is None:
            for i in group:
                parts[i] = np.array(self.exact.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            return
        ids, count = got
        for g, i in enumerate(group):
            parts[i] = ids[count[g] : count[g + 1]]

    def _split(self, joined: str, chars: np.ndarray, kind: np.ndarray, heads: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all texts and their offsets; None if two pieces cannot be told apart by their hashes."""
        n = len(chars)
        head = np.zeros(n + 1, bool)
        head[heads] = True
        head[n] = True
        space = kind == _S
        start = np.empty(n, bool)
        start[0] = True
        # A piece starts where the class changes, but not behind the one blank that belongs to it.
        start[1:] = (kind[1:] != kind[:-1]) & ~((chars[:-1] == 0x20) & ~space[1:])
        # The last of several white spaces is a piece's blank or stands alone.
        last = space[:-1] & ~space[1:] & ~head[1:n]
        start[:-1] |= last
        start |= head[:n]
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)
        # Every character is below 2**16. Pieces of up to four have hashes of their own by construction;
        # longer ones must agree in a second hash, or nothing is taken from the table.
        data, size = chars.astype("<u2").view(np.uint8), end - begin
        keys, second = span_hashes(data, 2 * begin, 2 * end), size.astype(np.uint64)
        longer = np.flatnonzero(size > 4)
        second[longer] += span_hashes(data, 2 * begin[longer], 2 * end[longer], seed=1)
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if (second != second[first][inverse]).any():
            return None
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, own = self.cache, []
        for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True):
            piece = joined[a:b]
            ids = cache.get(piece)
            if ids is None:
                ids = array("I", self.pieces(piece)).tobytes()
                if len(piece) <= LONGEST:
                    cache[piece] = ids
            own.append(ids)
        lengths = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat = np.frombuffer(b"".join(own), np.uint32)
        offsets = np.cumsum(lengths) - lengths
        out_len = lengths[inverse]
        ends = np.cumsum(out_len)
        pos = np.arange(int(ends[-1])) + np.repeat(offsets[inverse] - (ends - out_len), out_len)
        before = np.concatenate(([0], ends))
        return flat[pos], before[np.searchsorted(begin, at)]
