"""Vectorised word and shingle hashing of whole texts, shared by the text operators.

A word is a run of bytes other than ASCII white space, with A-Z lower-cased.  Its hash is a polynomial over the
bytes modulo 2**64, read off prefix sums, so the cost per byte does not depend on the number of words.  Texts
are hashed in pieces cut at white space, which bounds memory whatever the text's length.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PIECE_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = False
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if n <= 4 * _PIECE_BYTES:
            _powers[name] = table
    return table[:n]


def _pieces(data: bytes, between: np.ndarray):
    at = 0
    while len(data) - at > _PIECE_BYTES:
        end = at + _PIECE_BYTES
        while end < len(data) and not between[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def _hash_piece(data: bytes, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word."""
    if not data:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~between[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power_table("up", _BASE, len(raw)), out=sums[1:])
    own = (sums[ends] - sums[starts]) * _power_table("down", _BASE_INVERSE, len(raw))[starts]
    return mix(own + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts, ends


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash for each word of the text, in order; none for a null text."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    parts = [_hash_piece(p, _SPACE)[0] for p in _pieces(text.encode("utf-8", "surrogatepass").lower(), _SPACE)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each run of ASCII letters and digits, A-Z lower-cased."""
    at, parts = 0, []
    for piece in _pieces(text.encode("utf-8", "surrogatepass").lower(), _SEPARATOR):
        hashes, starts, ends = _hash_piece(piece, _SEPARATOR)
        parts.append((hashes, starts + at, ends + at))
        at += len(piece)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, in order; a shorter text is one run of all its words."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD1342543DE82EF95) + words[i : i + n]
    return mix(out)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(gram_hashes(word_hashes(text), k))
