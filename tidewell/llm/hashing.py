"""64-bit digests of words and of runs of words, for many texts at once (numpy, inside tasks)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np

#: Bytes hashed in one go; texts are cut between words where they are longer.
CHUNK = 1 << 18
#: Words of more bytes get a cryptographic digest: polynomials modulo 2**64 can be made to collide on long words.
LONG_WORD = 512
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[str, np.ndarray] = {}


def _power(base: int, name: str, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        _powers[name] = np.cumprod(p)
    return _powers[name]


def _hash_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, digests) of the words in a buffer that ends with white space."""
    space = _SPACE[buf]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    n = len(buf)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_LETTER[buf] * _power(_BASE, "up", n)[:n], out=sums[1:])
    down = _power(pow(_BASE, -1, 1 << 64), "down", n)
    h = mix((sums[ends] - sums[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return starts, h


def _pieces(text: bytes) -> Iterable[bytes]:
    """Cuts a long text between words."""
    at = 0
    while len(text) - at > CHUNK:
        cut = max(text.rfind(c, at, at + CHUNK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:  # one word longer than a chunk
            after = [p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := text.find(c, at + CHUNK)) >= 0]
            cut = min(after, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of all texts one after another, and how many each text has."""
    counts, found, some, owners, size = np.zeros(len(texts), np.int64), [], [], [], 0

    def flush() -> None:
        nonlocal size
        if some:
            buf = np.frombuffer(b"\n".join(some) + b"\n", np.uint8)
            starts, h = _hash_words(buf)
            ends = np.cumsum([len(x) + 1 for x in some])
            per = np.diff(np.searchsorted(starts, ends), prepend=0)
            np.add.at(counts, owners, per)
            found.append(h)
            some.clear()
            owners.clear()
            size = 0

    for i, text in enumerate(texts):
        for piece in _pieces(text) if len(text) > CHUNK else (text,):
            if size + len(piece) > CHUNK:
                flush()
            some.append(piece)
            owners.append(i)
            size += len(piece) + 1
    flush()
    return (np.concatenate(found) if found else np.empty(0, np.uint64)), counts


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Digest of every run of ``n`` words, by the place of its first word; also those across texts."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    size, out = len(words) - n + 1, np.zeros(len(words) - n + 1, np.uint64)
    factor = 1
    for k in range(n):
        out += words[k : k + size] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    return mix(out)
