"""Sets of word shingles as 64-bit hashes, a chunk of texts at a time.

Texts are UTF-8 bytes. A-Z become a-z; words are runs of bytes other than \\x20 and \\x09-\\x0D,
which is what bytes.split() cuts at. A word's hash is the sum of a random number for each pair of a byte and
its place (words of more than LONG bytes go by their 128-bit digests); a shingle's hash combines those of its words. So
memory follows the chunk's size, whatever the length of a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of a word that are hashed byte by byte.
LONG = 64
_TABLE = np.random.default_rng(20240229).integers(0, 2**64, LONG * 256, np.uint64)
_STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def key(ws: list[bytes]) -> tuple[int, int]:
    """128 bits of the word sequence, as two signed longs."""
    d = xxhash.xxh3_128_digest(b" ".join(ws))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; no word is empty."""
    if not ws:
        return np.empty(0, np.uint64)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    if lengths.max() > LONG:
        ws = [w if len(w) <= LONG else b"\0long\0" + xxhash.xxh3_128_digest(w) for w in ws]
        lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    buf = np.frombuffer(b"".join(ws), np.uint8)
    place = (np.arange(len(buf), dtype=np.int32) - np.repeat(starts, lengths).astype(np.int32)) << 8
    place |= buf
    return mix(np.add.reduceat(_TABLE.take(place), starts))


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, by their words' hashes."""
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out *= np.uint64(_STEP)
        out += h[j : len(h) - k + 1 + j]
    return mix(out, k)


def shingle_sets(chunk: list[list[bytes]], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each word list: with fewer than n words the whole list is one, with none there is none."""
    h = word_hashes([w for ws in chunk for w in ws])
    runs = _shingles(h, n) if len(h) >= n else h[:0]
    out, at = [], 0
    for ws in chunk:
        end = at + len(ws)
        out.append(np.unique(runs[at : end - n + 1]) if len(ws) >= n else _shingles(h[at:end], len(ws)) if ws else h[:0])
        at = end
    return out


def chunks(texts: list[bytes | None], size: int = 1 << 19) -> Iterator[range]:
    """Ranges of rows whose texts take about `size` bytes together; a longer text is a chunk of its own."""
    first = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and held + n > size:
            yield range(first, i)
            first, held = i, 0
        held += n
    if first < len(texts):
        yield range(first, len(texts))


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches: for each set t coordinates; sets agree in one with probability about their Jaccard similarity.

    In round i < t every element falls in a hashed bin with a hashed value; in round t + b every
    element falls in bin b, so after 2 t rounds each bin of a set that isn't empty is filled. Earlier
    rounds win, then smaller values. A set takes part until a round ends with all its bins filled.
    """
    out = np.full((len(sets), t), np.uint64(2**64 - 1))
    sizes = np.array([len(s) for s in sets])
    live = np.flatnonzero(sizes)
    if not len(live):
        return out
    x = np.concatenate([sets[i] for i in live])
    of = np.repeat(live, sizes[live])
    flat = out.reshape(-1)
    for i in range(2 * t):
        h = mix(x, i + 1)
        value = np.uint64(i) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, of * t + bins, value)
        if i < 4 or i % 8 == 0 or i >= 2 * t - 1:
            full = (out[live] != np.uint64(2**64 - 1)).all(axis=1)
            if full.any():
                if full.all():
                    break
                done = np.zeros(len(sets), bool)
                done[live[full]] = True
                stay = ~done[of]
                x, of, live = x[stay], of[stay], live[~full]
    return out
