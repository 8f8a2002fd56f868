"""SimHash fingerprints of word shingles, on bytes."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

SEED = 42
_digest = xxhash.xxh64_intdigest


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII white space; null gives none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``n`` words, repeats included; fewer words give one shingle, none give none."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([_digest(b" ".join(words), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(n))))
    return np.fromiter(map(_digest, runs, repeat(SEED)), np.uint64, len(words) - n + 1)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, least significant first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 64):  # bounded memory for very long texts
        part = np.ascontiguousarray(hashes[at : at + 255 * 64])
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64)
        whole = len(part) // 255
        total += bits[whole * 255 :].sum(0, dtype=np.uint8)
        if whole:  # sums of at most 255 fit a byte, which keeps the additions narrow
            total += bits[: whole * 255].reshape(whole, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return total


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes; no hashes give 0."""
    bits = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])
