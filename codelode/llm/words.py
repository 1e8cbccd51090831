"""Words of Arrow text columns as dictionary codes, for the operators that work in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (runs without ``[\\x20\\x09-\\x0D]``, A-Z lower-cased), the code of every word in order, and each text's bounds."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    codes = coded.indices.to_numpy()
    if "" in words:
        real = codes != words.index("")
        kept = np.concatenate([[0], np.cumsum(real)])
        codes, bounds = codes[real], kept[bounds]
    return words, codes, bounds


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Of each text the sorted 64-bit hashes of its distinct ``k``-word shingles; with fewer words the whole sequence is one."""
    words, codes, bounds = coded_words(texts)
    hashes = word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        rolled += mixed(hashes[j : j + len(rolled)] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64)))
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), seed=b - a)], dtype=np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
