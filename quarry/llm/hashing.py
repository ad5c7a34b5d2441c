"""Word and n-gram hashes shared by the operators on word sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers of the polynomial and mixing steps.
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def batch_words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct words (between ASCII white space) of a
    batch, the number of each word of all texts in a row among them, and the
    bounds of each text. Arrow numbers the distinct words, each of which is
    hashed once; ``lower`` folds A-Z."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    bounds = cut.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    numbered = cut.flatten().dictionary_encode()
    distinct = numbered.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    number = numbered.indices.to_numpy()
    if b"" in distinct:  # white space at the ends of a text
        word = number != distinct.index(b"")
        bounds = np.append(0, np.cumsum(word))[bounds]
        number = number[word]
    return hashes, number, bounds


def batch_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (between ASCII white space) of all texts in a
    row, and the bounds of each text; see ``batch_words``."""
    hashes, number, bounds = batch_words(column, lower)
    return hashes[number], bounds


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD[0]
    return x ^ (x >> np.uint64(29))


def gram_hashes(words: np.ndarray, size: int, base: np.uint64 = ODD[0]) -> np.ndarray:
    """Polynomial hash of every ``size`` consecutive words, by doubling."""
    n = len(words) - size + 1
    total, have, power, block, width = np.zeros(n, np.uint64), 0, base, words, 1
    left = size
    with np.errstate(over="ignore"):
        while left:
            if left & 1:  # the next `width` words, after those already taken in
                total = total * power + block[have : have + n]
                have += width
            left >>= 1
            if left:
                block = block[:-width] * power + block[width:]
                width, power = 2 * width, power * power
    return mix(total)
