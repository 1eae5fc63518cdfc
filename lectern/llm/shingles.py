"""Word shingles of whole texts, hashed column by column with Arrow and numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are cut into words at once.
SLICE = 4 << 20
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


#: Bits of a shingle's hash, and counts of shingles, and of words, in a sketch.
BITS = np.uint64(56)
LOW = (np.uint64(1) << BITS) - np.uint64(1)
BUCKETS = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def sliced(batch: pa.RecordBatch, column: int = 1, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of about ``size`` (else SLICE) bytes of text; one text is never cut."""
    size = size or SLICE
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # what was freed goes back to the system


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words, text after text, and how many each text has.

    A-Z are lower-cased; words lie between ASCII white space.
    """
    # a copy that starts at 0: pyarrow's ascii_lower reads a slice of large strings at wrong places
    own = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
    lower = pc.ascii_lower(own)
    parts = pc.ascii_split_whitespace(lower)
    words = parts.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(words), 0)
    owner = owner[real.to_numpy(zero_copy_only=False)]
    coded = words.filter(real).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return hashes[codes] if len(codes) else np.empty(0, np.uint64), np.bincount(owner, minlength=len(texts))


def sets_of(word: np.ndarray, counts: np.ndarray, width: int, rarity: Rarity | None = None) -> list[np.ndarray]:
    """For each text the sorted distinct hashes, 56 bits each, of its ``width``-word shingles.

    A text of fewer words is one shingle; one without words has none.  With
    ``rarity`` a number that rises with a shingle's frequency stands above the
    56 bits, so that rare ones come first.
    """
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        joined = np.zeros(max(0, len(word) - width + 1), np.uint64)
        for k in range(width):
            joined = mixed(joined + word[k : k + len(joined)] + MIX[0])
        joined &= LOW
        if rarity:
            joined |= rarity.classes(word, joined, width) << BITS
        for end, n in zip(np.cumsum(counts), counts, strict=True):
            start = end - n
            if n >= width:
                out.append(np.unique(joined[start : end - width + 1]))
            elif n:
                h = np.array([n], np.uint64)
                for x in word[start:end]:
                    h = mixed(h + x + MIX[0])
                out.append(h & LOW)
            else:
                out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    return sets_of(*words_of(texts), width)


def sketch(word: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles, and how many words, fall into each of BUCKETS buckets."""
    grams = np.concatenate(sets) >> (BITS - np.uint64(16)) if sets else np.empty(0, np.uint64)
    return np.concatenate([np.bincount(x.astype(np.int64), minlength=BUCKETS) for x in (grams, word >> np.uint64(48))])


class Rarity:
    """How frequent shingles are, told from a sketch of all documents.

    The more frequent a shingle's words, the likelier it is to occur elsewhere
    by chance; and what stands out of its bucket occurs often whatever its
    words are.
    """

    def __init__(self, counts: np.ndarray) -> None:
        grams, words = counts[:BUCKETS].astype(np.float64), counts[BUCKETS:].astype(np.float64)
        mean = max(grams.mean(), 1.0)
        beyond = grams - mean - 4 * np.sqrt(mean)
        self.grams = np.where(beyond > 1, np.log2(np.maximum(beyond, 1)), -np.inf).astype(np.float32)
        self.words = np.log2(np.maximum(words, 1) / max(words.sum(), 1)).astype(np.float32)
        self.total = np.float32(np.log2(max(grams.sum(), 1)))

    def classes(self, word: np.ndarray, joined: np.ndarray, width: int) -> np.ndarray:
        """A number below 256 for each shingle that starts at each word: twice the logarithm of its frequency, moved up."""
        each = self.words[(word >> np.uint64(48)).astype(np.int64)]
        log = np.full(len(joined), self.total, np.float32)
        for k in range(width):
            log += each[k : k + len(joined)]
        log = np.maximum(log, self.grams[(joined >> (BITS - np.uint64(16))).astype(np.int64)])
        return np.clip(2 * (log + 64), 0, 255).astype(np.uint64)


def signature(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share, as two signed 64-bit integers; rarity doesn't count."""
    with np.errstate(over="ignore"):
        hashes = mixed((hashes & LOW) + MIX[1])
        a = hashes.sum(dtype=np.uint64)
        b = mixed(hashes + MIX[0]).sum(dtype=np.uint64)
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))


def as_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
