"""Best-fit decreasing packing of token sequences.

Best fit treats pieces of one length alike and bins of one remaining capacity
alike, so it runs on counts: the lengths' histogram (at most ``capacity`` rows,
whatever the corpus) is packed in order of length, a segment tree over
remaining capacities finding the tightest open bins in logarithmic time, and
what comes out are runs: so many pieces of a length, by rank, into bins from a
number on.  Pieces get their ranks and bins in Spark.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PAIRS, WordBPE
from .common import cut, keeps, pick, ship, turn
from .sharding import numbered

END_ID = 1
#: Runs (48 bytes each) up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_RUNS = 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Words that a worker remembers, twice over; some 200 bytes each.
WORDS = 600_000


class Run(NamedTuple):
    """Pieces of ``length`` from rank ``first`` to ``last``: ``each`` a bin, from bin ``bin`` and place ``at`` on."""

    length: int
    first: int
    last: int
    bin: int
    each: int
    at: int


class Capacities:
    """A segment tree over 0 .. capacity: which remaining capacities open bins have."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)

    def put(self, at: int, on: bool) -> None:
        i = at + self.size
        self.tree[i] = on
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity that is on and not below ``least``."""
        i, tree = least + self.size, self.tree
        if tree[i]:
            return least
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing of ``histogram`` (length -> pieces), as runs.

    The tightest open bin that fits a piece stays the tightest for the next of
    the same length until it is full for it, so a bin with room r takes r //
    length of them in a row, and bins of equal room go one after another.
    """
    runs: list[Run] = []
    room: defaultdict[int, deque[tuple[int, int]]] = defaultdict(deque)  # remaining capacity -> (first bin, bins)
    open_at, bins = Capacities(capacity), 0

    def leave(left: int, first: int, n: int) -> None:
        if left and n:
            room[left].append((first, n))
            open_at.put(left, True)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        done, total = 0, histogram[length]
        while done < total:
            left = open_at.tightest(length)
            if left is None:
                left, first, n = capacity, bins, -(-(total - done) // (capacity // length))
                bins += n
            else:
                first, n = room[left].popleft()
                if not room[left]:
                    open_at.put(left, False)
            each = left // length
            filled = min(n, (total - done) // each)
            if filled:
                runs.append(Run(length, done, done + filled * each, first, each, capacity - left))
                leave(left - each * length, first, filled)
                done += filled * each
            if filled < n and (rest := min(each, total - done)):
                runs.append(Run(length, done, done + rest, first + filled, rest, capacity - left))
                leave(left - rest * length, first + filled, 1)
                done += rest
                filled += 1
            if filled < n:
                room[left].appendleft((first + filled, n - filled))
                open_at.put(left, True)
    return runs


class LongestFirst(WordBPE):
    """The same ids as the tokenizers library gives, found by trying the longest token first.

    A token stays if it is compatible with the one before it; if none that
    starts here does, the one before is shortened, and a place that once led
    nowhere is not entered again.  Most words need one look a token, which is
    cheaper than merging them or filling a table over all prefixes.  No look
    goes further than the longest token, so a word costs what its length does.
    """

    def __init__(self, path: str, words: int = WORDS) -> None:
        super().__init__(path, words)
        self.most = max(map(len, self.ids))

    def encode_word(self, word: str) -> list[int]:
        ids, longest, pairs = self.ids, self.automaton.longest_prefix, self.pairs
        s = self.as_symbols(word)
        n, at, out, starts, dead, most = len(s), 0, [], [], set(), self.most
        size = longest(s[:most])
        while True:
            token = None
            while size:
                end = at + size
                token = ids.get(s[at:end])
                if token is not None and end not in dead:
                    if not out:
                        break
                    key = out[-1] << 20 | token
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        fits = pairs[key] = not self._clash(out[-1], token)
                    if fits:
                        break
                token = None
                size -= 1
            if token is not None:
                out.append(token)
                starts.append(at)
                at = end
                if at == n:
                    return out
                size = longest(s[at : at + most])
            elif out:
                dead.add(at)
                size = at - starts[-1] - 1
                at = starts.pop()
                out.pop()
            else:
                raise ValueError(f"no encoding of {word!r}")


@lru_cache(maxsize=2)
def word_encoder(path: str, words: int = WORDS) -> LongestFirst:
    return LongestFirst(path, words)


keeps("packing", word_encoder.cache_clear)


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = END_ID, words: int = WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and ``end_id``, cut at ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("packing")
        encoder, end = word_encoder(path, words), np.uint32(end_id).tobytes()
        for batch in batches:
            keys, pieces, starts, lengths, sums = [], [], [], [], []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    keys.append(key.as_py())
                    pieces.append(k)
                    starts.append(at // 4)
                    lengths.append(len(own) // 4)
                    sums.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    return pick(docs, "doc_id", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = 4_096, end_id: int = END_ID, words: int = WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document packed.

    Only documents longer than ``capacity`` are cut.  Null and empty texts are
    the end id alone.  Pieces of one length are ranked by doc_id and piece;
    repeated rows are packed each, null doc_ids like any other.  Other columns
    are ignored, whatever their names.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = cut(tokenized_pieces(docs, path, capacity, end_id, words))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    packed = best_fit(counts, capacity)
    runs = spark.createDataFrame([tuple(r) for r in packed], "length long, first long, last long, bin long, each long, at long")
    ranked = numbered(pieces, "length", ["doc_id", "piece"], "rank", sum(counts.values()))
    hint = F.broadcast if len(packed) <= BROADCAST_RUNS else (lambda x: x)
    placed = ranked.join(hint(runs), (ranked["length"] == runs["length"]) & F.col("rank").between(F.col("first"), F.col("last") - 1)).drop(runs["length"])
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"),
    )
