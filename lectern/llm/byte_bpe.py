"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text longer than a chunk is cut into chunks that overlap.  All chunks of all
texts are cut into pre-tokens at once, each from its own start.  Where a match
of the pattern ends depends only on where it starts and on what follows, so
from the first border that two neighbouring chunks agree on (where they
resynchronise) the later one's borders are those of the whole text.  Stitched
there, the pieces between such places are encoded on their own, again all at
once, and their ids are put together.  Decoding concatenates the raw bytes of
the ids.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, groupby
from operator import itemgetter
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps, pick, ship, turn

#: Characters of a chunk, and of what it has in common with the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 9
#: A match is final if it ends this many characters before the chunk does: the pattern looks no further ahead.
AHEAD = 2
#: Pre-tokens that a Python worker remembers at most; it forgets all of them at once.
WORDS = 300_000
#: Bytes of output that a worker gathers before it hands them on.
BATCH = 8 << 20
#: Bytes of a pre-token from which on merges are found by a heap.
LONG = 48
Chunk = tuple[int, str, list[int]]


class ByteBPE:
    """Ranks of byte strings (.tiktoken) and the pattern whose matches are encoded one by one."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def merged(self, word: bytes) -> list[int]:
        """The ids of one pre-token: the adjacent pair of least rank, the leftmost of equal ones, is merged until none has a rank."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        if len(word) >= LONG:
            return self._merged_by_heap(word)
        get, none = ranks.get, len(self.tokens)
        cuts, near = list(range(len(word) + 1)), [get(word[i : i + 2], none) for i in range(len(word) - 1)]
        while near and (least := min(near)) < none:
            at = near.index(least)
            del cuts[at + 1], near[at]
            if at < len(near):
                near[at] = get(word[cuts[at] : cuts[at + 2]], none)
            if at:
                near[at - 1] = get(word[cuts[at - 1] : cuts[at + 1]], none)
        return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:])]

    def _merged_by_heap(self, word: bytes) -> list[int]:
        ranks, n = self.ranks, len(word)
        ends = list(range(1, n + 1))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def rank(at: int) -> int | None:
            then = after[at]
            return ranks.get(word[at : ends[then]]) if then < n else None

        heap = [(r, at) for at in range(n - 1) if (r := rank(at)) is not None]
        heapify(heap)
        while heap:
            r, at = heappop(heap)
            if ends[at] < 0 or rank(at) != r:  # a part of the pair was merged since
                continue
            gone = after[at]
            ends[at], ends[gone], after[at] = ends[gone], -1, after[gone]
            if after[at] < n:
                before[after[at]] = at
            for k in (before[at], at):
                if k >= 0 and (own := rank(k)) is not None:
                    heappush(heap, (own, k))
        out, at = [], 0
        while at < n:
            out.append(ranks[word[at : ends[at]]])
            at = after[at]
        return out

    def encode_words(self, words: list[str]) -> bytes:
        """Ids of pre-tokens as little-endian unsigned 32-bit integers."""
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            new = {w for w in words if w not in known}
        if len(known) + len(new) > WORDS:
            known.clear()
            new = set(words)
        own = {}
        for w in new:
            ids = self.merged(w.encode())
            own[w] = pack(f"<{len(ids)}I", *ids)
        out = b"".join([own[w] if w in own else known[w] for w in words])
        known.update((w, x) for w, x in own.items() if len(w) <= 64)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_words(self.pattern.findall(text))

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def borders(self, start: int, text: str, last: bool) -> list[int]:
        """Where a chunk that starts at ``start`` has borders of pre-tokens, its own start first; final matches only."""
        out, most = [start], len(text) if last else len(text) - AHEAD
        for m in self.pattern.finditer(text):
            if m.end() > most:
                break
            out.append(start + m.end())
        return out

    def stitch(self, chunks: Iterable[Chunk]) -> Iterator[tuple[str, list[int]]]:
        """Pieces (text, ends of its pre-tokens) of one text from its chunks (start, text, borders) in order.

        The borders of the first chunk are the text's.  A chunk that has none in common with what comes before is
        joined to it, and the joined text is matched from the last certain border, each time it has doubled.
        """
        at, held, sure, tried = 0, "", [0], 0
        for start, text, borders, last in lookahead(chunks):
            if not held:
                at, held, sure = start, text, borders
                continue
            had = set(borders)
            both = next((b for b in sure[bisect_left(sure, start) :] if b in had), None)
            if both is None:
                held += text[at + len(held) - start :]
                if not last and len(held) < 2 * tried:
                    continue
                tried = len(held)
                known = sure[-1]
                sure += self.borders(known, held[known - at :], last)[1:]
                both = next((b for b in sure[bisect_left(sure, max(start, known)) :] if b in had), None)
                if both is None:
                    continue
            if both > at:
                yield held[: both - at], [b - at for b in sure[1 : bisect_left(sure, both) + 1]]
            at, held, sure, tried = both, text[both - start :], borders[bisect_left(borders, both) :], 0
        if held:
            yield held, [b - at for b in sure[1:]]


def lookahead(chunks: Iterable[Chunk]) -> Iterator[tuple[int, str, list[int], bool]]:
    """Each chunk, with whether it is the last one."""
    before = None
    for chunk in chunks:
        if before is not None:
            yield *before, False
        before = chunk
    if before is not None:
        yield *before, True


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> ByteBPE:
    """One for each Python worker, which serves many tasks."""
    return ByteBPE(path, pattern)


keeps("byte_bpe", vocabulary.cache_clear)


class Out:
    """Rows gathered into batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, size: int, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += size
        if self.held >= BATCH or len(self.rows) >= 10_000:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*self.rows), self.schema, strict=True)], schema=self.schema)
        self.rows, self.held = [], 0


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one after the other; only the values of one row are Python objects at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def round_trip(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (raw bytes) of every row of doc_id, text.

    A null or empty text has no ids and decodes to no bytes.  Rows are
    independent: null and repeated doc_ids, repeated rows and copies give a row
    each (a text longer than a chunk is encoded once for all its rows); other
    columns are ignored, whatever their names; an empty table gives none.
    ``chunk`` must be twice ``overlap`` at least.
    """
    if not 0 < 2 * overlap <= chunk:
        raise ValueError("a chunk must be twice as long as what it has in common with the next one")
    ship(docs.sparkSession)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    coded = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("byte_bpe")
        bpe, out = vocabulary(path, pattern), Out(coded)
        for doc_id, text in rows_of(batches):
            ids = bpe.encode(text)
            decoded = bpe.decode(ids)
            yield from out.add(len(ids) + len(decoded), doc_id, ids, decoded)
        yield from out.rest()

    short = rows.where(F.length("text") <= chunk).mapInArrow(whole, "doc_id long, ids binary, decoded binary")
    long = rows.where(F.length("text") > chunk).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    # one row a text, found in each task first
    texts = long.groupBy("key").agg(F.any_value("text").alias("text"))
    long_rows = long.select("doc_id", "key").join(encoded_by_chunks(texts, path, pattern, chunk, overlap), "key")
    return short.unionByName(long_rows.select("doc_id", "ids", "decoded"))


def encoded_by_chunks(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """key, ids, decoded of texts (key, text) of different keys, each cut into chunks."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("key", pa.string()), ("k", pa.int64()), ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string())]))
        for key, text in rows_of(batches):
            for k, start in enumerate(range(0, max(len(text) - overlap, 1), chunk)):
                own = text[start : start + chunk + overlap]
                yield from out.add(len(own), key, k, start, start + len(own) == len(text), own)
        yield from out.rest()

    def pretokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        out = Out(pa.schema([("key", pa.string()), ("k", pa.int64()), ("start", pa.int64()), ("text", pa.string()), ("borders", pa.list_(pa.int64()))]))
        for key, k, start, last, text in rows_of(batches):
            borders = bpe.borders(start, text, last)
            yield from out.add(len(text) + 8 * len(borders), key, k, start, text, borders)
        yield from out.rest()

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        out = Out(pa.schema([("key", pa.string()), ("k", pa.int64()), ("text", pa.string()), ("ends", pa.list_(pa.int64()))]))
        for key, own in groupby(rows_of(batches), key=itemgetter(0)):
            for k, (text, ends) in enumerate(bpe.stitch((start, text, borders) for _, _, start, text, borders in own)):
                yield from out.add(len(text) + 8 * len(ends), key, k, text, ends)
        yield from out.rest()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, out = vocabulary(path, pattern), Out(pa.schema([("key", pa.string()), ("k", pa.int64()), ("ids", pa.binary())]))
        for key, k, text, ends in rows_of(batches):
            ids = bpe.encode_words([text[a:b] for a, b in zip(chain([0], ends), ends)])
            yield from out.add(len(ids), key, k, ids)
        yield from out.rest()

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, out = vocabulary(path, pattern), Out(pa.schema([("key", pa.string()), ("ids", pa.binary()), ("decoded", pa.binary())]))
        for key, own in groupby(rows_of(batches), key=itemgetter(0)):
            ids = b"".join([r[2] for r in own])
            decoded = bpe.decode(ids)
            yield from out.add(len(ids) + len(decoded), key, ids, decoded)
        yield from out.rest()

    chunks = texts.mapInArrow(cut_up, "key string, k long, start long, last boolean, text string").repartition("key", "k")
    marked = chunks.mapInArrow(pretokenised, "key string, k long, start long, text string, borders array<long>")
    pieces = marked.repartition("key").sortWithinPartitions("key", "k").mapInArrow(stitched, "key string, k long, text string, ends array<long>")
    ids = pieces.repartition("key", "k").mapInArrow(encoded, "key string, k long, ids binary")
    return ids.repartition("key").sortWithinPartitions("key", "k").mapInArrow(together, "key string, ids binary, decoded binary")
