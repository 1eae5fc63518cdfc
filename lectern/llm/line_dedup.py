"""Line dedup: aligned common blocks go from the later of two documents.

A line ends at a newline or after a sentence, so a passage is found wherever
it stands.  Overlapping documents are found through hashes of least blocks:
stretches of lines that are just long enough to be rare.  A document is paired
with every document that is the first to have one of its least blocks, however
many have it later, so a block that a third of all documents share gives each
of them one partner.  A pair's least blocks are aligned by patience diff: an
increasing run of those that are unique in both, then the same between any two
of them, and the longest increasing run where none is unique.  What a pair has
in common out of order, or more than once, is aligned again until nothing is
left, so a moved passage goes as well as one that stands in its place.  The
lines that go are aligned ones, and those of all stretches of enough words that
stand in any earlier document, which the tests hold against all pairs.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, pick, ship, turn
from .shingles import MIX, mixed, sliced

#: A common block goes only if it has as many words in all.
BLOCK_WORDS = 10
#: Between any two places of a text where this matches, there is one line.
BORDER = re.compile(r"(?<=\n)|(?<=[.!?])(?=[ \t])")
#: Odd bases of the two rolling hashes; 3 mod 8, so that places far apart differ in nearly all bits.
BASES = (np.uint64(0x9E3779B97F4A7C13), np.uint64(0xD1B54A32D192ED03))
SPACE = "\t\n\x0b\x0c\r "


def lines_of(text: str) -> list[str]:
    """The lines of a text; joined they are the text."""
    return [x for x in BORDER.split(text) if x]


def plain(line: str) -> str:
    """What makes lines equal: all of a line but the white space around it."""
    return line.strip(SPACE)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that increases in both places."""
    tails: list[int] = []
    tail_at: list[int] = []
    back: list[int] = []
    # of pairs with one first place no two can stand in a run: the larger ones come first
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back.append(tail_at[k - 1] if k else -1)
        tails[k : k + 1] = [b]
        tail_at[k : k + 1] = [i]
    run, i = [], tail_at[-1] if tail_at else -1
    while i >= 0:
        run.append(pairs[i])
        i = back[i]
    return run[::-1]


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The (later, earlier) places that a patience diff matches, of all places of equal lines.

    Anchors are pairs whose places occur in no other pair.  Of these the longest
    increasing run stays, and the pairs between two of its anchors are treated
    likewise; where there is no anchor, the longest increasing run of all pairs
    stays.
    """
    if all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:])):
        return list(pairs)
    out: list[tuple[int, int]] = []
    waiting = [pairs]
    while waiting:
        some = waiting.pop()
        lefts, rights = Counter(a for a, _ in some), Counter(b for _, b in some)
        run = increasing([(a, b) for a, b in some if lefts[a] == rights[b] == 1])
        out += run or increasing(some)
        if not run or len(run) == len(some):
            continue
        later, earlier = [a for a, _ in run], [b for _, b in run]
        gaps = defaultdict(list)
        for a, b in some:
            k = bisect_left(later, a)
            if bisect_left(earlier, b) == k and (k == len(run) or (a < later[k] and b < earlier[k])):
                gaps[k].append((a, b))
        waiting += gaps.values()
    return sorted(out)


#: Times that what is left of a pair is aligned as a whole before it is dealt onto piles.
AGAIN = 8


def alignments(pairs: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Patience diff of all pairs, then of those that it left, and so on until it leaves none.

    Pairs that cross each other over and over are dealt onto piles at last, as
    patience sorting does, and each pile, which is an increasing run, is
    aligned: the work stays in proportion to the pairs, but for a logarithm.
    """
    left = sorted(set(pairs))
    for _ in range(AGAIN):
        run = patience(left)
        if not run:
            return
        yield run
        aligned = set(run)
        left = [p for p in left if p not in aligned]
    piles: list[list[tuple[int, int]]] = []
    tops: list[tuple[int, int]] = []  # (-b, -a) of each pile's last pair, ascending
    for a, b in sorted(left, key=lambda p: (p[0], -p[1])):
        k = bisect_left(tops, (1 - b, -a))  # the first pile that ends before b
        if k < len(piles) and piles[k][-1][0] < a:
            piles[k].append((a, b))
            tops[k] = (-b, -a)
        else:
            k = bisect_left(tops, (-b, -a))
            piles.insert(k, [(a, b)])
            tops.insert(k, (-b, -a))
    for pile in piles:
        yield patience(pile)


def blocks(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """The later document's places in stretches that are adjacent in both documents."""
    out: list[list[int]] = []
    last = (-2, -2)
    for a, b in patience(pairs):
        if out and (a, b) == (last[0] + 1, last[1] + 1):
            out[-1].append(a)
        else:
            out.append([a])
        last = (a, b)
    return out


def windows_of(owns: list[list[str]], block_words: int) -> tuple[np.ndarray, ...]:
    """text, start, end, h1 and h2 of all least blocks of the texts' plain lines; start and end count over all texts.

    A least block is a stretch of lines that has ``block_words`` words and
    would have fewer without its last line, or without its first one.  It is
    found from each line on, and from each line back, so a stretch in common
    that has the words is covered by least blocks in common.
    """
    flat = [x for own in owns for x in own]
    sizes = np.array([len(own) for own in owns], dtype=np.int64)
    text = np.repeat(np.arange(len(owns)), sizes)
    ends = np.cumsum(sizes)
    words = np.concatenate([[0], np.cumsum(np.array([len(x.split()) for x in flat], dtype=np.int64))])
    n = len(flat)
    at = np.arange(n)
    # from each line on
    to = np.searchsorted(words, words[:-1] + block_words, side="left")
    on = to <= ends[text] if n else np.zeros(0, bool)
    # from each line back, where it is not one of those
    since = np.searchsorted(words, words[1:] - block_words, side="right") - 1
    back = since >= (ends - sizes)[text] if n else np.zeros(0, bool)
    back &= ~(on[since] & (to[since] == at + 1)) if n else back
    start, end = np.concatenate([at[on], since[back]]), np.concatenate([to[on], at[back] + 1])
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, flat)), dtype="<u8").reshape(-1, 2)
    out = []
    with np.errstate(over="ignore"):
        for k, base in enumerate(BASES):
            up = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, base, np.uint64))])
            down = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, pow(int(base), -1, 1 << 64), np.uint64))])
            total = np.concatenate([[np.uint64(0)], np.cumsum(both[:, k] * up[:n], dtype=np.uint64)])
            out.append(mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * MIX[0]))
    return text[start] if n else start, start, end, out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def window_hashes(docs: DataFrame, block_words: int) -> DataFrame:
    """doc_id, and of each different least block of a text its hash, h1 and h2 of 96 bits, and the line at which it begins first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("line_dedup")
        for batch in batches:
            for part in sliced(batch):
                owns = [[plain(x) for x in lines_of(t or "")] for t in part.column(1).to_pylist()]
                text, start, _, h1, h2 = windows_of(owns, block_words)
                at = start - np.concatenate([[0], np.cumsum([len(own) for own in owns])])[text]
                order = np.lexsort((at, h2, h1, text))
                text, h1, h2, at = text[order], h1[order], h2[order], at[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(owns)))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h1[new], h2[new], at[new].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["doc_id", "h1", "h2", "at"])

    return docs.mapInArrow(run, "doc_id long, h1 array<long>, h2 array<int>, at array<int>")


def overlapping(docs: DataFrame, block_words: int) -> DataFrame:
    """doc_id and matches (h1, first_doc, first_at): its least blocks that an earlier document has, and the first one that does.

    A block costs one row a document however often it occurs: nobody but the
    first document that has it is anybody's partner for it.
    """
    hashes = cut(window_hashes(docs, block_words))
    rows = hashes.select("doc_id", F.explode(F.arrays_zip("h1", "h2", "at")).alias("h")).select("doc_id", "h.h1", "h.h2", "h.at")
    first = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last"), F.min_by("at", "doc_id").alias("first_at")).where("first_doc < last").drop("last")
    found = rows.drop("at").join(first, ["h1", "h2"]).where("doc_id > first_doc")
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "first_doc", "first_at")).alias("matches"))


def cut_out(lines: list[str], hashes: np.ndarray, docs: np.ndarray, places: np.ndarray, block_words: int = BLOCK_WORDS) -> tuple[list[int], list[dict]]:
    """The places of the lines that go, and the blocks that they are aligned in.

    ``hashes`` are of least blocks that stand in earlier ``docs`` at these
    ``places``; each of these documents is aligned with the lines in turn.
    """
    _, start, end, h1, _ = windows_of([[plain(x) for x in lines]], block_words)
    order = np.argsort(hashes, kind="stable")
    at = np.minimum(np.searchsorted(hashes[order], h1), len(hashes) - 1)
    hit = np.flatnonzero(hashes[order][at] == h1)
    start, end, doc, there = start[hit], end[hit], docs[order][at[hit]], places[order][at[hit]]
    gone = np.zeros(len(lines), bool)
    found: list[dict] = []
    order = np.lexsort((there, start, doc))
    for own in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
        if not len(own):
            continue
        ends: dict[tuple[int, int], int] = {}
        for a, at_, b in zip(start[own].tolist(), there[own].tolist(), end[own].tolist(), strict=True):
            ends[a, at_] = max(b, ends.get((a, at_), 0))
        for run in alignments(list(ends)):
            for a, at in run:
                b, shift = ends[a, at], at - a
                last = found[-1] if found else None
                if last and last["doc_id"] == doc[own[0]] and last["at"] - last["start"] == shift and last["start"] <= a <= last["start"] + last["lines"]:
                    last["lines"] = max(last["lines"], b - last["start"])
                else:
                    found.append({"start": a, "lines": b - a, "doc_id": int(doc[own[0]]), "at": at})
                gone[a:b] = True
    return np.flatnonzero(gone).tolist(), found


BLOCK = pa.struct([("start", pa.int32()), ("lines", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int32())])


def line_dedup(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text (what stays), n_lines, removed (places of the lines that went), blocks, and the other columns, for every row.

    A line goes if it lies in a stretch of lines, ``block_words`` words or more
    in all, that stands in any document of smaller doc_id as well, whatever
    that one keeps of it; white space around lines does not count, blank lines
    do.  So the first document with a stretch keeps it, as does every document
    for what it repeats itself.  ``blocks`` lists what was aligned: the first
    of its lines, how many, and where they stand in which earlier document.
    ``block_words`` keeps sentences of a word or two, which any two documents
    may share by chance, from clean documents.  Rows that share a doc_id are
    not held against each other, but all against earlier ones.  Null texts stay
    null, empty ones empty; a row without doc_id is left as it is; an empty
    table gives none.  Columns of ``docs`` that bear a result's name are
    replaced by the result.  A very long text is one row of a task.
    """
    ship(docs.sparkSession)
    extra = [c for c in docs.columns if c.lower() not in ("doc_id", "text", "n_lines", "removed", "blocks")]
    docs = pick(docs, "doc_id", "text", *extra)
    rows = docs.where("doc_id IS NOT NULL")
    found = overlapping(rows.select("doc_id", "text").where("text <> ''"), block_words)
    flat = docs.toDF("doc_id", "text", *[f"__{i}" for i in range(len(extra))])
    both = flat.join(found, "doc_id", "left").select("doc_id", "text", "matches", *flat.columns[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("line_dedup")
        for batch in batches:
            for part in sliced(batch):
                found = part.column(2)
                flat = [x.to_numpy(zero_copy_only=False) for x in found.flatten().flatten()]
                sizes = pc.fill_null(pc.list_value_length(found), 0).to_pylist()
                texts, counts, gone, blocks, start = [], [], [], [], 0
                for text, n in zip(part.column(1).to_pylist(), sizes, strict=True):
                    lines = lines_of(text or "")
                    own, start = slice(start, start + n), start + n
                    places, aligned = cut_out(lines, *[x[own] for x in flat], block_words) if n else ([], [])
                    drop = set(places)
                    texts.append("".join([x for i, x in enumerate(lines) if i not in drop]) if places else text)
                    counts.append(len(lines))
                    gone.append(places)
                    blocks.append(aligned)
                done = [part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.list_(pa.int32())), pa.array(blocks, pa.list_(BLOCK))]
                yield pa.RecordBatch.from_arrays([*done, *[part.column(i) for i in range(3, part.num_columns)]], names)

    names = ["doc_id", "text", "n_lines", "removed", "blocks", *extra]
    own = T.StructType.fromDDL("doc_id long, text string, n_lines long, removed array<int>, blocks array<struct<start: int, lines: int, doc_id: long, at: int>>")
    return both.mapInArrow(run, T.StructType([*own.fields, *docs.schema.fields[2:]]))
