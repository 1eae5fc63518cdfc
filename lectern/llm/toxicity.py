"""Toxicity from the nearest labelled examples by TF-IDF cosine.

Labelled rows, a bounded sample of each class, are the examples, and all words
in them, and the beginnings of longer ones, the terms.  A term's weight is its inverse document frequency, counted
over all documents, raised by how much it tells about the class: phi squared of
its presence against the label among the examples, less what chance alone would
give (the bias-corrected estimate).  A term that tells nothing keeps the plain
weight, so every term of an example can bring a document to it; without the
raise long documents are nearest to those of their own vocabulary, whatever a
few words in them say.  Examples lie in an inverted index.  Lists of rare terms
are short and are added up whole; the terms that a good part of the examples has
are a matrix in single precision, multiplied for many documents at once.  Sums
of weights, none negative, are off by a known share at most, and the largest of
each block of examples tell a cosine that the nearest reach; all examples that
may reach it are told again in double precision.  So the nearest are found
exactly.  Votes of the nearest, weighted by nearness, are calibrated on the
examples themselves, each left out of its own vote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added_up, cut, pick, ship, stretches, turn
from .shingles import MIX, mixed, sliced

#: Labelled rows of each class that are fitted on at most, chosen by a hash of their id.
EXAMPLES = 4_096
#: Letters of the word beginnings that are terms beside whole words.
STEM = 5
NEIGHBOURS, BLOCK = 15, 16
#: The plain weight beside the raise, which is 1 for a term that tells the classes apart by itself.
PLAIN = 1e-4
#: Terms of at least this share of the examples, and so many of them, are a matrix, multiplied for so many documents at once.
FREQUENT, LEAST, TOGETHER = 1 / 16, 64, 128
#: What a product or a sum in single precision is off by at most, as a share, twice over.
HALF_STEP = 2.0**-23
#: Examples' weight by which a step of the calibration is drawn to the share of toxic ones.
DRAWN = 20
#: Documents of equal terms and counts that a task remembers.
SEEN = 50_000
EVIDENCE = "array<struct<doc_id: long, cosine: double, toxic: int>>"
Row = tuple[int, np.ndarray, np.ndarray, int]
#: Bytes of text that are cut into words at once, and of a word that is hashed beside others.
SLICE, LONG = 1 << 20, 64


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of the texts, in lower case; and for each word that occurs its text and its place among them."""
    # a copy that starts at 0: pyarrow's lower functions read a slice of large strings at wrong places
    own = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
    parts = pc.split_pattern_regex(pc.utf8_lower(own), r"\PL+")
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    words = parts.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(real).dictionary_encode()
    return coded.dictionary, owner[real.to_numpy(zero_copy_only=False)], coded.indices.to_numpy(zero_copy_only=False)


def beginnings(words: pa.Array) -> pa.Array:
    """Of each word longer than STEM its beginning, as a term of its own; null for the others."""
    first = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, STEM), *[pa.scalar(x, words.type) for x in ("-", "")])
    return pc.if_else(pc.greater(pc.utf8_length(words), STEM), first, pa.scalar(None, first.type))


def hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word; a null has those of no word.

    Words are taken eight bytes at a time, all words at once; those longer than LONG one by one.
    """
    words = words.cast(pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    starts = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words)]
    held = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    out = sizes.astype(np.uint64)
    with np.errstate(over="ignore"):
        left = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        for done in range(0, LONG, 8):
            left = left[sizes[left] > done]
            if not len(left):
                break
            at, more = starts[left] + done, sizes[left] - done
            eight = held[np.minimum(at[:, None] + np.arange(8), len(held) - 1)].view("<u8")[:, 0]
            unused = 8 * np.maximum(0, 8 - more).astype(np.uint64)
            out[left] = mixed((out[left] + MIX[0]) ^ (eight << unused))
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(words[i].as_py())
    return out.view(np.int64)


def places_in(terms: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Where the hashes are among the terms; -1 where they aren't."""
    if not len(terms):
        return np.full(len(some), -1)
    order = np.argsort(some)  # neighbours look at the same part of the terms
    own = some[order]
    place = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
    out = np.empty(len(some), np.int64)
    out[order] = np.where((terms[place] == own) & (own != 0), place, -1)
    return out


def term_counts(texts: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, numbers, counts): the terms of text i and how often each occurs lie from bounds[i] to bounds[i + 1].

    ``terms`` are hashes in ascending order, so a task needs no strings of them.
    """
    words, owner, at = words_of(texts)
    first = beginnings(words).dictionary_encode()
    stems = np.append(hashes(first.dictionary), 0)[pc.fill_null(first.indices, -1).to_numpy(zero_copy_only=False)]
    pairs = []
    for some in (hashes(words), stems):
        number = places_in(terms, some)[at]
        known = number >= 0
        pairs.append(owner[known] * max(1, len(terms)) + number[known])
    pairs, counts = np.unique(np.concatenate(pairs), return_counts=True)
    owner, number = np.divmod(pairs, max(1, len(terms)))
    return np.searchsorted(owner, np.arange(len(texts) + 1)), number, counts


def joined(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches that lie one after the other elsewhere."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class BlockMaxIndex:
    """Examples by term weights: a matrix of frequent terms, lists of rare ones.

    A weight is ``gain`` of how often the term occurs, times the term's weight,
    over the example's norm; no weight is negative.
    """

    def __init__(self, rows: list[Row], weight: np.ndarray, share: tuple[float, float]) -> None:
        """rows: (doc_id, terms, counts, label); share: how many rows of the corpus each example of a class stands for."""
        self.weight = weight
        found = [(r, self.vector(r[1], r[2])) for r in rows]
        kept = [(r, x) for r, x in found if x.any()]
        kept.sort(key=lambda f: (f[0][1][int(np.argmax(f[1]))], f[0][3], f[0][0]))
        self.ids = [r[0] for r, _ in kept]
        self.labels = np.array([r[3] for r, _ in kept], dtype=np.float64)
        self.share = np.array([share[r[3]] for r, _ in kept])
        self.blocks = -(-len(kept) // BLOCK)
        none = np.empty(0, np.int32)
        term = np.concatenate([np.asarray(r[1], np.int32) for r, _ in kept] or [none])
        count = np.concatenate([np.asarray(r[2], np.int32) for r, _ in kept] or [none])
        example = np.repeat(np.arange(len(kept), dtype=np.int32), [len(x) for _, x in kept])
        counts = np.unique(count)
        #: How much a term counts that occurs so often, by the code of that.
        self.gain = 1 + np.log(counts.astype(np.float64))
        code = np.searchsorted(counts, count).astype(np.min_scalar_type(max(0, len(counts) - 1)))
        self.norm = np.sqrt(np.bincount(example, weights=(self.gain[code] * weight[term]) ** 2, minlength=len(kept)))
        term, example, code = (x[weight[term] > 0] for x in (term, example, code))
        # frequent terms: a row of weights each; and each example's own ones, to tell them in double precision
        self.frequent = np.flatnonzero(np.bincount(term, minlength=len(weight)) >= max(LEAST, FREQUENT * len(kept)))
        self.row = np.full(len(weight), -1, np.int32)
        self.row[self.frequent] = np.arange(len(self.frequent))
        row = self.row[term]
        own = row >= 0
        self.most = np.zeros((len(self.frequent), self.blocks * BLOCK), np.float32)
        self.most[row[own], example[own]] = self.gain[code[own]] * weight[term[own]] / self.norm[example[own]]
        self.own_row, self.own_code = row[own], code[own]
        self.own_start = np.searchsorted(example[own], np.arange(len(kept) + 1))
        # rare terms: postings, term t is in the examples from start[t] to start[t + 1], with these shares of its weight
        order = np.flatnonzero(~own)[np.argsort(term[~own], kind="stable")]
        self.posting = np.empty(len(order), [("example", np.int32), ("share", np.float32)])
        self.posting["example"], self.code = example[order], code[order]
        self.posting["share"] = self.gain[self.code] / self.norm[example[order]]
        self.start = np.searchsorted(term[order], np.arange(len(weight) + 1)).astype(np.min_scalar_type(-len(order) - 1))
        blank = [r for r, x in found if not x.any()]
        up = sum(share[1] for r in blank if r[3])
        down = sum(share[0] for r in blank if not r[3])
        every = sum(share[r[3]] for r in rows)
        #: The vote of a text without terms: the toxic share among such examples, drawn to that of all by one example's weight.
        prior = sum(share[1] for r in rows if r[3]) / every if every else 0.0
        self.blank = (up + prior) / (up + down + 1)
        self.curve = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    @property
    def weights(self) -> np.ndarray:
        """The index as a matrix of terms by examples."""
        out = np.zeros((len(self.weight), len(self.ids)))
        term, example = self.frequent[self.own_row], np.repeat(np.arange(len(self.ids)), np.diff(self.own_start))
        out[term, example] = self.gain[self.own_code] * self.weight[term]
        term = np.repeat(np.arange(len(self.weight)), np.diff(self.start))
        out[term, self.posting["example"]] = self.gain[self.code] * self.weight[term]
        return out / self.norm

    def vector(self, terms: list[int] | np.ndarray, counts: list[int] | np.ndarray) -> np.ndarray:
        """Weights of norm 1, or 0 where no term has any weight."""
        x = (1 + np.log(np.array(counts, dtype=np.float64))) * self.weight[np.array(terms, dtype=np.int64)]
        return x / max(np.sqrt((x * x).sum()), 1e-300)

    def nearest(self, terms: list[int] | np.ndarray, counts: list[int] | np.ndarray, skip: int | None = None) -> list[tuple[float, int]]:
        """``nearest_of`` one text."""
        return next(self.nearest_of([(np.array(terms, dtype=np.int64), np.array(counts), skip)]))

    def nearest_of(self, texts: list[tuple[np.ndarray, np.ndarray, int | None]]) -> Iterator[list[tuple[float, int]]]:
        """For each text (terms, counts, example that is passed over) the NEIGHBOURS examples of largest positive cosine, exactly: (cosine, place), ties by place."""
        for first in range(0, len(texts), TOGETHER):
            yield from self._nearest([(t, self.vector(t, c), skip) for t, c, skip in texts[first : first + TOGETHER]])

    def _nearest(self, texts: list[tuple[np.ndarray, np.ndarray, int | None]]) -> Iterator[list[tuple[float, int]]]:
        """The same for texts as vectors."""
        n, size, some = len(texts), self.blocks * BLOCK, len(self.ids)
        if not size:
            yield from ([] for _ in texts)
            return
        common, weight = np.zeros((n, len(self.most))), self.weight[self.frequent]
        packed = self.posting.view(np.int64)
        rows = [self.row[terms] for terms, *_ in texts]
        for own, row, (_, x, _) in zip(common, rows, texts, strict=True):
            own[row[row >= 0]] = x[row >= 0]
        nearly = common.astype(np.float32) @ self.most
        for own, about, row, (terms, x, skip) in zip(common, nearly, rows, texts, strict=True):
            rare = (row < 0) & (x > 0)
            terms, x = terms[rare], x[rare]
            starts = self.start[terms].astype(np.int64)
            sizes = self.start[terms + 1] - starts
            at, x = joined(starts, sizes), np.repeat(x * self.weight[terms], sizes)
            found = packed[at].view(self.posting.dtype)
            example = found["example"].astype(np.int64)
            cosine = about.astype(np.float64)
            cosine[:some] += np.bincount(example, weights=x * found["share"], minlength=some)
            if skip is not None:
                cosine[skip] = 0
            # similar examples lie side by side, so a block takes such that are far from each other; the nearest reach what NEIGHBOURS blocks have
            least = np.partition(cosine.reshape(BLOCK, self.blocks).max(axis=0), -NEIGHBOURS)[-NEIGHBOURS] if self.blocks > NEIGHBOURS else 0.0
            off = HALF_STEP * (np.count_nonzero(own) + 4)
            place = np.flatnonzero(cosine >= max(least * (1 - 2 * off) - 1e-11, 1e-13))
            # these again, in double precision
            again = np.zeros(some, bool)
            again[place] = True
            here = np.flatnonzero(again[example])
            rarely = np.bincount(np.searchsorted(place, example[here]), weights=x[here] * self.gain[self.code[at[here]]], minlength=len(place))
            sizes = self.own_start[place + 1] - self.own_start[place]
            at = joined(self.own_start[place], sizes)
            each = (own * weight)[self.own_row[at]] * self.gain[self.own_code[at]]
            often = np.bincount(np.repeat(np.arange(len(place)), sizes), weights=each, minlength=len(place))
            near = np.round((rarely + often) / self.norm[place], 12)
            place, near = place[near > 0], near[near > 0]
            best = np.lexsort((place, -near))[:NEIGHBOURS]
            yield list(zip(near[best].tolist(), place[best].tolist(), strict=True))

    def vote(self, found: list[tuple[float, int]]) -> float:
        """Each of NEIGHBOURS votes for its label with its cosine, and with what is left to 1 for the share of blank texts.

        So far neighbours, or few, leave a text near what one without terms gets.
        """
        if not found:
            return self.blank
        at = np.array([j for _, j in found])
        near = np.array([c for c, _ in found])
        share, rest = self.share[at], float(NEIGHBOURS - near.sum())
        return float(((near * share * self.labels[at]).sum() + rest * self.blank) / ((near * share).sum() + rest))

    def calibrate(self, votes: list[tuple[float, int]], share: tuple[float, float]) -> None:
        """Isotonic fit of labels on the votes of the examples, each without itself: (vote, label).

        Each step is drawn to the share of all by the weight of DRAWN examples,
        so that a few mislabelled ones make no step of their own.
        """
        every = sum(share[y] for _, y in votes)
        prior, pull = sum(share[y] for _, y in votes if y) / max(every, 1e-300), DRAWN * every / max(len(votes), 1)
        steps: list[list[float]] = []  # weight, weighted labels, lowest and highest vote
        for v, y, w in sorted((v, y, share[y]) for v, y in votes):
            steps.append([w, w * y, v, v])
            while len(steps) > 1 and steps[-2][1] * steps[-1][0] >= steps[-1][1] * steps[-2][0] or len(steps) > 1 and steps[-2][3] == steps[-1][2]:
                last = steps.pop()
                steps[-1] = [steps[-1][0] + last[0], steps[-1][1] + last[1], steps[-1][2], last[3]]
        xs, ys = [], []
        for w, up, low, high in steps:
            level = (up + pull * prior) / (w + pull)
            xs += [low, high] if high > low else [low]
            ys += [level] * (2 if high > low else 1)
        if xs:
            self.curve = (np.array(xs), np.maximum.accumulate(np.array(ys)))

    def score(self, found: list[tuple[float, int]]) -> tuple[float, list[tuple[int, float, int]]]:
        """Calibrated score of a text with these neighbours, and the three nearest as evidence."""
        raw = self.vote(found)
        score = 0.99 * float(np.interp(raw, *self.curve)) + 0.01 * raw
        return min(1.0, max(0.0, score)), [(self.ids[j], c, int(self.labels[j])) for c, j in found[:3]]


def examples_of(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """doc_id, toxic: at most ``bound`` labelled rows of each class, the same ones for the same ids."""
    own = pick(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    here = own.join(pick(docs, "doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), "doc_id"]
    return here.where("toxic = 1").orderBy(*order).limit(bound).unionByName(here.where("toxic = 0").orderBy(*order).limit(bound))


def vocabulary(learned: DataFrame) -> np.ndarray:
    """The hashes of all terms of the examples, in order: of 2 * EXAMPLES rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("toxicity")
        for batch in batches:
            for part in sliced(batch, 2, SLICE):
                words = words_of(part.column(2))[0]
                both = np.concatenate([hashes(words), hashes(beginnings(words).drop_null().unique())])
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(both[both != 0]), pa.int64())], ["term"])

    terms = learned.mapInArrow(run, "term long").distinct().toArrow().column("term").to_numpy()
    return np.sort(terms)


def document_frequencies(texts: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How many documents have each term, and as a last number how many there are."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("toxicity")
        terms = shared.value
        total = np.zeros(len(terms) + 1, dtype=np.int64)
        for batch in batches:
            for part in sliced(batch, 0, SLICE):
                total += np.bincount(term_counts(part.column(0), terms)[1], minlength=len(terms) + 1)
                total[-1] += len(part)
        if total.any():
            yield pa.RecordBatch.from_arrays(list(stretches(total)), ["at", "counts"])

    return added_up(texts.select("text").mapInArrow(run, "at int, counts array<long>"), len(terms) + 1)


def numbered_rows(learned: DataFrame, terms: np.ndarray) -> list[Row]:
    """The examples (doc_id, terms, counts, label); 2 * EXAMPLES rows at most."""
    shared = learned.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("toxicity")
        for batch in batches:
            for part in sliced(batch, 2, SLICE):
                bounds, number, counts = term_counts(part.column(2), shared.value)
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (number, counts)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["doc_id", "toxic", "terms", "counts"])

    found = learned.mapInArrow(run, "doc_id long, toxic int, terms array<int>, counts array<int>").toArrow()
    lists = [[x.values.to_numpy() for x in found.column(name)] for name in ("terms", "counts")]
    return sorted(zip(found.column("doc_id").to_pylist(), *lists, found.column("toxic").to_pylist(), strict=True), key=lambda r: r[0])


def class_information(rows: list[Row], terms: int) -> np.ndarray:
    """Bias-corrected phi squared between each term's presence and the label among the examples; 0 where there is one class alone."""
    none = np.empty(0, np.int64)
    seen = [np.bincount(np.concatenate([r[1] for r in rows if r[3] == y] or [none]), minlength=terms).astype(np.float64) for y in (0, 1)]
    n = [sum(r[3] == y for r in rows) for y in (0, 1)]
    has = seen[0] + seen[1]
    under = n[0] * n[1] * has * (sum(n) - has)
    phi = (seen[1] * (n[0] - seen[0]) - seen[0] * (n[1] - seen[1])) ** 2 / np.maximum(under, 1)
    return np.where(under > 0, np.maximum(0, phi - 1 / max(1, sum(n) - 1)), 0.0)


def score_documents(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, score, evidence of every row of ``docs``.

    ``labels`` (doc_id, toxic) are the rows to learn from; a doc_id labelled
    twice is toxic if it ever is, labels other than 0 and 1 or of unknown
    documents are passed over, and of documents that share an id the smallest
    text is the example.  score is in 0 .. 1; a null, empty or unknown text
    gets the toxic share among examples without terms that tell; without
    examples of both classes the score is the share of toxic ones, 0 without
    any.  evidence lists the nearest examples (doc_id, cosine, toxic); a text
    that is itself an example finds itself first.  Repeated rows get equal
    scores, other columns are ignored, an empty table gives none.
    """
    return scored(docs, labels, examples).select("doc_id", "score", "evidence")


def scored(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """``score_documents`` with all columns of ``docs``, of which those named like a result give way."""
    spark = docs.sparkSession
    ship(spark)
    extra = [c for c in docs.columns if c.lower() not in ("doc_id", "text", "score", "evidence")]
    docs = pick(docs, "doc_id", "text", *extra)
    sample = cut(examples_of(docs, labels, examples))  # 2 * examples rows at most
    known = pick(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).groupBy("toxic").agg(F.count("*").alias("n"))
    rows = {r["toxic"]: r["n"] for r in known.collect()}
    texts = docs.select("doc_id", "text")
    learned = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    learned = cut(learned)
    terms = vocabulary(learned)
    held = numbered_rows(learned, terms)
    told = class_information(held, len(terms))
    counts = document_frequencies(texts, terms)
    share = tuple(rows.get(y, 0) / max(1, sum(h[3] == y for h in held)) for y in (0, 1))
    index = BlockMaxIndex(held, np.log((counts[-1] + 1) / (counts[:-1] + 1)) * (told + PLAIN), share)
    del held
    shared = spark.sparkContext.broadcast((terms, index))  # the terms of 2 * examples rows

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("toxicity")
        terms, index = shared.value
        place = {i: j for j, i in enumerate(index.ids)}
        for batch in batches:
            for part in sliced(batch, 2, SLICE):
                bounds, number, counts = term_counts(part.column(2), terms)
                own = [(number[a:b], counts[a:b], place.get(i)) for a, b, i in zip(bounds, bounds[1:], part.column(0).to_pylist(), strict=False)]
                found = list(map(index.vote, index.nearest_of(own)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), part.column(1)], ["vote", "toxic"])

    index.calibrate([(r.vote, r.toxic) for r in learned.repartition("doc_id").mapInArrow(votes, "vote double, toxic int").collect()], share)
    curve = index.curve
    evidence_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("toxicity")
        terms, index = shared.value
        index.curve = curve
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            for part in sliced(batch, 1, SLICE):
                bounds, number, counts = term_counts(part.column(1), terms)
                keys, fresh = [], {}
                for a, b in zip(bounds, bounds[1:], strict=False):
                    key = xxhash.xxh3_128_digest(number[a:b].tobytes() + b"/" + counts[a:b].tobytes())
                    keys.append(key)
                    if key not in seen:
                        fresh[key] = (number[a:b], counts[a:b], None)
                if len(seen) + len(fresh) > SEEN:
                    seen = {k: seen[k] for k in keys if k in seen}
                seen.update(zip(fresh, map(index.score, index.nearest_of(list(fresh.values()))), strict=True))
                done = [seen[k] for k in keys]
                evidence = pa.array([[{"doc_id": i, "cosine": c, "toxic": y} for i, c, y in e] for _, e in done], evidence_type)
                columns = [part.column(0), pa.array([s for s, _ in done], pa.float64()), evidence, *[part.column(i) for i in range(1, part.num_columns)]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "evidence", "text", *extra])

    own = T.StructType.fromDDL(f"doc_id long, score double, evidence {EVIDENCE}")
    return docs.mapInArrow(run, T.StructType([*own.fields, *docs.schema.fields[1:]]))


def held_out(doc_id: str = "doc_id"):
    """Whether a document's labels are kept from learning: crc32 of its id as text, mod 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
