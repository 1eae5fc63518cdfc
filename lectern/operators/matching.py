"""Terms and patterns found in texts by one pass of an automaton, in Arrow batches.

Terms are literal, so the automaton's hits are theirs but for the borders of
words.  A pattern needs some literal to match at all; the automaton tells which
patterns a text may match, and those alone are tried, by one engine that gives
the number of matches and their first places together.  What a plan holds does
not grow with the number of terms or patterns: they are data of the function.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache
from re import _constants as C
from re import _parser as parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ship

#: Letters of a literal that is worth looking for; shorter ones serve if they are marks.
LEAST_LETTERS = 2
DEFAULT = re.IGNORECASE | re.DOTALL
#: As many places as there are.
ALL = sys.maxsize


def fold_character(c: str) -> str:
    """The character that stands for all that differ in case alone, one for one, so that places stay."""
    up = c.upper()
    low = (up if len(up) == 1 else c).lower()
    return low[0]


@lru_cache(maxsize=1)
def _folds() -> dict[int, str]:
    return {c: f for c in range(128, sys.maxunicode + 1) if (f := fold_character(chr(c))) != chr(c)}


def fold(text: str) -> str:
    text = text if text.isascii() else text.translate(_folds())
    low = text.lower()
    return low if len(low) == len(text) else "".join(map(fold_character, text))


def automaton(entries: Iterable[tuple[str, object]]) -> ahocorasick.Automaton:
    found: dict[str, list] = {}
    for literal, value in entries:
        found.setdefault(literal, []).append(value)
    out = ahocorasick.Automaton()
    for literal, values in found.items():
        out.add_word(literal, (len(literal), tuple(values)))
    if found:
        out.make_automaton()
    return out


# --- terms ------------------------------------------------------------------------------------------------------


class Terms:
    """Counts of whole terms, whatever the case; a term's own occurrences don't overlap, those of different terms may."""

    def __init__(self, terms: list[tuple[str, str]]) -> None:
        self.terms = terms
        self.automaton = automaton((fold(t), k) for k, (_, t) in enumerate(terms) if t)

    def counts(self, text: str) -> dict[int, int]:
        """Occurrences by place in the list, in its order."""
        if not len(self.automaton):
            return {}
        folded, last = fold(text), len(text)
        found: dict[tuple[int, ...], list[int]] = {}
        for end, (n, own) in self.automaton.iter(folded):
            start = end - n + 1
            if (start and is_word(text[start - 1])) or (end + 1 < last and is_word(text[end + 1])):
                continue
            seen = found.get(own)
            if seen is None:
                found[own] = [1, end]
            elif start > seen[1]:
                seen[0] += 1
                seen[1] = end
        return dict(sorted((k, n) for own, (n, _) in found.items() for k in own))


#: Terms are data of a function that every task holds, so there may be no more than fit into one.
MOST_TERMS = 1_000_000


def load_terms(table: DataFrame) -> list[tuple[str, str]]:
    """The (entity_type, entity) pairs of a dictionary table, each once, in order; blank ones are left out."""
    rows = table.select("entity_type", "entity").where("entity <> ''").distinct().limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return sorted((r.entity_type, r.entity) for r in rows)


def is_word(c: str) -> bool:
    return c == "_" or c.isalnum()


def term_mentions(notes: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """note_id, source, entity_type, entity, count of the (type, term) pairs that occur in ``text``, one pass a text.

    A null or empty text has none, nor has an empty term; a pair that is given
    twice counts twice.
    """
    ship(notes.sparkSession)
    schema = pa.schema([("note_id", pa.string()), ("source", pa.string()), ("entity_type", pa.string()), ("entity", pa.string()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Terms(terms)
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                if text:
                    note, source = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    rows += [(note, source, *terms[k], n) for k, n in own.counts(text).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return notes.select("note_id", "source", "text").mapInArrow(run, "note_id string, source string, entity_type string, entity string, count long")


# --- patterns ---------------------------------------------------------------------------------------------------


def required(pattern: str, flags: int = DEFAULT) -> frozenset[str] | None:
    """Folded literals of which every match holds one, or None where nothing is known.

    Only ASCII literals count: others may differ from what they match by more
    than case.
    """
    return _needs(parser.parse(pattern, flags))


def _worth(literal: str) -> bool:
    return len(literal) >= LEAST_LETTERS or (len(literal) == 1 and not literal.isalnum() and not literal.isspace())


def _needs(items: Iterable[tuple]) -> frozenset[str] | None:
    """The best of what the items of a sequence need: the set whose shortest literal is longest."""
    options: list[frozenset[str]] = []
    run = ""

    def closed(literal: str) -> None:
        if _worth(literal):
            options.append(frozenset([literal]))

    for op, args in items:
        if op is C.LITERAL and args < 128:
            run += chr(args).lower()
            continue
        closed(run)
        run, own = "", None
        if op is C.SUBPATTERN:
            own = _needs(args[-1])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and args[0] > 0:
            own = _needs(args[2])
        elif op is C.ATOMIC_GROUP:
            own = _needs(args)
        elif op is C.BRANCH:
            each = [_needs(branch) for branch in args[1]]
            own = frozenset().union(*each) if all(e is not None for e in each) else None
        if own:
            options.append(own)
    closed(run)
    return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=None)


class Patterns:
    """Groups of patterns; each pattern's matches are counted apart, and the first places kept by group."""

    def __init__(self, groups: list[tuple[str, ...]], flags: int = DEFAULT) -> None:
        self.compiled = [[re.compile(p, flags) for p in group] for group in groups]
        self.sizes = [len(g) for g in groups]
        needs = {(g, p): required(text, flags) for g, group in enumerate(groups) for p, text in enumerate(group)}
        self.always = [at for at, own in needs.items() if own is None]
        self.automaton = automaton((literal, at) for at, own in needs.items() if own is not None for literal in own)

    def candidates(self, text: str) -> list[tuple[int, int]]:
        """(group, pattern) of those that may match, in order."""
        if not len(self.automaton):
            return sorted(self.always)
        found = {hit[1] for _, hit in self.automaton.iter(fold(text))}
        return sorted({at for own in found for at in own}.union(self.always))

    def matches(self, text: str, most: int, once: bool = False) -> dict[int, tuple[list[int], list[tuple[int, int, str]]]]:
        """For each group that matches: how often each of its patterns does, and the first ``most`` (start, end, matched).

        Places go by pattern, then by where they start; 0-based, end exclusive.
        With ``once`` a group is left at its first match.
        """
        out: dict[int, tuple[list[int], list[tuple[int, int, str]]]] = {}
        for group, at in self.candidates(text):
            if once and group in out:
                continue
            count, places = 0, out[group][1] if group in out else []
            for m in self.compiled[group][at].finditer(text):
                count += 1
                if len(places) < most:
                    places.append((m.start(), m.end(), m.group()))
                if once:
                    break
            if count:
                out.setdefault(group, ([0] * self.sizes[group], places))[0][at] = count
        return out


FOUND = "array<struct<group:int,hits:array<bigint>,places:array<struct<start:int,end:int,matched:string>>>>"
_PLACE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("matched", pa.string())])
_FOUND = pa.list_(pa.struct([("group", pa.int32()), ("hits", pa.list_(pa.int64())), ("places", pa.list_(_PLACE))]))


def matched(text: Column, groups: list[tuple[str, ...]], most: int = 0, flags: int = DEFAULT, once: bool = False) -> Column:
    """The groups of patterns that match a text, each with the hits of its patterns and its first ``most`` places.

    What comes back grows with what matches, not with the number of patterns.
    A null text matches nothing.
    """
    groups = [tuple(g) for g in groups]

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        own, out = _patterns(tuple(groups), int(flags)), []
        for t in texts:
            t = t.as_py()
            got = own.matches(t, most, once) if t is not None else {}
            out.append([{"group": g, "hits": hits, "places": [{"start": a, "end": b, "matched": m} for a, b, m in places]} for g, (hits, places) in sorted(got.items())])
        return pa.array(out, _FOUND)

    return found(text)


@lru_cache(maxsize=16)
def _patterns(groups: tuple[tuple[str, ...], ...], flags: int) -> Patterns:
    """Compiled once a worker, not once a batch."""
    return Patterns(list(groups), flags)
