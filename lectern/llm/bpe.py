"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has one valid encoding, so one last token: of the tokens
that end there (found by a suffix-matching automaton) it is the one that is
compatible with the last token of what comes before it.  Following the stored
tokens back from the end of the word gives the exact ids.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import keeps, pick, ship, turn

#: Words that a Python worker remembers at most, twice over: when they are full they become the older ones, from which
#: those in use come back.  And pairs of tokens, all of which it forgets at once.
WORDS, PAIRS = 250_000, 300_000
#: Bytes of output that a worker gathers before it hands them on.
BATCH = 8 << 20
#: Control characters at which str.split() splits although they are not white space to the tokenizer.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(odd)) for b in range(256)]


def letters_and_numbers() -> tuple[str, str]:
    r"""\p{L} and \p{N} as ranges for a character class."""
    spans: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        own = spans.get(unicodedata.category(chr(c))[0])
        if own is None:
            continue
        if own and own[-1][1] == c - 1:
            own[-1][1] = c
        else:
            own.append([c, c])
    return tuple("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans[k]) for k in "LN")


class Encoder:
    """Encodes texts chunk by chunk, where a chunk lies between white space; remembers chunks.

    Splitting at white space is safe as no word of the vocabulary's pattern
    holds any.  Special tokens' strings are taken out of a text first.
    """

    def __init__(self, special: dict[str, int], words: int = WORDS) -> None:
        self.special, self.words = special, words
        self.specials = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.specials and "<" in text and self.specials.search(text):
            out, at = [], 0
            for m in self.specials.finditer(text):
                out += [self._encode(text[at : m.start()]), np.uint32(self.special[m.group()]).tobytes()]
                at = m.end()
            return b"".join([*out, self._encode(text[at:])])
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        if not text.isascii():
            # lower case goes character by character, so a final sigma is like any other
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        text = text.lower()
        # only these would be split at without being white space: they stay in their chunk
        chunks = re.split(r"[^\S\x1c-\x1f]+", text) if ODD_SPACE.search(text) else text.split()
        known = self.known
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            new = list({c for c in chunks if c not in known})
        if len(known) + len(new) > self.words:
            self.older, self.known = known, {}
            known, new = self.known, list(set(chunks))
        older = self.older
        own = {c: older[c] for c in new if c in older}
        new = [c for c in new if c not in own]
        own.update(zip(new, self.chunk_ids(new), strict=True))
        out = b"".join([own[c] if c in own else known[c] for c in chunks])
        known.update((c, x) for c, x in own.items() if len(c) <= 64)
        return out


class WordBPE(Encoder):
    """A vocabulary with word ends, lower case, white space dropped (tokenizers' JSON).

    ``encode`` gives the ids of a text as the tokenizers library does with
    add_special_tokens=False; special tokens' strings in a text are those
    tokens.  ``decode`` joins the tokens of ids with blanks: such files name no
    decoder.
    """

    def __init__(self, path: str, words: int = WORDS) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        super().__init__({t["content"]: t["id"] for t in spec["added_tokens"]}, words)
        ids = model["vocab"]
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.token_at = np.array([self.tokens.get(i, "") for i in range(max(self.tokens) + 1)], dtype=object)
        self.rank: dict[tuple[int, int], int] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if a in ids and b in ids and a + b in ids:
                self.rank.setdefault((ids[a], ids[b]), k)
        self.ids = {self._symbols(t): i for t, i in ids.items()}
        self.symbols = {i: s for s, i in self.ids.items()}
        self._spines: dict[int, tuple | None] = {}
        self.automaton = ahocorasick.Automaton()
        for s, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if self.spines(i):
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.bytes = byte_symbols()
        letters, numbers = letters_and_numbers()
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # a chunk holds no white space, so what is neither a letter nor a number needs no further exclusion
        split = split.replace(r"[^\s\p{L}\p{N}]", f"[^{letters}{numbers}]")
        split = split.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]")
        self.pattern = re.compile(split)
        self.pairs: dict[int, bool] = {}

    def _symbols(self, token: str) -> str:
        """One character a symbol; the last one of a word is moved to the private use area."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(0xE000 + ord(body[-1]))
        return token

    def spines(self, token: int) -> tuple | None:
        """(left, right) edges of the token's merge tree, or None if merging never makes it.

        An edge lists (token, birth, death): the ranks of the merges that make
        it and use it up.
        """
        if token in self._spines:
            return self._spines[token]
        s = self.symbols[token]
        found = (((token, -1, None),),) * 2 if len(s) == 1 else None
        for k in range(1, len(s)):
            a, b = self.ids.get(s[:k]), self.ids.get(s[k:])
            born = self.rank.get((a, b)) if a is not None and b is not None else None
            if born is not None and self.spines(a) and self.spines(b) and not self._clash(a, b, born):
                left, right = self.spines(a)[0], self.spines(b)[1]
                if born <= left[-1][1] or born <= right[-1][1]:
                    raise ValueError("merges must come after those that make their parts")
                found = tuple((*edge[:-1], (*edge[-1][:2], born), (token, born, None)) for edge in (left, right))
                break
        self._spines[token] = found
        return found

    def _clash(self, a: int, b: int, until: int | None = None) -> bool:
        """Whether, before rank ``until``, a merge across the border of a and b would come first."""
        rank = self.rank
        for x, x_born, x_dead in self.spines(a)[1]:
            for y, y_born, y_dead in self.spines(b)[0]:
                k = rank.get((x, y))
                # of equal ranks the merge further left comes first: the border lies right of a, left of b
                if k is not None and k > x_born and k > y_born and (x_dead is None or k < x_dead) and (y_dead is None or k <= y_dead) and (until is None or k < until):
                    return True
        return False

    def as_symbols(self, word: str) -> str:
        if not (word.isascii() and word.isprintable()):
            table = self.bytes
            word = "".join([table[b] for b in word.encode("utf-8")])
        return word[:-1] + chr(0xE000 + ord(word[-1]))

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word (lower case, no white space) by the program over its prefixes."""
        s = self.as_symbols(word)
        last: list[int] = [-1] * len(s)
        size = [0] * len(s)
        pairs = self.pairs
        for end, (token, n) in self.automaton.iter(s):
            if last[end] >= 0:
                continue
            before = end - n
            if before >= 0:
                left = last[before]
                if left < 0:
                    continue
                key = left << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = pairs[key] = not self._clash(left, token)
                if not fits:
                    continue
            last[end], size[end] = token, n
        out, at = [], len(s) - 1
        while at >= 0:
            if last[at] < 0:
                raise ValueError(f"no encoding of {word!r}")
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        known, older, words = self.known, self.older, self.pattern.findall
        own: dict[str, bytes] = {}

        def word(w: str) -> bytes:
            ids = known.get(w) or own.get(w) or older.get(w)
            if ids is None:
                ids = self.encode_word(w)
                ids = own[w] = pack(f"<{len(ids)}I", *ids)
            return ids

        # most chunks are a word, or a word and one mark, which need no pattern: isalpha() is \p{L} throughout
        return [word(c) if c.isalpha() else word(c[:-1]) + word(c[-1]) if c[:-1].isalpha() and c[-1] != "'" and not c[-1].isnumeric() else b"".join(map(word, words(c))) for c in chunks]

    def decode(self, ids: bytes) -> str:
        return " ".join(self.token_at[np.frombuffer(ids, dtype="<u4")].tolist())


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBPE:
    """One for each Python worker, which serves many tasks."""
    return WordBPE(path)


keeps("bpe", vocabulary.cache_clear)


def _mapped(docs: DataFrame, path: str, decoded: bool) -> DataFrame:
    fields = [pa.field("doc_id", pa.int64()), pa.field("ids", pa.binary())] + [pa.field("decoded", pa.string())] * decoded
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("bpe")
        bpe = vocabulary(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows: list[list] = [[], [], []]
            held = 0
            for i in range(len(texts)):
                ids = bpe.encode(texts[i].as_py() or "")
                rows[0].append(keys[i].as_py())
                rows[1].append(ids)
                if decoded:
                    rows[2].append(bpe.decode(ids))
                held += len(ids) * (3 if decoded else 1)
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, fields)], schema=schema)
                    rows, held = [[], [], []], 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, fields)], schema=schema)

    out = [T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * decoded
    ship(docs.sparkSession)
    return pick(docs, "doc_id", "text").mapInArrow(run, T.StructType(out))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) of every row of doc_id, text.

    A null text is an empty one and has no ids.  Rows are independent, so
    repeated ids, copies and ties need no rule; other columns are ignored.
    """
    return _mapped(docs, path, False)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``encode``, with ``decoded``: the text that the ids decode to."""
    return _mapped(docs, path, True)
