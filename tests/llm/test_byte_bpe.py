"""Byte-level encoding against the tiktoken library, whole and by chunks."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return byte_bpe.ByteBPE(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def chunks(bpe, text, size, overlap):
    for start in range(0, max(len(text) - overlap, 1), size):
        part = text[start : start + size + overlap]
        yield start, part, bpe.borders(start, part, start + len(part) == len(text))


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_op11_equals_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op11_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts) and {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pieces_of_small_chunks_give_the_ids_of_the_whole_text(own, library):
    rng = random.Random(5)
    for _ in range(1_500):
        letters = rng.choice(["ab 1'", "  \n\ta", "'sretvmld ab", "a", "  ", "é日1 .,!?'s", "abc. 's\n  "])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 150)))
        if rng.random() < 0.3:  # a run over many chunks
            text = text[:50] + rng.choice("a 1.") * rng.randint(30, 200) + text[50:]
        expected = library.encode_ordinary(text)
        assert ids_of(own.encode(text)) == expected
        size = rng.choice([4, 8, 16, 40])
        pieces = list(own.stitch(chunks(own, text, size, rng.choice([1, 2, size // 2]))))
        assert "".join(p for p, _ in pieces) == text
        assert [i for p, ends in pieces for i in ids_of(own.encode_words([p[a:b] for a, b in zip([0, *ends], ends)]))] == expected


def test_chunks_that_never_resynchronise_become_one_piece(own):
    text = "x" * 500 + " tail of the text"
    pieces = [p for p, _ in own.stitch(chunks(own, text, 40, 8))]
    assert pieces[0].startswith("x" * 500) and "".join(pieces) == text


def test_words_of_many_pieces_only_differ_in_speed(own, library):
    for word in ("ab" * 5_000, "x" * 3_000, "日本" * 2_000, "\x1c\x1d" * 500, " " * 5_000):
        assert ids_of(own.encode(word)) == library.encode_ordinary(word)


@pytest.mark.parametrize("chunk", [byte_bpe.CHUNK, 64])
def test_odd_rows(spark, odd_docs, no_docs, library, chunk):
    docs = odd_docs.unionByName(odd_docs.limit(0)).withColumn("key", F.lit("k")).withColumn("ids", F.lit(1))
    rows = byte_bpe.round_trip(docs, PATH, PATTERN, chunk, chunk // 2).collect()
    expected = sorted((str(r.doc_id), library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), ids_of(r.ids), bytes(r.decoded)) for r in rows) == expected
    assert byte_bpe.round_trip(no_docs, PATH, PATTERN, chunk, chunk // 2).count() == 0


def test_long_copies_are_a_row_each(spark, library):
    text = "It's a long text, 12 345 of them.\n\n  " * 200
    docs = spark.createDataFrame([(i, text) for i in (1, 2, 2, None)] + [(3, "é" * 2_000)], "doc_id long, text string")
    rows = byte_bpe.round_trip(docs, PATH, PATTERN, 256, 16).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "2", "3", "None"]
    assert all(ids_of(r.ids) == library.encode_ordinary(text if r.doc_id != 3 else "é" * 2_000) for r in rows)


def test_overlap_is_checked(no_docs):
    with pytest.raises(ValueError):
        byte_bpe.round_trip(no_docs, PATH, PATTERN, 10, 6)
