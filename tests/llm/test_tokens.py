"""Encoding, packing and sharding against the tokenizers library and plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import bpe, packing, queries, sharding

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_op3_equals_the_library(spark, sf_dir, library):
    texts = texts_of(spark, sf_dir)
    rows = queries.op3_bpe(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_odd_texts(spark, odd_docs, no_docs, library):
    rows = bpe.round_trip(odd_docs, PATH).collect()
    assert len(rows) == odd_docs.count()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(no_docs, PATH).count() == 0


def test_program_over_prefixes_equals_the_library_on_random_words(library):
    own, rng = bpe.WordBPE(PATH), random.Random(3)
    words = ["".join(rng.choice("aaaeinrsthéö'!-0") for _ in range(rng.randint(1, 30))) for _ in range(3_000)]
    for w, ref in zip(words, library.encode_batch(words, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(w), "<u4").tolist() == ref.ids


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if capacity - sum(b) >= n]
        (min(fit, key=lambda b: capacity - sum(b)) if fit else bins.append([]) or bins[-1]).append(n)
    return sorted(map(sum, bins))


def test_runs_equal_piecewise_best_fit():
    rng = random.Random(1)
    for trial in range(60):
        capacity = rng.choice([1, 7, 16, 50])
        lengths = [min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(rng.randint(0, 120))]
        bins = defaultdict(list)
        seen = Counter()
        for run in packing.best_fit(Counter(lengths), capacity):
            for rank in range(run.first, run.last):
                k = rank - run.first
                bins[run.bin + k // run.each].append((run.at + k % run.each * run.length, run.length))
                seen[run.length] += 1
        assert seen == Counter(lengths)
        for b in bins.values():
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            assert at <= capacity
        assert sorted(sum(n for _, n in b) for b in bins.values()) == plain_best_fit(lengths, capacity)


def check_packing(rows, texts, library, capacity):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * capacity and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert sum(r.length for r in own) == len(ids)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(sum(n for _, n in b) for b in bins.values()) == plain_best_fit([r.length for r in rows], capacity)


def test_op10_packs_every_document(spark, sf_dir, library):
    check_packing(queries.op10_best_fit_packing(spark, sf_dir).collect(), texts_of(spark, sf_dir), library, 4_096)


def test_pack_odd_texts(spark, odd_docs, no_docs, library):
    rows = packing.pack(odd_docs.dropDuplicates(["doc_id"]), PATH, 64).collect()
    check_packing(rows, {r.doc_id: r.text for r in odd_docs.collect()}, library, 64)
    assert len(packing.pack(odd_docs, PATH, 64).where("doc_id = 4").collect()) == 2
    assert packing.pack(no_docs, PATH).count() == 0


def check_shards(rows, texts, shards):
    groups, total, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert r.size == len(text) + 1 and r.text_crc32 == zlib.crc32(text)
        groups[text].add(r.shard)
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(x) == 1 for x in groups.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return total


def test_op4_shards_are_even(spark, sf_dir):
    rows = queries.op4_sharding(spark, sf_dir).collect()
    texts = texts_of(spark, sf_dir)
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"}
    total = check_shards(rows, texts, 8)
    assert set(total) == set(range(8)) and max(total.values()) - min(total.values()) < 0.001 * sum(total.values())


def test_shard_odd_texts(spark, odd_docs, no_docs):
    rows = sharding.shard(odd_docs, 3).collect()
    assert len(rows) == odd_docs.count()
    check_shards(rows, {r.doc_id: r.text for r in odd_docs.collect()}, 3)
    assert sharding.shard(no_docs, 3).count() == 0


def test_levels_of_differencing_stay_even(spark):
    rng = random.Random(5)
    weights = [rng.randint(1, 1_000) for _ in range(6_000)] + [400_000]
    items = spark.createDataFrame([(f"i{k}", w) for k, w in enumerate(weights)], "item string, weight long")
    part = {r.item: r.part for r in sharding.partition_items(items, 4, leaf=512, whole=64).collect()}
    assert len(part) == len(weights)
    total = Counter()
    for k, w in enumerate(weights):
        total[part[f"i{k}"]] += w
    assert max(total.values()) - min(total.values()) <= 20_000


def test_differencing_by_hand():
    assert sharding.differencing([], 2) == []
    parts = sharding.differencing([8, 7, 6, 5, 4], 2)
    sums = Counter()
    for w, p in zip([8, 7, 6, 5, 4], parts, strict=True):
        sums[p] += w
    assert sorted(sums.values()) == [14, 16]


def test_more_items_than_a_thousand_leaves_hold(spark):
    items = spark.range(80_000).selectExpr("cast(id as string) AS item", "id % 997 + 1 AS weight")
    parts = sharding.partition_items(items, 2, leaf=64, whole=8).join(items, "item")
    seen = {r.part: (r.n, r.total) for r in parts.groupBy("part").agg({"item": "count", "weight": "sum"}).toDF("part", "n", "total").collect()}
    assert sum(n for n, _ in seen.values()) == 80_000 and set(seen) == {0, 1}
    assert abs(seen[0][1] - seen[1][1]) < 0.001 * (seen[0][1] + seen[1][1])


def test_shards_are_written_row_by_row(spark, odd_docs, tmp_path):
    from pyspark.sql import functions as F

    sharding.write_shards(odd_docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda df: sorted(map(str, df.select("doc_id", "text", "lang", "kept", "Score", "size").collect()))
    assert key(back) == key(odd_docs)
    slots = back.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in slots)
    placed = {(r.doc_id, r.shard) for r in sharding.shard(odd_docs, 3).collect()}
    assert {(r.doc_id, r.shard) for r in back.select("doc_id", F.col("shard").cast("int").alias("shard")).collect()} == placed


def test_a_word_of_megabytes_takes_seconds(library):
    import time

    rng = random.Random(3)
    word = "".join(rng.choice("abcdefghijklmnop") for _ in range(2_000_000))
    start = time.time()
    long = packing.word_encoder(PATH).encode(word)
    assert time.time() - start < 60
    assert long == bpe.vocabulary(PATH).encode(word)
    short = word[:20_000]
    assert np.frombuffer(packing.word_encoder(PATH).encode(short), "<u4").tolist() == library.encode(short, add_special_tokens=False).ids


def test_numbers_have_no_gaps_whatever_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET", 1)
    rows = spark.range(5_000).selectExpr("id", "id % 3 AS k")
    got = sharding.numbered(rows, "k", ["id"], "at", 5_000).collect()
    for k in range(3):
        own = sorted(r["at"] for r in got if r.k == k)
        assert own == list(range(len(own)))
