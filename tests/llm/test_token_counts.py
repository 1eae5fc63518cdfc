import tempfile

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import queries
from lectern.llm import token_counts as K


def totals(rollup):
    return {(r.source, r.lang, r.version): (r.docs, r.tokens, r.chars) for r in rollup.totals().collect()}


def test_op6_equals_a_recount(spark, sf_dir):
    """Every text counted by the tokenizers library under both vocabularies."""
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens, r.chars) for r in queries.op6_token_counts(spark, sf_dir).collect()}
    words, pieces = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    pieces.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    kept, want = {}, {}
    for r in docs:
        kept[r.text or ""] = max(r.doc_id, kept.get(r.text or "", r.doc_id))
    for r in docs:
        for library, version in ((words, "word-bpe-49k"), (pieces, "byte-bpe-50k")):
            if version == "word-bpe-49k" or kept[r.text or ""] == r.doc_id:
                n, tokens, chars = want.get((r.source, r.lang, version), (0, 0, 0))
                want[r.source, r.lang, version] = n + 1, tokens + len(library.encode(r.text or "", add_special_tokens=False).ids), chars + len(r.text or "")
    assert got == want and len(got) > 2


def test_compaction_changes_no_total(spark, odd_docs):
    rollup = K.Rollup(spark, tempfile.mkdtemp() + "/counts")
    counts = K.inserts(K.counted(odd_docs, "v1", F.length("text")))
    rollup.compact()
    assert totals(rollup) == {}
    for k, name in enumerate("abcd"):
        assert rollup.commit(name, counts)
        before = totals(rollup)
        rollup.compact()
        assert totals(rollup) == before and sum(x[0] for x in before.values()) == (k + 1) * odd_docs.count()
        assert not rollup.commit(name, counts) and not rollup.commit("a", counts)
    assert totals(rollup) == before


def test_of_two_writers_one_counts(spark, odd_docs):
    path = tempfile.mkdtemp() + "/counts"
    one, two = K.Rollup(spark, path), K.Rollup(spark, path)
    counts = K.inserts(K.counted(odd_docs, "v1", F.length("text")))
    two.committed = lambda batch: False  # looked before the other was done
    assert one.commit("a", counts) and not two.commit("a", counts)
    assert sum(x[0] for x in totals(one).values()) == odd_docs.count()


def test_rows_are_tokenized_one_by_one(spark, odd_docs, no_docs):
    paths = [public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken")]
    rows = K.tokenized(odd_docs, paths, public_tokenizers.PATTERN).collect()
    assert len(rows) == odd_docs.count() and all((r.tokens == [0, 0]) == (r.chars == 0) or r.chars for r in rows)
    assert K.tokenized(no_docs, paths, public_tokenizers.PATTERN).count() == 0
    copies = K.copies_of(spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (2, "y"), (None, "y"), (None, "z")], "doc_id long, text_key string"))
    assert sorted(map(str, copies.collect())) == sorted(map(str, spark.createDataFrame([("x", 1), ("y", None)], "text_key string, doc_id long").collect()))


def test_batches_count_once(spark, odd_docs, no_docs):
    rollup = K.Rollup(spark, tempfile.mkdtemp() + "/counts")
    assert totals(rollup) == {}
    words = F.size(F.filter(F.split("text", " "), lambda x: x != ""))
    counts = K.counted(odd_docs, "v1", words)
    assert rollup.commit("a", K.inserts(counts)) and not rollup.commit("a", K.inserts(counts))
    once = totals(rollup)
    assert sum(x[0] for x in once.values()) == odd_docs.count() and (None, None, "v1") in once
    rollup.commit("b", K.revisions(counts, K.counted(odd_docs, "v2", F.length("text"))))
    assert {k[2] for k in totals(rollup)} == {"v2"}
    rollup.commit("c", K.deletes(K.counted(odd_docs, "v2", F.length("text"))))
    rollup.commit("empty", K.inserts(K.counted(no_docs, "v1", words)))
    assert totals(rollup) == {}
    with pytest.raises(ValueError):
        rollup.commit("../x", counts)


def test_a_broken_batch_is_written_over(spark, odd_docs):
    path = tempfile.mkdtemp() + "/counts"
    rollup = K.Rollup(spark, path)
    counts = K.inserts(K.counted(odd_docs, "v1", F.length("text")))
    counts.groupBy(*K.GROUP).agg(*[F.sum(c).alias(c) for c in K.SUMS]).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch=a")
    assert totals(rollup) == {}
    rollup.commit("a", counts)
    assert sum(x[0] for x in totals(rollup).values()) == odd_docs.count()


def test_a_batch_between_listing_and_sums_counts_once(spark, odd_docs):
    path = tempfile.mkdtemp() + "/counts"
    one, other = K.Rollup(spark, path), K.Rollup(spark, path)
    counts = K.inserts(K.counted(odd_docs, "v1", F.length("text")))
    one.commit("a", counts)
    listed = one._listing

    def late():
        found = listed()
        other.commit("b", counts)
        return found

    one._listing = late
    one.compact()
    del one._listing
    docs = lambda: sum(x[0] for x in totals(one).values())
    assert docs() == 2 * odd_docs.count() and not one.commit("b", counts)
    one.compact()
    assert docs() == 2 * odd_docs.count() and not one.commit("a", counts) and not one.commit("b", counts)
    one.compact()
    assert docs() == 2 * odd_docs.count()
