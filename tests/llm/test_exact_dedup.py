import hashlib
from collections import defaultdict

from lectern.llm import exact_dedup, queries


def check(rows, docs):
    groups = defaultdict(list)
    for doc, text in docs:
        groups[text or ""].append(doc)
    text_of = dict(docs)
    assert len(rows) == len(docs)
    for r in rows:
        own = groups[text_of[r.doc_id] or ""]
        keep = max((x for x in own if x is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(own), r.doc_id == keep)


def test_op5(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op5_exact_dedup(spark, sf_dir).collect()
    check(rows, docs)
    text_of = dict(docs)
    assert all(r.text_sha256 == hashlib.sha256((text_of[r.doc_id] or "").encode()).hexdigest() for r in rows)


def test_odd_rows_by_either_join(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for bound in (0, 2, 1_000):
        check(exact_dedup.exact_dedup(odd_docs, prefix=4, broadcast_keys=bound).collect(), docs)
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_same_length_and_prefix_do_not_make_twins(spark):
    docs = spark.createDataFrame([(1, "a" * 200 + "x"), (2, "a" * 200 + "y"), (3, "a" * 200 + "x")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()} == {(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)}
