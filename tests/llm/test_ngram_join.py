import random
import re
from itertools import combinations

from lectern.llm import ngram_join, queries


def plain(docs, width, pct):
    sets = {}
    for doc, text in docs:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        own = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
        sets.setdefault(doc, []).append(own)
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in combinations(sets, 2):
        if any(s and t and 100 * len(s & t) >= pct * len(s | t) for s in sets[a] for t in sets[b]):
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {d: (len(sets[d][0]), find(d)) for d in sets}


def result(df):
    rows = df.collect()
    return rows, {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_op1(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows, got = result(queries.op1_ngram_jaccard_join(spark, sf_dir))
    assert len(rows) == len(docs) and got == plain(docs, 3, 90)


def test_chains_of_edits_shared_passages_and_copies(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    docs = []
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([3, 12, 40, 90]))
        docs.append(base)
        for _ in range(rng.randint(0, 9)):
            base = list(base)  # each one an edit of the last: ends of a chain may not link
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = rng.choice(words)
            docs.append(base if rng.random() < 0.8 else base[: int(len(base) * 0.95)])
    docs += [passage + rng.choices(words, k=k) for k in (3, 4, 5, 6, 30, 40)] * 2
    rng.shuffle(docs)
    rows = [(i, " ".join(x).upper() if i % 7 == 0 else "  ".join(x)) for i, x in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for width, pct in ((3, 90), (5, 80), (2, 60)):
        want = plain(rows, width, pct)
        for bound in (0, 10_000):
            got = result(ngram_join.ngram_jaccard_join(frame, width, pct, broadcast_ids=bound))[1]
            assert got == want, (width, pct)
    assert len({c for _, c in plain(rows, 3, 90).values()}) < len(rows) - 20


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None]
    rows, got = result(ngram_join.ngram_jaccard_join(odd_docs, 3, 90))
    assert len(rows) == len(docs) + 1
    assert {d: x for d, x in got.items() if d is not None} == plain(docs, 3, 90)
    assert got[None] == (1, None)
    assert ngram_join.ngram_jaccard_join(no_docs).count() == 0


def test_every_link_of_near_copies(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for size in (70, 6, 2):
        base = rng.choices(words, k=80)
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append(own)
    docs += docs[:9] + [rng.choices(words, k=50)]
    rows = [(i, " ".join(x)) for i, x in enumerate(docs)] + [(3, " ".join(docs[75])), (200, ""), (None, " ".join(docs[0]))]
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for _, t in rows]
    links = {(i, j): len(s & t) for i, s in enumerate(sets) for j, t in enumerate(sets) if i < j and s and t and None not in (rows[i][0], rows[j][0]) and 100 * len(s & t) >= 80 * len(s | t)}
    want = sorted((str(d), sum(i in p for p in links)) for i, (d, _) in enumerate(rows))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    different = {(frozenset(sets[i]), frozenset(sets[j])) for i, j in links if sets[i] != sets[j]}
    different = {frozenset(p) for p in different}
    for chunk in (256, 16):
        got = ngram_join.ngram_jaccard_join(frame, 3, 80, chunk=chunk).collect()
        assert sorted((str(r.doc_id), r.n_links) for r in got) == want
        pairs, members = ngram_join.ngram_pairs(frame, 3, 80, chunk=chunk)
        pairs, members = pairs.collect(), members.collect()
        assert len(pairs) == len({frozenset((r.a_class, r.b_class)) for r in pairs}) == len(different) > 200
        assert sorted(r.overlap for r in pairs) == sorted(len(frozenset.intersection(*p)) for p in different)
        assert len(members) == len(rows) - 1


def test_rows_that_share_an_id_are_not_joined(spark):
    a, b = [f"a{i}" for i in range(202)], [f"b{i}" for i in range(202)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, " ".join(a[:101] + b[:101])), (7, " ".join(b + ["c"]))]
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == [(5, 0, 5), (5, 1, 5), (6, 0, 6), (7, 1, 5)]


def test_heads_keep_the_rows_of_different_texts(spark):
    """Against a plain count, whatever batches the rows come in."""
    rng = random.Random(4)
    rows = [(rng.randint(0, 60), rng.choice((1, 1, 1, rng.randint(2, 9))), 9, True) for _ in range(3_000)] + [(99, 7, 9, True)] * 500
    frame = spark.createDataFrame(rows, "g long, node long, n long, core boolean")
    nodes = {}
    for g, node, *_ in rows:
        nodes.setdefault(g, set()).add(node)
    want = sorted((g, x) for g, own in nodes.items() if len(own) > 1 for x in own)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sorted((r.g, r.node) for r in ngram_join.shared_only(frame).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
