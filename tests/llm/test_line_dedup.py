import random
from collections import defaultdict

from pyspark.sql import functions as F

from lectern.llm import line_dedup as L
from lectern.llm import queries


def test_passages_in_and_across_lines(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 6) + str(rng.randint(0, 9)) for _ in range(n)) + "."
    passage = " ".join(say(11) for _ in range(5))
    short = "A b c."
    docs = [(0, f"{say(12)} {passage} {say(9)}\n{short}"), (1, f"{short}\n{say(30)}"), (2, f"{say(20)}\n{passage}\n{say(20)}"), (3, say(40)), (4, passage), (5, None), (6, ""), (7, f"{passage} {passage}")]
    rows = {r.doc_id: r for r in L.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [rows[i].text for i in (0, 1, 3, 5, 6)] == [docs[i][1] for i in (0, 1, 3, 5, 6)]
    assert passage[:40] not in rows[2].text and rows[2].text.startswith(docs[2][1][:30]) and rows[4].text == ""
    assert rows[0].removed == [] and len(rows[2].removed) == 5


def test_odd_rows(spark, odd_docs, no_docs):
    rows = L.line_dedup(odd_docs.withColumn("matches", F.lit("m"))).collect()
    assert all(r.matches == "m" and r.h == "h" for r in rows)
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert len(rows) == len(docs)
    assert {(r.doc_id, r.text) for r in rows} == set(docs)
    assert L.line_dedup(no_docs).count() == 0


def test_patience_by_hand():
    assert L.blocks([(0, 5), (1, 6), (2, 7), (9, 1)]) == [[0, 1, 2]]
    assert L.blocks([(0, 0), (1, 1), (3, 1), (4, 2)]) in ([[0, 1], [4]], [[0], [3, 4]])
    assert L.blocks([]) == []


def test_lines_join_to_the_text():
    for text in ["", "\n\n", "a. b! c?\nd", " . . ", "x.y\n z"]:
        assert "".join(L.lines_of(text)) == text


def every_block(docs, words=L.BLOCK_WORDS):
    """Each document against all earlier ones: lines of all common stretches that have the words."""
    held, places, out = [], defaultdict(list), {}
    for doc, text in sorted(x for x in docs if x[1] is not None):
        own = [x.strip("\t\n\x0b\x0c\r ") for x in L.lines_of(text)]
        gone = set()
        for i, line in enumerate(own):
            for k, j in places[line]:
                there = held[k]
                if i and j and own[i - 1] == there[j - 1]:
                    continue
                n = 0
                while i + n < len(own) and j + n < len(there) and own[i + n] == there[j + n]:
                    n += 1
                if sum(len(x.split()) for x in own[i : i + n]) >= words:
                    gone.update(range(i, i + n))
        for j, line in enumerate(own):
            places[line].append((len(held), j))
        held.append(own)
        out[doc] = sorted(gone)
    return out


def check_all(rows, docs):
    want, text = every_block(docs), dict(docs)
    assert len(rows) == len(docs)
    for r in rows:
        own = L.lines_of(text[r.doc_id] or "")
        assert list(r.removed) == want.get(r.doc_id, []), r.doc_id
        assert (r.text or "") == "".join(x for i, x in enumerate(own) if i not in set(r.removed))


def check_blocks(rows, docs):
    """Each block stands in the earlier document that it names, and the blocks are what goes."""
    lines = {d: [x.strip("\t\n\x0b\x0c\r ") for x in L.lines_of(t or "")] for d, t in docs}
    for r in rows:
        for b in r.blocks:
            assert b.doc_id < r.doc_id
            assert lines[r.doc_id][b.start : b.start + b.lines] == lines[b.doc_id][b.at : b.at + b.lines] != []
        assert sorted({i for b in r.blocks for i in range(b.start, b.start + b.lines)}) == list(r.removed)


def test_op7_over_the_table_against_every_earlier_document(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = L.line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    check_all(rows, docs)
    check_blocks(rows, docs)
    removed = {r.doc_id: len(r.removed) for r in rows}
    got = queries.op7_line_dedup(spark, sf_dir).collect()
    assert {r.doc_id: r.n_removed for r in got} == removed and len(got) == len(docs) and sum(removed.values()) > 0


def test_rows_that_share_an_id(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n)) + "."
    passage, own = " ".join(say(9) for _ in range(5)), " ".join(say(9) for _ in range(6))
    docs = [(1, passage), (5, say(3) + " " + passage), (5, "short"), (5, own), (5, passage)]
    rows = L.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.text for r in rows) == sorted([passage, docs[1][1].split(".")[0] + ".", "short", own, ""])


def test_patience_finds_common_runs():
    """Against all increasing runs: without unique places the longest one, with them never less than the anchors'."""
    rng = random.Random(2)
    for _ in range(300):
        pairs = sorted({(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(rng.randint(0, 9))})
        got = L.patience(pairs)
        assert set(got) <= set(pairs) and all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))
        best: dict = {}
        for p in pairs:
            best[p] = 1 + max((n for q, n in best.items() if q[0] < p[0] and q[1] < p[1]), default=0)
        assert len(L.increasing(pairs)) == max(best.values(), default=0)
        assert bool(got) == bool(pairs)
    twice = [(i, j) for i in range(8) for j in range(8) if i % 4 == j % 4]
    assert len(L.patience(twice)) == 8
    assert L.patience([(0, 0), (1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_short_lines_with_other_first_owners(spark):
    rng = random.Random(6)
    lines = [f"l{i} is short." if i % 5 else "" for i in range(40)]
    docs = [(i, "\n".join([*rng.sample(lines, 12), f"own {i}"])) for i in range(30)]
    docs += [(40, "\n".join(lines)), (41, "\n".join(lines)), (42, "\n".join(lines[20:] + lines[:20]))]
    rows = L.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_all(rows, docs)
    assert {r.text for r in rows if r.doc_id > 40} == {""}


def test_passages_held_twice(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 6) + str(rng.randint(0, 9)) for _ in range(n)) + "."
    passage = " ".join(say(4) for _ in range(8))
    docs = [(0, f"{say(12)} {passage}"), (7, f"{passage} {passage}"), (8, f"{passage} {say(12)} {passage}"), (9, f"{passage} {passage} {passage}\n{say(20)}")]
    rows = {r.doc_id: r for r in L.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    check_all(list(rows.values()), docs)
    assert rows[7].text == "" and rows[7].removed == list(range(16))
    assert len(rows[8].removed) == 16 and len(rows[9].removed) == 24


def test_alignments_cover_all_pairs_by_increasing_runs():
    rng = random.Random(12)
    for trial in range(200):
        n = rng.choice([0, 1, 5, 30])
        pairs = {(rng.randint(0, n), rng.randint(0, n)) for _ in range(3 * n)}
        if trial % 10 == 0:
            pairs = {(i, 40 - i) for i in range(40)}  # all cross each other
        runs = list(L.alignments(list(pairs)))
        assert {p for run in runs for p in run} == pairs
        assert all(a < c and b < d for run in runs for (a, b), (c, d) in zip(run, run[1:]))
        assert len(runs) <= max(L.AGAIN, 1) + 41


def test_nothing_goes_but_what_the_diff_aligns(monkeypatch):
    lines = [f"line {i} has five words.\n" for i in range(12)]
    own = [L.plain(x) for x in lines]
    _, start, _, h1, _ = L.windows_of([own], 10)
    docs, places = L.np.zeros(len(h1), int), start
    assert L.cut_out(lines, h1, docs, places)[0] == list(range(12))
    assert L.cut_out(lines, h1, docs, places[::-1].copy())[0] == list(range(12))
    monkeypatch.setattr(L, "patience", lambda pairs: [])
    assert L.cut_out(lines, h1, docs, places) == ([], [])
