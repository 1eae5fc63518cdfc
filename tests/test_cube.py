"""The tables over populations from one cube, against counting notes in plain Python."""

import random
from itertools import combinations

import pytest

from lectern.operators import derived, populations


@pytest.fixture(scope="module")
def notes(spark):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        text = f"t{rng.randint(0, 40)}"
        rng2 = random.Random(text)  # notes of one text carry the same codes
        own = [("typology", c) for c in "xyz" if rng2.random() < 0.4] + [("indicator", c) for c in "xw" if rng2.random() < 0.3]
        rows.append((f"n{i:03}", rng.choice(["s1", "s1", "s1", "s2", "", None]), text if i % 9 else "", own))
    # a source whose notes all repeat texts of an earlier one, and one note with a code of its own
    rows += [("n900", "zz", "t1", [("typology", c) for c in "xyz" if False]), ("n901", "s3", "only", [("typology", "q"), ("typology", "x")])]
    seen = {r[2]: r[3] for r in rows[:120] if r[2]}
    rows[-2] = ("n900", "zz", "t1", seen.get("t1", []))
    df = spark.createDataFrame([(n, s, t, [(f, c, f"label {c}") for f, c in own]) for n, s, t, own in rows], "note_id string, source string, combined_text_sha256 string, carried array<struct<family:string,code:string,label:string>>")
    return rows, df


def members_of(rows):
    named = [(n, (s or "").strip() or "(no_source)", t or f"note:{n}", {c for f, c in own if f == "typology"}, {c for f, c in own if f == "indicator"}) for n, s, t, own in rows]
    firsts = {min((s, n) for n, s, t, *_ in named if t == text) for text in {x[2] for x in named}}
    return {"full_corpus": named, "text_unique": [x for x in named if (x[1], x[0]) in firsts]}


def test_pairs_by_source_without_it_and_across_families(notes):
    rows, df = notes
    table = derived.cube(populations.marked(df))
    plain, sources = members_of(rows), sorted({x[1] for x in members_of(rows)["full_corpus"]})
    codes = sorted({c for x in plain["full_corpus"] for c in x[3]})

    def counts(own, a, b, left=3, right=3):
        return len(own), sum(a in x[left] for x in own), sum(b in x[right] for x in own), sum(a in x[left] and b in x[right] for x in own)

    told = lambda r: (r.denominator_n, r.code_a_present_n, r.code_b_present_n, r.n11_both_present)
    pairs = list(combinations(codes, 2))
    assert {(r.population, r.code_a, r.code_b): told(r) for r in derived.cooccurrence_of(table).collect()} == {(p, a, b): counts(own, a, b) for p, own in plain.items() for a, b in pairs}
    by = {(r.population, r.source, r.code_a, r.code_b): told(r) for r in derived.cooccurrence_by_source_of(table).collect()}
    assert by == {(p, s, a, b): counts([x for x in own if x[1] == s], a, b) for p, own in plain.items() for s in sources for a, b in pairs}
    out = {(r.population, r.removed_source, r.code_a, r.code_b): told(r) for r in derived.leave_source_out_of(table).collect()}
    assert out == {(p, s, a, b): counts([x for x in own if x[1] != s], a, b) for p, own in plain.items() for s in sources for a, b in pairs}
    none = df.sparkSession.createDataFrame([("x", "w")], "code_a string, code_b string")
    cross = {(r.population, r.code_a, r.code_b): told(r) for r in derived.crosswalk_of(table, none).collect()}
    grid = [(a, b) for a in codes for b in "wx" if (a, b) != ("x", "w")]
    assert cross == {(p, a, b): counts(own, a, b, 3, 4) for p, own in plain.items() for a, b in grid}
    assert any(k[0] == "text_unique" and v[0] == 0 for k, v in by.items())  # a source without a note of its own


def test_the_cube_of_presence_is_the_cube_of_notes(notes):
    rows, df = notes
    members = populations.membership(df)
    each = df.selectExpr("note_id", "inline(carried)").withColumn("present", df.note_id.isNotNull().cast("int"))
    own = derived.cube_of(*[populations.presence(each.where("family = 'typology'"), members), members], indicator=populations.presence(each.where("family = 'indicator'"), members))
    told = lambda t: sorted(map(str, t.select("every", "source", "a", "b", "full_n", "unique_n").collect()))
    assert told(own) == told(derived.cube(populations.marked(df)))


def test_a_table_is_few_shuffles_of_cells(notes):
    table = derived.cube(populations.marked(notes[1]))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert plan(derived.cooccurrence_of(table)) == 1 and plan(derived.cooccurrence_by_source_of(table)) == 1 and plan(derived.leave_source_out_of(table)) <= 4


def test_no_notes(spark):
    none = spark.createDataFrame([], "note_id string, source string, combined_text_sha256 string, carried array<struct<family:string,code:string,label:string>>")
    table = derived.cube(populations.marked(none))
    assert derived.cooccurrence_of(table).count() == derived.leave_source_out_of(table).count() == derived.concentration_of(table).count() == 0
