"""Terms and patterns by automaton against the plain regular expressions that they stand for."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import coding, extract, matching
from lectern.operators.codebook import Code

TERMS = [("k", "visa"), ("k", "a a"), ("k", "é1"), ("k", "kk"), ("k", "ss"), ("k", "aa"), ("j", "A"), ("k", "-x-"), ("k", "straße"), ("k", "i"), ("k", "")]
PATTERNS = [r"\blicen[sc]ed?\b", r"pass=[0-9a-f]+", r"[a-z]+@[a-z.]+", r"\bthe\b.{0,4}\bof\b", r"(foo|barr)+x?", r"(?:ab)?c\.", r"kis+", r"colou?r", r"\w+\s", "é+"]
NOTES = "note_id string, source string, text string"
CORPUS = "note_id string, source string, markdown_present int, ocr_present int, text_source_count int, text string"


def plain_counts(text):
    own = {k: len(re.findall(rf"(?<!\w){re.escape(t)}(?!\w)", text, re.IGNORECASE)) for k, (_, t) in enumerate(TERMS) if t}
    return {k: n for k, n in own.items() if n}


def test_terms_are_counted_as_by_their_expressions():
    rng, own = random.Random(3), matching.Terms(TERMS)
    for _ in range(8_000):
        text = "".join(rng.choice("a A-xéÉ1kKKsSſßıİi_ ́") for _ in range(rng.randint(0, 14)))
        text += rng.choice(["", "", *[t for _, t in TERMS]])
        assert own.counts(text) == plain_counts(text), text


def test_each_of_many_terms_has_its_own_count_and_the_plan_stays_small(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(2, 7))).strip() or "x" for _ in range(50_000)]
    terms = sorted({("w", w) for w in words})
    texts = [" ".join(rng.choice(words) for _ in range(60)).upper() for _ in range(6)] + ["", None]
    notes = spark.createDataFrame([(f"n{i}", "s", t) for i, t in enumerate(texts)], NOTES)
    found = matching.term_mentions(notes, terms)
    few = matching.term_mentions(notes, terms[:2])
    plan = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert abs(plan(found) - plan(few)) < 50  # numbers of expressions differ in digits
    got = {(r.note_id, r.entity): r["count"] for r in found.collect()}
    assert len(got) > 200
    some = rng.sample(sorted({t for _, t in got}), 40) + rng.sample(words, 10)
    counted = notes.select("note_id", *[T.term_count(F.coalesce("text", F.lit("")), t).alias(f"c{k}") for k, t in enumerate(some)]).collect()
    for r in counted:
        for k, t in enumerate(some):
            assert got.get((r.note_id, t), 0) == r[f"c{k}"], t


def test_dictionary_tables_are_taken_once_each_and_bounded(spark, monkeypatch):
    table = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("a", ""), ("a", None)], "entity_type string, entity string")
    assert matching.load_terms(table) == [("a", "x"), ("b", "x")]
    monkeypatch.setattr(matching, "MOST_TERMS", 1)
    with pytest.raises(ValueError):
        matching.load_terms(table)


@pytest.mark.parametrize(("pattern", "needs"), [
    (r"\blicen[sc]ed?\b", {"licen"}), (r"password=[0-9a-f]+", {"password="}), (r"[a-z0-9.]+@[a-z0-9.]+", {"@"}), (r"(foo|barr)+x?", {"foo", "barr"}),
    (r"(?:ab)?c", None), (r"\w+\s", None), ("straße", {"stra"}), (r"(foo|b)", None), (r"(?=abc)x", None), (r"a{0,3}", None), (r"(?:xyz){2}", {"xyz"}), (r"KEY", {"key"}),
])
def test_what_a_pattern_needs(pattern, needs):
    assert matching.required(pattern) == (None if needs is None else frozenset(needs))


def test_patterns_passed_over_never_match():
    rng, own = random.Random(5), matching.Patterns([(p,) for p in PATTERNS])
    parts = ["licen", "s", "ſ", "c", "ed", " ", "pass=", "PASS=", "a", "@", "the", "THE", " of", "foo", "BARR", "x", "ab", "C.", "K", "i", "İ", "ı", "colo", "u", "r", "\n", "é", "é", "क", "ि"]
    for _ in range(8_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        expected = {k: [m.span() for m in re.finditer(p, text, matching.DEFAULT)] for k, p in enumerate(PATTERNS)}
        got = own.matches(text, 2)
        assert {g: hits[0] for g, (hits, _) in got.items()} == {k: len(x) for k, x in expected.items() if x}
        assert all([p[:2] for p in places] == expected[g][:2] for g, (_, places) in got.items())
        assert set(own.matches(text, 0, once=True)) == set(got)


def test_counts_and_evidence_agree_on_combining_marks(spark):
    """One engine: where a word ends is the same for both."""
    texts = ["café cafe", "café", "हिन्दी में लिखा", "äb 12̀", "plain cafe here", None, ""]
    corpus = spark.createDataFrame([(f"n{i}", "s", 1, 0, 1, t) for i, t in enumerate(texts)], CORPUS)
    codes = [Code("C1", "word", "o", (r"\bcafe\b",)), Code("C2", "words", "o", (r"\w+\s", r"\bलिखा\b")), Code("C3", "digit", "o", (r"\d+\b",))]
    coded = {(r.note_id, r.code): r.hit_count for r in coding.code_notes(corpus, codes).collect()}
    shown = {(r.note_id, r.code): r.n for r in coding.evidence(corpus, codes, 1_000).groupBy("note_id", "code").agg(F.count("*").alias("n")).collect()}
    assert len(coded) == len(texts) * len(codes)
    assert {k: n for k, n in coded.items() if n} == shown
    assert coded["n1", "C1"] == 1 and coded["n0", "C1"] == 2
    for i, t in enumerate(texts):
        for c in codes:
            assert coded[f"n{i}", c.code] == sum(len(re.findall(p, t or "", matching.DEFAULT)) for p in c.patterns)
    kept = {r.note_id: {c.code for c in r.family} for r in coding.carried(corpus, {"family": codes}).collect()}
    assert kept == {f"n{i}": {c.code for c in codes if coded[f"n{i}", c.code]} for i in range(len(texts))}


def test_two_thousand_patterns_read_a_text_once(spark):
    codes = [Code(f"C{k:04}", "l", "o", (rf"\bword{k}\b", rf"mark-{k}!")) for k in range(1_000)]
    corpus = spark.createDataFrame([("n", "s", 1, 0, 1, "word7 word77 WORD777 mark-77! word7"), ("m", "s", 1, 0, 1, "")], CORPUS)
    table = coding.code_notes(corpus, codes)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("found(") <= 2  # one call, however often it is told
    got = {r.code: (r.hit_count, r.pattern_count) for r in table.where("present = 1 AND note_id = 'n'").collect()}
    assert got == {"C0007": (2, 1), "C0077": (2, 2), "C0777": (1, 1)}
    assert table.count() == 2_000


def test_keywords_and_prices_use_the_same_engine(spark):
    notes = spark.createDataFrame([("n", "s", "résume re\nXX USD $5, $1,200.50 AUD and 3 bitcoin"), ("m", "s", None)], NOTES)
    got = {(r.note_id, r.keyword): r["count"] for r in extract.keyword_counts(notes, {"re": r"\bre\b", "line": r"^xx"}).collect()}
    assert got == {("n", "re"): 2, ("n", "line"): 1, ("m", "re"): 0, ("m", "line"): 0}
    prices = [(r.currency, r.amount, r.raw) for r in extract.price_mentions(notes).collect()]
    assert prices == [("USD", "5", "USD $5,"), ("AUD", "1200.5", "$1,200.50 AUD"), ("BTC", "3", "3 bitcoin")]
