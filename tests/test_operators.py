"""Operators on fixtures worked out by hand."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.functions import stats as S
from lectern.functions import text as T
from lectern.operators import codebook, coding, derived, extract, gates, populations, reliability, resolve
from lectern.sources import files

CORPUS = "note_id string, source string, text string, combined_word_count long, combined_text_sha256 string, markdown_present int, ocr_present int, text_source_count int"


@pytest.fixture(scope="module")
def small(spark):
    rows = [("n1", "s1", 3, "h1", 1, 0), ("n2", "s1", 3, "h1", 1, 0), ("n3", "s2", 2, "h2", 1, 1), ("n4", "s2", 0, "h3", 0, 0)]
    corpus = spark.createDataFrame(rows, "note_id string, source string, combined_word_count long, combined_text_sha256 string, markdown_present int, ocr_present int")
    carried = {"n1": "xy", "n2": "xy", "n3": "y", "n4": ""}
    coded = spark.createDataFrame([(n, c, c.upper(), int(c in own)) for n, own in carried.items() for c in "xy"], "note_id string, code string, label string, present int")
    members = populations.membership(corpus)
    return corpus, members, populations.presence(coded, members)


def one(df, **where):
    rows = [r for r in df.collect() if all(r[k] == v for k, v in where.items())]
    assert len(rows) == 1
    return rows[0]


def test_populations_and_audit(small):
    corpus, members, _ = small
    own = {(r.population, r.note_id) for r in members.collect()}
    assert {n for p, n in own if p == populations.UNIQUE} == {"n1", "n3", "n4"} and len(own) == 7
    audit = populations.duplicate_audit(corpus).first()
    assert (audit.record_count, audit.distinct_text_count, audit.duplicate_group_count, audit.excess_record_count, audit.largest_group_size, audit.zero_word_record_count) == (4, 3, 1, 1, 2, 1)


def test_derived_tables_by_hand(small):
    corpus, members, presence = small
    full = one(derived.cooccurrence(presence, members), population=populations.FULL)
    assert (full.n11_both_present, full.n10_a_only, full.n01_b_only, full.n00_neither, full.jaccard, full.lift) == (2, 0, 1, 1, 0.666667, 1.333333)
    unique = one(derived.cooccurrence(presence, members), population=populations.UNIQUE)
    assert (unique.n11_both_present, unique.n01_b_only, unique.n00_neither, unique.jaccard, unique.lift) == (1, 1, 1, 0.5, 1.5)
    x = one(derived.sensitivity(presence, members), code="x")
    assert (x.full_n, x.full_pct, x.unique_n, x.unique_pct, x.excess_n, x.reduction_pct, x.pct_difference, x.full_rank, x.unique_rank) == (2, 50.0, 1, 33.333, 1, 50.0, -16.667, 2, 2)
    top = one(derived.concentration(presence, members), population=populations.FULL, code="y")
    assert (top.top_source, top.top_source_positive_records_n, top.source_hhi) == ("s1", 2, 0.555556)
    by = derived.cooccurrence_by_source(presence, members)
    out = derived.leave_source_out(derived.cooccurrence(presence, members), by)
    gone = one(out, population=populations.FULL, removed_source="s1")
    assert (gone.denominator_n, gone.code_a_present_n, gone.code_b_present_n, gone.jaccard, gone.lift) == (2, 0, 1, 0.0, 0.0)
    assert (by.count(), out.count(), derived.source_normalized(presence, members, corpus).count()) == (4, 4, 8)
    ranks = derived.leave_source_out_ranks(presence, members)
    assert one(ranks, population=populations.FULL, removed_source="s1", code="y").rank == 1


def test_union_is_no_sum(spark, small):
    _, members, presence = small
    groups = spark.createDataFrame([("x", "g"), ("y", "g")], "code string, group string")
    assert one(derived.group_union(presence, members, groups), population=populations.FULL).record_n == 3


def test_coding_counts_overlaps_and_orders_snippets(spark):
    notes = spark.createDataFrame([("a", "s", "ab ab", 2, "h", 1, 0, 1), ("b", "s", "none", 1, "i", 1, 0, 1)], CORPUS)
    codes = [codebook.Code("k", "K", "o", ("ab", "ab ab"))]
    rows = {r.note_id: r for r in coding.code_notes(notes, codes).collect()}
    assert (rows["a"].hit_count, rows["a"].pattern_count, rows["a"].rule_match_intensity, rows["b"].present) == (3, 2, "medium", 0)
    found = coding.evidence(notes, codes).orderBy("snippet_index").collect()
    assert [r.matched for r in found] == ["ab", "ab", "ab ab"]


def test_whole_terms_and_spans_with_wide_characters(spark):
    rows = spark.createDataFrame([("wire wireless rewire WIRE wire-transfer", "wire", 3), ("élan lan", "lan", 1), ("😀 ab é ab", "ab", 2)], "t string, k string, n int").collect()
    for r in rows:
        frame = spark.createDataFrame([(r.t,)], "t string")
        assert frame.select(T.term_count(F.col("t"), r.k)).first()[0] == r.n
    got = extract.spans(spark.createDataFrame([("n", "😀 ab é ab")], "note_id string, text string"), "ab").collect()
    assert [("😀 ab é ab"[r.start : r.end], r.match_index) for r in got] == [("ab", 1), ("ab", 2)]


def test_paths_dates_and_sources(spark):
    rows = spark.createDataFrame([("Cafe\u0301\\a/./b.md",), ("x/Root/src  1/2026 - 02 - 17.md",), ("Root/log20260217.md",)], "p string")
    got = rows.select(T.posix_path(F.col("p")).alias("x"), T.source_in(F.col("p"), ["Root"]).alias("s"), T.date_in(F.col("p"), [r"(\d{4}) - (\d{2}) - (\d{2})", r"(\d{4})(\d{2})(\d{2})"]).alias("d")).collect()
    assert got[0].x == unicodedata.normalize("NFC", "Café/a/b.md")
    assert [(r.s, r.d) for r in got] == [("", ""), ("src 1", "2026-02-17"), ("", "2026-02-17")]


def test_references_are_resolved_or_told_why_not(spark):
    inventory = spark.createDataFrame([("assets/screen shot.png", "screen shot.png", "h1"), ("a/d.png", "d.png", "h2"), ("b/d.png", "d.png", "h3")], "path string, basename string, sha256 string")
    refs = spark.createDataFrame([(1, "notes", "../assets/screen%20shot.png"), (2, "", "../../outside.png"), (3, "", "https://example.org/a.png"), (4, "", "missing.png"), (5, "", "C:/x.png"), (6, "", "/x.png"), (7, "a", "d.png")], "ref_id int, note_dir string, ref string")
    got = {r.ref_id: r for r in resolve.by_path(refs, inventory).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "resolved", 2: "unsafe", 3: "external", 4: "missing", 5: "unsafe", 6: "unsafe", 7: "resolved"}
    assert got[1].sha256 == "h1" and "note_relative" in got[1].method and got[7].path == "a/d.png"
    named = {r.basename: r.status for r in resolve.by_basename(spark.createDataFrame([("d.png",), ("x.png",)], "basename string"), inventory).collect()}
    assert named == {"d.png": "ambiguous", "x.png": "missing"}


def test_cache_rows_that_may_be_used(spark):
    from hashlib import sha256

    img, conf, other = ("a" * 64, "b" * 64, "c" * 64)
    key = lambda a, b: sha256(f"{a}:{b}".encode()).hexdigest()
    rows = [(img, other, key(img, conf), "ok", "1", 0), (img, None, key(img, conf), "ok", "2", 1), (img, conf, key(img, conf), "error", "3", 2), ("zz", conf, key("zz", conf), "ok", "4", 3), (img, conf, key(img, conf), "ok", "5", 4)]
    cache = spark.createDataFrame(rows, "image_sha256 string, ocr_config_sha256 string, ocr_cache_key string, ocr_status string, ocr_text string, ordinal int")
    assert [r.ocr_text for r in resolve.usable_cache(cache).collect()] == ["5"]


def test_text_of_a_note_counts_contents_once(spark):
    corpus = spark.createDataFrame([("n", "s"), ("m", "s")], "note_id string, source string")
    refs = spark.createDataFrame([("n", 1, "p1", "A", "ok", 2, 7, "one two"), ("n", 2, "p2", "A", "ok", 2, 7, "one two"), ("n", 3, "p3", "B", "empty", 0, 0, "")], "note_id string, ref_index int, path string, sha256 string, ocr_status string, ocr_word_count long, ocr_char_count long, ocr_text string")
    got = {r.note_id: r for r in resolve.text_per_note(corpus, refs).collect()}
    n = got["n"]
    assert (n.ocr_ref_count, n.ocr_ok_count, n.unique_image_count, n.unique_ok_count, n.duplicate_ref_count, n.ocr_word_count, n.ocr_text) == (3, 2, 2, 1, 1, 2, "one two")
    assert got["m"].ocr_ref_count == 0 and got["m"].ocr_text == ""


def sheet(spark, models, first, second, final, weights=None):
    ids = [f"r{i}" for i in range(len(models))]
    machine = spark.createDataFrame([(i, "t", "c", str(m), w) for i, m, w in zip(ids, models, weights or ["1"] * len(ids))], "record_id string, target_type string, code string, model_present string, analysis_weight string")
    a, b = (spark.createDataFrame(list(zip(ids, x)), "record_id string, decision string") for x in (first, second))
    adj = spark.createDataFrame(list(zip(ids, first, second, final)), "record_id string, coder_1_decision string, coder_2_decision string, adjudicated_decision string") if final else None
    table = reliability.counts(reliability.records(machine, a, b, adj))
    return one(reliability.weighted_metrics(reliability.machine_metrics(reliability.agreement(table))), code="(all)")


def test_validation_by_hand(spark):
    p, a, m = "present", "absent", "ambiguous"
    r = sheet(spark, [1, 0, 1, 0], [p, a, p, a], [p, a, p, a], None)
    assert (r.agreement, r.kappa, r.tp, r.fp, r.tn, r.fn, r.accuracy) == (1.0, 1.0, 2, 0, 2, 0, 1.0)
    r = sheet(spark, [1, 0], [p, a], [a, p], [p, a])
    assert (r.agreement, r.kappa, r.unresolved_n, r.tp, r.tn) == (0.0, -1.0, 0, 1, 1)
    r = sheet(spark, [1, 0, 1], [m, a, p], [m, a, a], [m, a, p])
    assert (r.complete_pair_n, r.agreement_n, r.binary_pair_n, r.final_ambiguous_n, r.tp + r.fp + r.tn + r.fn) == (3, 2, 2, 1, 2)
    r = sheet(spark, [1, 1], [p, p], [p, p], None)
    assert r.kappa is None and r.ac1 == 1.0
    r = sheet(spark, [1, 1, 0, 0], [p, a, a, p], [p, a, a, p], None, ["9", "1", "9", "1"])
    assert r.accuracy == 0.5 and round(r.weighted_accuracy, 9) == 0.9 and round(r.weighted_accuracy_effective_n, 6) == 2.439024


def test_wilson_and_weights(spark):
    low, high = S.wilson(F.col("k"), F.col("n"))
    got = [(r[0] and round(r[0], 6), r[1] and round(r[1], 6)) for r in spark.createDataFrame([(49, 56), (15, 15), (0, 0)], "k int, n int").select(low, high).collect()]
    assert got == [(0.763745, 0.938109), (0.796117, 1.0), (None, None)]
    bad = spark.createDataFrame([(x,) for x in ("", "0", "-1", "nan", "inf", "x")], "w string").select(T.weight(F.col("w")).alias("w"))
    assert all(r.w is None for r in bad.collect())


def test_gates(spark):
    table = spark.createDataFrame([("s", "n", 1)], "source string, note_id string, note_count int")
    assert gates.blocked_fields(table.schema) == ["note_id"]
    nested = spark.createDataFrame([(("t", 1), 2)], "s struct<combined_text: string, k: int>, exact_text_unique_denominator_n int")
    assert gates.blocked_fields(nested.schema) == ["s.combined_text"]
    cells = spark.createDataFrame([("C:\\Users\\a",), ("/home/u/x",), ("https://a.b/home/u/",), (None,)], "c string")
    assert {r.cell for r in gates.local_paths(cells).collect()} == {"C:\\Users\\a", "/home/u/x"}
    assert gates.schema_contract(table, ["source", "note_id"]) == ["extra: note_count"] and gates.schema_contract(table, table.columns) == []
    with pytest.raises(gates.Violation):
        gates.require(gates.unique_key(table.union(table), "note_id"), "ids")


def test_patterns_that_match_nothing_are_refused(spark):
    bad = spark.createDataFrame([("f", "c", "l", "o", 0, "a*")], codebook.SCHEMA)
    with pytest.raises(ValueError):
        codebook.load(bad, "f")


def test_files(spark, tmp_path):
    (tmp_path / "Root" / "src").mkdir(parents=True)
    (tmp_path / "Root" / "src" / "2024 - 01 - 02.md").write_bytes(b"two words \xff")
    (tmp_path / "Root" / "loose.md").write_text("x")
    (tmp_path / "Root" / "src" / "A b.PNG").write_bytes(b"png")
    rows = files.notes(spark, str(tmp_path), ["Root"], [r"(\d{4}) - (\d{2}) - (\d{2})"]).collect()
    assert [(r.source, r.collection_date, r.word_count, r.relative_path) for r in rows] == [("src", "2024-01-02", 2, "Root/src/2024 - 01 - 02.md")]
    assert [(r.path, r.basename) for r in files.images(spark, str(tmp_path)).collect()] == [("Root/src/A b.PNG", "a b.png")]
    path = tmp_path / "t.csv"
    path.write_bytes("﻿id, v \n1, a \n2,\n".encode())
    assert [tuple(r) for r in files.read_contract(spark, str(path), ["id"]).collect()] == [("1", "a"), ("2", "")]
    assert files.read_strict(spark, str(path), ["id"], "sheet").count() == 2
    for text in ("", "a,a\n1,2\n", "a,\n1,2\n", "a,b\n1\n", "a,b\n"):
        path.write_text(text)
        with pytest.raises(files.Contract):
            files.read_strict(spark, str(path), [], "sheet")
    out = str(tmp_path / "out")
    files.write_csv(spark.createDataFrame([("k", 0.5, None)], "k string, m double, x string"), out, ["m", "k", "x"], metrics=["m"])
    assert [tuple(r) for r in files.read_csv(spark, out).collect()] == [("0.500000", "k", "")]
    with pytest.raises(files.Contract):
        files.write_csv(spark.createDataFrame([("k", 1)], "k string, y int"), out, ["k"], extras="refuse")


def test_coding_of_a_stream_equals_the_batch(spark, tmp_path):
    from lectern.streaming.coding import code_stream

    rows = [("a", "s", "ab ab", 2, "h", 1, 0, 1), ("b", "s", "none", 1, "i", 1, 0, 1)]
    batch = spark.createDataFrame(rows, CORPUS)
    batch.write.parquet(str(tmp_path / "in"))
    codes = [codebook.Code("k", "K", "o", ("ab",))]
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    code_stream(stream, codes, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, coding.code_notes(batch, codes).collect()))


def test_prices_beside_known_codes_alone(spark):
    text = "the cost is $5 and $10k or $7.255, US$7 aud $1,250.50 usd, $3  NZD; $0 x 2.5 btc 1.2.3 xmr 4 monero 9bitcoins 12 USDT $20,000,000"
    got = extract.price_mentions(spark.createDataFrame([("n", "s", text), ("m", "s", None), ("o", "s", "no price")], "note_id string, source string, text string")).collect()
    assert [(r.currency, r.amount) for r in got] == [("UNSPECIFIED_DOLLAR", "5"), ("UNSPECIFIED_DOLLAR", "7"), ("AUD", "1250.5"), ("NZD", "3"), ("BTC", "2.5"), ("XMR", "4"), ("USDT", "12")]
    assert got[0].context.startswith("the cost is $5 and") and "  " not in got[3].context


def test_image_references_end_in_png(spark):
    text = 'a ![[x.png]] ![[dir/y.PNG|200]] ![t](u v.png) ![t](w.png "title") [no](d.png) ![[a.jpg]]'
    got = extract.image_references(spark.createDataFrame([("n", text)], "note_id string, text string")).collect()
    # as lazily as the pattern is written, an embedding that does not end in .png reaches on to one that does
    assert [(r.ref_index, r.ref) for r in got] == [(1, "x.png"), (2, "dir/y.PNG"), (3, "u v.png")]


def test_blank_hashes_and_sources(spark):
    rows = [("n1", None, "", 1), ("n2", " ", "", 0), ("n3", "s", None, 2), ("n4", "s", "h", 2)]
    corpus = spark.createDataFrame([(*r, 1, 0) for r in rows], "note_id string, source string, combined_text_sha256 string, combined_word_count long, markdown_present int, ocr_present int")
    audit = populations.duplicate_audit(corpus).first()
    assert (audit.distinct_text_count, audit.duplicate_group_count, audit.largest_group_size, audit.excess_record_count) == (4, 0, 1, 0)
    members = populations.membership(corpus)
    coded = spark.createDataFrame([(r[0], "x", "X", 1) for r in rows], "note_id string, code string, label string, present int")
    got = one(derived.source_normalized(populations.presence(coded, members), members, corpus), population=populations.FULL, source="(no_source)")
    assert (got.source_record_n, got.positive_records_n, got.rate_pct) == (2, 2, 100.0)
    ranks = derived.leave_source_out_ranks(populations.presence(coded, members), members)
    assert one(ranks, population=populations.FULL, removed_source="(no_source)").record_n == 2


def test_decisions_are_compared_once_they_are_normal(spark):
    sheet = lambda *d: spark.createDataFrame(list(enumerate(d)), "record_id int, decision string")
    said = spark.createDataFrame([(0, "Present", "absent"), (1, "", "absent"), (2, "absent", "ambiguous")], "record_id int, coder_1_decision string, coder_2_decision string")
    found = gates.repeated_decisions(said, sheet("present ", "absent", "present"), sheet("ABSENT", "absent", "")).collect()
    assert [(r.record_id, r.coder_1_decision, r.said_1) for r in found] == [(2, "absent", "present")]


def test_names_and_paths_that_stay_private(spark):
    names = "ranked_snippets unique_text_count evidence_packet_count Legacy_Note_Id context_n exact_text_unique_rank raw_path"
    table = spark.createDataFrame([(1,) * 7], names.split())
    assert gates.blocked_fields(table.schema) == ["ranked_snippets", "Legacy_Note_Id", "raw_path"]
    cells = spark.createDataFrame([(x,) for x in ("file:///home/u/x", "`/home/u/x`", "see https://a.b/home/u", "x\n/tmp/y", "home/u")], "c string")
    assert {r.cell for r in gates.local_paths(cells).collect()} == {"file:///home/u/x", "`/home/u/x`", "x\n/tmp/y"}


def test_sheets_may_have_no_weights_and_snippets_may_be_blank(spark):
    machine = spark.createDataFrame([("r", "t", "c", "1")], "record_id string, target_type string, code string, model_present string")
    said = spark.createDataFrame([("r", "present")], "record_id string, decision string")
    r = one(reliability.weighted_metrics(reliability.machine_metrics(reliability.agreement(reliability.counts(reliability.records(machine, said, said))))), code="(all)")
    assert (r.tp, r.weighted_n, r.weighted_accuracy) == (1, 0, None)
    snippets = spark.createDataFrame([("c", "n1", 1, " "), ("c", "n2", 1, "Ab"), ("c", "n3", 1, "aB"), ("c", "n4", 1, "z")], "code string, note_id string, snippet_index int, snippet string")
    assert [(r.note_id, r.place) for r in coding.distinct_snippets(snippets, 5).orderBy("place").collect()] == [("n2", 1), ("n4", 2)]


def test_provenance_of_old_and_new_exports(spark):
    h = lambda c: c * 64
    inventory = spark.createDataFrame([("a/x.png", "x.png", h("a")), ("b/y.png", "y.png", h("b")), ("c/y.png", "y.png", h("c"))], "path string, basename string, sha256 string")
    refs = [(1, "resolved", "a/x.png", h("A"), "", ""), (2, "resolved", "", h("a"), "", ""), (3, "resolved", "a/x.png", "", "", ""), (4, "", "a/x.png", "zz", "", ""), (5, "", "", "", "dir/X.png", "1"), (6, "", "", "", "y.png", "1"), (7, "", "", h("b"), "x.png", "1"), (8, "missing", "", "", "", ""), (9, "", "", "", "x.png", "0"), (10, "", "../x.png", "", "", "")]
    got = {r.ref_id: (r.path, r.violation) for r in resolve.provenance(spark.createDataFrame(refs, "ref_id int, status string, path string, sha256 string, image_name string, exists_in_root string"), inventory).collect()}
    assert got == {1: ("a/x.png", None), 2: (None, "resolved_without_path"), 3: ("a/x.png", "resolved_without_hash"), 4: ("a/x.png", "bad_hash"), 5: ("a/x.png", None), 6: (None, None), 7: ("a/x.png", "hash_changed"), 9: (None, None), 10: (None, "image_not_in_inventory")}


def test_notes_from_files_have_one_kind_of_line_end(spark, tmp_path):
    (tmp_path / "Root" / "src").mkdir(parents=True)
    (tmp_path / "Root" / "src" / "n.md").write_bytes(b"a\r\nb\rc")
    row = files.notes(spark, str(tmp_path), ["Root"], []).first()
    assert (row.text, row.char_count) == ("a\nb\nc", 5)


def test_metrics_of_a_run(spark):
    table = spark.createDataFrame([("ok", "p"), ("ok", "p"), (None, "q")], "status string, path string")
    got = {r.metric: r.value for r in files.run_metrics({"refs": table}, {"refs": "status"}, {"refs": ["path"]}).collect()}
    assert got == {"refs_rows": 3, "refs_distinct_path": 2, "refs_status_ok": 2, "refs_status_(blank)": 1}
