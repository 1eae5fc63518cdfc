"""Gates over nested values and in the pass that writes, the maintained cache, and the single file."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from lectern.operators import gates, resolve
from lectern.operators.cache import Cache
from lectern.sources import files


def test_paths_and_keys_are_found_wherever_they_are_nested(spark):
    table = spark.sql(r"""SELECT 1 AS id, named_struct('x', array(named_struct('y', 'see /home/u/a', 'n', 1), named_struct('y', 'ok', 'n', 2), NULL)) AS s, map('source_path', 'z', 'b', 'file://q') AS m,
        parse_json('{"a":[1,{"note_id":"C:\\\\x","k":"/tmp/q","unique_text_count":"a/tmp/b"}],"snippet":null,"deep":{"er":{"still":["(/var/x"]}}}') AS v, 'https://a.b/home/u' AS t, array(1, 2) AS n, map(1, array('"D:/x')) AS w
        UNION ALL SELECT 2, NULL, NULL, NULL, NULL, NULL, NULL""")
    got = {(r.place, r.kind, r.shown) for r in gates.exposed(table).collect()}
    assert got == {
        ("s.x[0].y", "cell", "see /home/u/a"), ("m.source_path", "key", "source_path"), ("m.b", "cell", "file://q"), ("w.1[0]", "cell", '"D:/x'),
        ("v.a[1].note_id", "key", "note_id"), ("v.a[1].note_id", "cell", "C:\\x"), ("v.a[1].k", "cell", "/tmp/q"), ("v.snippet", "key", "snippet"), ("v.deep.er.still[0]", "cell", "(/var/x"),
    }
    assert gates.exposed(spark.range(3)).count() == 0 and gates.exposed(table.where("id > 2")).count() == 0


@pytest.mark.parametrize(("text", "shows"), [("x\n/home/a", True), ("x /homes/a", False), ("`/mnt/a", True), ("C:\\a", True), ("xC:\\a", False), ("https://x/tmp/y", False), ("file://x", True), ("(/private/", True), ("a=/Users/b", True)])
def test_what_shows_a_path(spark, text, shows):
    table = spark.createDataFrame([(text,)], "c string")
    assert (gates.local_paths(table).count() == 1) == shows == (gates.exposed(table).count() == 1)


def row(**more):
    base = dict(target="t", pair_n=10, agreement_n=8, disagreement_n=2, binary_pair_n=9, binary_agreement_n=8, agreement_pct=80.0, agreement_low_pct=50.0, agreement_high_pct=95.0, nominal_kappa=0.5, nominal_kappa_low=0.1, nominal_kappa_high=0.9, krippendorff_alpha=0.5, binary_kappa=0.5, ac1=0.6, ac1_low=0.2, ac1_high=1.0, adjudicated_present_n=2, adjudicated_absent_n=0, adjudicated_ambiguous_n=0, adjudicated_insufficient_text_n=0, adjudicated_not_applicable_n=0)
    return base | more


@pytest.mark.parametrize(("more", "rule"), [
    ({}, None), ({"nominal_kappa": None, "ac1_low": None}, None), ({"pair_n": 11}, "pairs_are_agreements_and_disagreements"), ({"binary_pair_n": 11}, "binary_pairs_are_pairs"), ({"binary_agreement_n": 9}, "binary_agreements_are_agreements"),
    ({"adjudicated_present_n": 1}, "adjudicated_are_disagreements"), ({"agreement_low_pct": 81.0}, "agreement_lies_in_its_interval"), ({"agreement_high_pct": 101.0}, "agreement_lies_in_its_interval"),
    ({"agreement_pct": 80.1}, "agreement_is_its_share"), ({"krippendorff_alpha": -1.1}, "coefficients_lie_within_one"), ({"ac1_high": 1.01}, "coefficients_lie_within_one"),
])
def test_each_rule_of_the_reliability_table(spark, more, rule):
    own = row(**more)
    kinds = ", ".join(f"{k} {'string' if k == 'target' else 'double' if isinstance(row()[k], float) else 'long'}" for k in own)
    broken = {r.rule for r in gates.broken_rules(spark.createDataFrame([tuple(own.values())], kinds), ["target"], gates.reliability_rules()).collect()}
    assert broken - {"agreement_is_its_share"} == ({rule} - {None, "agreement_is_its_share"}) and (rule != "agreement_is_its_share" or rule in broken)


def test_counts_against_the_matrix(spark):
    cells = spark.createDataFrame([("a", "present", "present", 3), ("a", "present", "absent", 1), ("a", "ambiguous", "ambiguous", 2), ("b", "absent", "absent", 1)], "target string, c1 string, c2 string, n long")
    table = spark.createDataFrame([("a", 6, 5, 1, 4, 3), ("c", 0, 0, 0, 0, 0), ("d", 1, 0, 0, 0, 0)], "target string, pair_n long, agreement_n long, disagreement_n long, binary_pair_n long, binary_agreement_n long")
    got = {(r.target, r.column, r.found, r.expected) for r in gates.counts_against_cells(table, cells).collect()}
    assert got == {("b", c, None, n) for c, n in (("pair_n", 1), ("agreement_n", 1), ("disagreement_n", 0), ("binary_pair_n", 1), ("binary_agreement_n", 1))} | {("d", "pair_n", 1, 0)}


def test_a_table_is_checked_as_it_is_written(spark, tmp_path):
    counted = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            counted.add(b.num_rows)
            yield b

    table = spark.range(100).mapInArrow(seen, "id long")
    path = f"{tmp_path}/out"
    found = gates.write_checked(table, path, {"small": F.col("id") < 100}, {"id": 4950.0}, 100)
    assert found["rows"] == 100 and counted.value == 100 and spark.read.parquet(path).count() == 100
    for k, (rules, sums, rows) in enumerate([({"small": F.col("id") < 99}, {}, None), ({}, {"id": 1.0}, None), ({}, {}, 99), ({"null": F.lit(None).cast("boolean")}, {}, None)]):
        with pytest.raises(gates.Violation):
            gates.write_checked(table, f"{tmp_path}/no{k}", rules, sums, rows)
    assert os.listdir(tmp_path) == ["out"]


def test_row_counts_against_metadata(spark):
    expected = spark.createDataFrame([("a", 3), ("b", 5), ("gone", 1)], "table string, expected long")
    got = {tuple(r) for r in gates.row_counts_agree({"a": spark.range(3), "b": spark.range(4), "new": spark.range(0)}, expected).collect()}
    assert got == {("b", 4, 5), ("gone", None, 1), ("new", 0, None)}


def test_one_file_in_order_or_none(spark, tmp_path):
    path = f"{tmp_path}/report.csv"
    table = spark.createDataFrame([(3, "c", 0.5), (1, 'a "q", x', None), (2, "b", 1.0)], "k int, x string, m double")
    files.write_csv_file(table, path, ["x", "m"], metrics=["m"], order=["k"])
    assert open(path).read() == 'x,m\n"a ""q"", x",\nb,1.000000\nc,0.500000\n'
    files.write_csv_file(table.where("k = 2"), path, ["x"])
    assert open(path).read() == "x\nb\n"
    broken = table.withColumn("x", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        files.write_csv_file(broken, path, ["x"])
    assert open(path).read() == "x\nb\n" and [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["report.csv"]
    files.write_csv_file(table.where("k > 9"), path, ["x"])
    assert open(path).read() in ("x\n", "")


def test_configurations_are_counted_without_blank_ones(spark):
    cache = lambda *x: spark.createDataFrame([(v,) for v in x], "ocr_config_sha256 string")
    assert resolve.one_configuration(cache("a", " ", None, "a ")).count() == 0
    assert resolve.one_configuration(cache("a", "b")).first().configurations == 2 and resolve.one_configuration(cache(" ")).first().configurations == 0


@pytest.fixture()
def cache(spark):
    name = f"cache_{uuid.uuid4().hex}"
    spark.sql("CREATE DATABASE IF NOT EXISTS lectern_tests LOCATION '" + __import__("tempfile").mkdtemp() + "'")
    yield Cache(spark, f"lectern_tests.{name}", 4)
    spark.sql(f"DROP TABLE IF EXISTS lectern_tests.{name}")


def test_cache_keeps_the_last_result_and_stays_where_it_lies(spark, cache):
    sha = lambda x: __import__("hashlib").sha256(x.encode()).hexdigest()
    config = F.sha2(F.lit("config"), 256)
    results = lambda *rows: spark.createDataFrame([(sha(i), sha("config"), s, t) for i, s, t in rows], "image_sha256 string, ocr_config_sha256 string, ocr_status string, ocr_text string")
    images = spark.createDataFrame([(f"p{i}", sha(f"i{i}")) for i in range(6)] + [("again", sha("i1"))], "path string, sha256 string")
    cache.append(results(("i0", "ok", "old"), ("i1", "ok", "one"), ("i2", "failed", "x")))
    cache.append(results(("i0", "ok", "new"), ("i3", "empty", "")))
    expected = {"p0": ("ok", "new", 1), "p1": ("ok", "one", 1), "again": ("ok", "one", 1), "p2": (None, None, 0), "p3": ("empty", "", 1), "p4": (None, None, 0), "p5": (None, None, 0)}
    for _ in range(2):
        found = cache.reuse(images, config)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {r.path: (r.ocr_status, r.ocr_text, r.cache_reused) for r in found.collect()} == expected
        assert plan.count("Exchange hashpartitioning") <= 1  # that of the images
        assert {r.path for r in cache.missing(images, config).collect()} == {"p2", "p4", "p5"}
        assert resolve.one_configuration(spark.table(cache.name)).count() == 0
        cache.compact()
    assert spark.table(cache.name).count() == 3
    cache.append(results(("i4", "ok", "late")))
    assert cache.missing(images, config).count() == 2


def test_codes_within_a_text_from_lists_as_from_rows(spark):
    import random

    from lectern.operators import populations

    rng = random.Random(3)
    rows = [(f"n{i}", rng.choice(["t1", "t1", "t2", "t3", "", None]), [c for c in "xyz" if rng.random() < 0.6]) for i in range(40)] + [("alone", "t9", []), ("same", "t9", [])]
    notes = spark.createDataFrame([(n, t, [(c, c) for c in own]) for n, t, own in rows], "note_id string, combined_text_sha256 string, own array<struct<code:string,label:string>>")
    long = spark.createDataFrame([(n, c, int(c in own)) for n, _, own in rows for c in "xyz"], "note_id string, code string, present int")
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(gates.same_carried_within_text(notes, "own")) == told(gates.same_within_text(long, notes)) != []
    assert gates.same_carried_within_text(notes.where("note_id IN ('alone', 'same')"), "own").count() == 0
    both = populations.with_codes(notes.withColumn("more", F.col("own")), {"own": "x", "more": "y"})
    assert {r.note_id for r in both.collect()} == {n for n, _, own in rows if {"x", "y"} <= set(own)}


def test_run_metrics_read_a_table_once(spark):
    table = spark.createDataFrame([("a", 1), (" ", 1), (None, None), ("a", 2)], "kind string, k int")
    got = files.run_metrics({"t": table, "none": table.limit(0)}, {"t": "kind", "none": "kind"}, {"t": ["k"]})
    assert {r.metric: r.value for r in got.collect()} == {"t_rows": 4, "t_distinct_k": 2, "t_kind_a": 2, "t_kind_(blank)": 2, "none_rows": 0}
