"""The pipeline, stage by stage on each stage's own input, against the brute-force versions."""

import pytest
from pyspark.sql import functions as F
from test_line_dedup import every_block
from test_ngram_join import plain as plain_components
from test_tokens import PATH, check_packing
from tokenizers import Tokenizer

from lectern.llm import toxicity as X
from lectern.llm.line_dedup import lines_of


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    import corpus_pipeline

    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf_dir).write.parquet(f"{folder}/{k}")
        seen.append(spark.read.parquet(f"{folder}/{k}"))
    return seen


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [df.columns for df in stages[:4]] == [stages[0].columns] * 4
    assert [df.dtypes for df in stages[:4]] == [stages[0].dtypes] * 4


def test_toxicity_drops_what_its_scores_say(spark, stages, sf_dir):
    scores = {r.doc_id: r.score for r in X.score_documents(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    kept = texts(stages[1])
    assert set(kept) == {d for d, s in scores.items() if s < 0.5}
    assert all(kept[d] == t for d, t in texts(stages[0]).items() if d in kept)


def test_line_dedup_is_the_plain_rule(stages):
    docs = texts(stages[1])
    gone = every_block(list(docs.items()))
    left = {d: "".join(x for i, x in enumerate(lines_of(t or "")) if i not in set(gone.get(d, []))) if t is not None else None for d, t in docs.items()}
    assert texts(stages[2]) == {d: t for d, t in left.items() if not gone.get(d) or t.strip()}
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_one_of_each_group_stays(stages):
    found = plain_components(list(texts(stages[2]).items()), 5, 80)
    assert set(texts(stages[3])) == {d for d, (_, c) in found.items() if d == c}


def test_everything_is_packed(stages):
    check_packing(stages[4].collect(), texts(stages[3]), Tokenizer.from_file(PATH), 4_096)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    import corpus_pipeline

    key = lambda r: (r.doc_id, r.piece)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[4].collect()))
    assert key


def test_odd_and_empty_documents_pass_all_stages(spark, sf_dir, odd_docs, no_docs):
    """Columns whose names clash with those of the stages come through as they were."""
    import corpus_pipeline

    for docs in (odd_docs.withColumns({"text_key": F.lit("t"), "removed": F.lit("r"), "key": F.lit("k")}), no_docs):
        names, first = docs.columns, docs.drop("text", "n_chars")
        own = {tuple(map(str, r)) for r in first.collect()}
        for _, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == names
            assert {tuple(map(str, r)) for r in docs.drop("text", "n_chars").collect()} <= own
        assert corpus_pipeline.STAGES[3][1](spark, docs, sf_dir).count() == docs.count()


def test_rows_without_or_with_shared_ids(spark, tmp_path):
    import corpus_pipeline

    bad, clean = "idiot moron trash", [f"w{i} v{i} u{i} t{i}" for i in range(60)]
    rows = [(i, f"{clean[i]} {bad if i % 2 else 'good day'} {clean[-i - 1]}") for i in range(40)]
    spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([*rows, (None, f"a b {bad} c"), (None, "a b good day c"), (4, f"x y {bad} z"), (4, "q r good day s")], "doc_id long, text string")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in kept if bad in r.text) == []
    assert sum(r.doc_id is None for r in kept) == 1 and sum(r.doc_id == 4 for r in kept) == 2
    near = " ".join(f"n{i}" for i in range(80))
    docs = spark.createDataFrame([(1, near), (5, f"{near} more"), (5, "its own text here"), (None, near), (9, None), (9, "")], "doc_id long, text string")
    kept = corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, kept)) == sorted(map(str, docs.where("NOT (doc_id <=> 5 AND text LIKE '%more')").collect()))
