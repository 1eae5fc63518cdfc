"""p15 gives its SQL's rows where texts are empty and keys or lengths are null, negative or large."""

import math

import duckdb

from lectern.plans import catalog

NAME = "p15_ratio_and_percent"
ROWS = [
    (0, 0), (7, 0), (1, 0), (13, 0), (-1, 0), (-7, 0), (None, 0), (2**63 - 1, 0), (-(2**63), 0),
    (2, None), (None, None), (None, 3), (3, 7), (-3, 7), (5, -7), (1, 3_200), (3, 6_400), (6, 1_200_000), (1, 2**62), (0, 5),
]


def shown(rows):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=str)


def test_ratio_over_nothing_is_that_of_the_sql(spark, tmp_path):
    docs = spark.createDataFrame([(k, "x" if n else "", "en", "s", n) for k, n in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()[NAME]).fetchall()
    got = [tuple(r) for r in catalog.queries()[NAME](spark, str(tmp_path)).select("doc_id", "ratio", "pct").collect()]
    assert len(want) == len(ROWS) and sum(r[1] is not None and math.isinf(r[1]) for r in want) == 4
    assert shown(got) == shown(want)
