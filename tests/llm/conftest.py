import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

ODD_TEXTS = [
    None, "", " ", "a", "a", "b c", "Ünï çødé ΣΑΣ İ ½ ²", "x" * 5_000, "<|endoftext|> it's\n\n<|startoftext|>", "tab\tand\x1cold\x85space",
    "one two three four five six seven\n" * 40, "a\\b </turn> ### x: y", "日本語 😀👩‍👩‍👧 ﬁ é",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, copies, a repeated row, and columns whose names clash."""
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], (None, "nobody", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return docs.withColumns({"size": F.lit("x"), "kept": F.lit(1), "keep_id": F.lit("k"), "shard": F.lit(9), "rank": F.lit("r"), "length": F.lit(0), "group_size": F.lit(None), "n": F.lit(3), "Score": F.lit("q"), "h": F.lit("h"), "item": F.lit(1)})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
