import pytest


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with the names that operators use inside."""
    long = "A sentence about nothing in particular, number {}. ".format
    rows = [
        (1, "", None), (2, None, "x"), (None, "orphan text without an id", None), (3, "   \n\n \t ", ""), (4, "".join(map(long, range(4000))), "T"), (4, "".join(map(long, range(4000))), "T"),
        (5, "z" * 5000, None), (6, "short", "short"), (7, "é" * 1300 + " ü" * 50, "T"), (8, "a b c d e f g h i j k l m n o p", None), (8, "a b c d e f g h i j k l m n o p", None),
    ]
    names = ["_id", "_text", "_n", "_salt", "size", "kind", "line", "rank", "_title", "_flag", "a", "b"]
    wide = [(d, t, None if t is None else len(t.split()), title, None, None, None, *["clash"] * len(names)) for d, t, title in rows]
    schema = "doc_id long, text string, n_tokens int, title string, author string, ocr_used boolean, ocr_chars long, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame(wide, schema)
