import pytest

from threatlens.llm import shared

ODD = [
    (0, None, None, None), (1, "", "en", "a"), (2, " \t\n", "en", None), (3, "One", "en", "a"),
    (4, "one", "en", "b"), (5, "Same words here, the very same. " * 9, "en", "a"),
    (6, "same WORDS here, the very same. " * 9, "en", "a"), (7, "x" * 5000, "de", "c"),
    (8, "word " * 20000 + "end.", "de", "c"), (9, "Ünï çödé 中文 \U0001f642 text.\x0bIt\x1cis odd\x85!", "fr", "é"),
    (None, "No id here at all.", "en", "a"), (None, "No id here at all.", "en", "a"),
    (12, "<|endoftext|> 'tis  two  spaces \n and it's don't \r\n", "en", "b"),
    (13, "One", "en", "a"), (13, "One", "en", "a"), (14, "a b c d e " * 40, "es", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string, row_no string, key string, label string"


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like internal ones."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    rows = [(*r, "x", "y", "z") for r in ODD]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return shared.prepare(spark).read.parquet(path)


@pytest.fixture(scope="session")
def none(odd, spark, tmp_path_factory):
    """The same columns without a row."""
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    odd.limit(0).write.parquet(path)
    return spark.read.schema(odd.schema).parquet(path)


@pytest.fixture(scope="session")
def given(spark):
    """The smallest given documents as rows."""
    return shared.prepare(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def keys():
    """Sorts rows that may hold nulls."""
    return lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))
