"""Document tables for the tests of the training-data operators."""

import pytest

ROWS = [
    (1, "the cat sat on the mat and then the cat sat on the mat again", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, "the cat sat on the mat and then the cat sat on the mat again", "b"),
    (5, "  Tabs\tand\nlines \x0b here  ", "b"),
    (6, "naïve café 😀 ▁ mark  double  blanks", "c"),
    (7, "x" * 500, "c"),
    (8, "word " * 3000, "a"),
    (9, "<|endoftext|> </s> <unk> <0x41>", "d"),
    (10, "one", "d"),
    (10, "one", "d"),
    (11, "The Cat sat on the mat and then the cat sat on the mat AGAIN", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    schema = "doc_id long, text string, source string, bucket int, node long, features string, ids string, n long, _id long, kept string"
    rows = [(*r, i % 2, None, "f", "i", 1, i, "k") for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def tiny(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
