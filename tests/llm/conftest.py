import pytest

LONG = " ".join(f"word{i % 977} " + ("the", "of", "and")[i % 3] for i in range(30000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, _fp string, draws int, kept string, _bucket int"
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (None, "no id but words " * 5, "en", None, 3), (4, LONG, "en", "b", 9),
    (5, "Same text here, the one and only of all. " * 20, "en", "a", 1), (5, "Same text here, the one and only of all. " * 20, "en", "a", 1), (6, "Same text here, the one and only of all. " * 20, "de", "\U0001f600", 1),
    (7, "one", "en", "c", 3), (8, "one two", "en", "c", 3), (9, "é ü   x y ### $$$ | <a>", "fr", "Z", 3), (10, "\\ <|im_end|> </s>", "en", "z", 3),
    (11, "x" * 50000, "en", "c", 1), (12, "line one is here\n" * 30, "en", "c", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, a very long text, repeats, ties and columns with clashing names."""
    return spark.createDataFrame([(*r, 77, "s", "f", 1, "k", 2) for r in ROWS], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
