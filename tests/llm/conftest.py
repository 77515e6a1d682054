import pytest

ODD_TEXTS = [
    (0, None),
    (1, ""),
    (2, " \n\t "),
    (3, "one"),
    (4, "one two"),
    (5, "One two three four five six seven eight nine ten."),
    (6, "one TWO three four five six seven eight nine ten."),
    (7, "the same line here\nthe same line here\nthe same line here\n" * 5),
    (8, "word " * 30_000),
    (9, "x" * 100_000),
    (10, "été naïve 中文 文字 🙂 \x00 \u2028 <|endoftext|>  double  spaces"),
    (11, "the same line here\nthe same line here\nthe same line here\n" * 5),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, ties, very long texts, a repeated row and extra columns with names that operators use."""
    rows = [(i, t, "en", "s", 1, i, "k", 2) for i, t in ODD_TEXTS] + [(5, ODD_TEXTS[5][1], "en", "s", 1, 5, "k", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, component string, n int")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
