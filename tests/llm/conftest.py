import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, uid string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names clash with the operators' own."""

    def of(rows):
        full = [(i, t, "en", s, None if t is None else len(t), 9.0, False, "x") for i, t, s in (r if len(r) == 3 else (*r, "src") for r in rows)]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return of


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, blanks, repeats, ties, a very long text and unusual characters."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return make([
        (1, None), (2, ""), (3, " \t\n"), (4, "The same text."), (5, "The  same text."), (6, "the same text."), (7, "The same text."), (7, "The same text."), (None, "The same text."),
        (None, None), (8, long), (9, long + " end"), (10, "é\u00a0ñ \u2003x\x1cy\u200b\r\n\u3000 z"), (11, "😀 emoji <|endoftext|> and <|startoftext|>"), (12, "x" * 50_000), (13, "a\n\n\nb\n", None), (14, "\n".join(["same"] * 500))])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where(F.lit(False))
