import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, n long, rep long, label int, _assign string, __text_extra string"


def doc(i, text, lang="en", source="src0"):
    return (i, text, lang, source, None if text is None else len(text), 0.5, 3, 7, 9, 1, "x", "y")


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    long_text = " ".join(f"word{i % 977} tail{i}" for i in range(40_000))
    rows = [
        doc(1, None), doc(2, ""), doc(3, " \t\n"), doc(4, long_text), doc(5, "one two three"), doc(6, "One  two THREE"), doc(6, "One  two THREE"),
        doc(None, "no id here at all"), doc(None, "no id here at all"), doc(7, "a b c d e f g", None, None), doc(8, "é\U0001f600 ß", "de", "src1"),
        doc(9, "token = 'abcdefABCDEF012345' and deadbeefdeadbeef00", "fr", "src2"), (None,) * 12,
    ]
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DDL)
