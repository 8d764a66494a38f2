import pytest

#: Names that the operators use inside.
CLASHES = "ids string, row int, digest string, kept string, node int, h int, n int, label string, spans string, score string, range int, key int, base string, words string, c int, predicted string"


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows):
        """doc_id, text and columns whose names clash with the operators' own."""
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.selectExpr("*", *[f"CAST(NULL AS {x.split()[1]}) AS {x.split()[0]}" for x in CLASHES.split(", ")])

    return docs


LONG = " ".join(f"word{k % 997}" for k in range(60_000))


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty, white and very long texts, repeated rows, ties, other alphabets."""
    return make([(1, None), (2, ""), (3, " \n\t "), (4, LONG), (4, LONG), (None, "no id here"), (5, "no id here"), (6, "x"), (7, "é漢字🙂 İ ß"), (None, None), (8, "a" * 30_000)])


@pytest.fixture(scope="session")
def empty(make):
    return make([(0, "x")]).limit(0)
