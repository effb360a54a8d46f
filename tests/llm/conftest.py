import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, node string, band long, label int, "
          "class_id long, row_ string, y double, weight double, range_ int, copy_ int, score double, first long")
LONG = " ".join(f"word{i % 4000}x{i}" for i in range(40_000))
PROSE = "the quick brown fox jumps over a lazy dog near one quiet river while seven small boats drift past slowly. "


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    texts = [None, "", " ", "\n\n", "a", PROSE * 3, PROSE * 3, PROSE * 3, LONG, LONG + " tail", "a\nb\nc\na\nb\nc", "x  y \t z",
             "password=b7db7aa4a5fcc78305 é 五六 ▁ 😀", "a b c a b c a b c"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, PROSE * 3), (5, PROSE * 3), (5, "another text of the same id"), (None, PROSE * 3), (None, None), (None, "lone")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame([(i, t, None, "s", None, "n", 1, 0, 7, "r", .5, .1, 3, 1, None, 9) for i, t in odd_rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return dict(documents.select("doc_id", "text").collect())
