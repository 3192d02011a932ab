import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sample(spark):
    """Documents with nulls, empty and long texts, copies and clashing columns."""
    texts = [
        "The quick brown fox jumps over the lazy dog again.\nIt was there for the summer.",
        "The quick brown fox jumps over the lazy dog again.\nIt was there for the summer.",
        None,
        "",
        "   \n\t ",
        "12345 678",
        "un día muy largo en la casa de la montaña\ncon los niños del pueblo",
        "ein langer Tag in dem Haus auf dem Berg mit den Kindern",
        "word " * 60_000,
        "x" * 200_000,
        "The The The Of Of Of",
        "日本語のテキスト 😀",
    ]
    rows = [(i, t, "es" if i == 6 else "de" if i == 7 else "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(0, texts[0], "en", "s", 1), (None, texts[0], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as score", "1 as shard", "2 as component_id", "3 as n_words", "'k' as keys", "4 as held_out")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
