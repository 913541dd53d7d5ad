import pytest

LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = [None, "", "   \n\t ", "a", "Hello, world! it's 42", "the same text\nthe same text", "the same text\nthe same text", LONG, "é ñ ß 漢字 \x1c <|endoftext|> <s>", "x" * 3000]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls everywhere, repeated rows, empty and long texts, columns named as outputs are."""
    rows = [(i, t, None if i % 3 == 0 else "en", "src", 1, 0.5, True, "x", "y") for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "en", None, None, None, None, None, None), (None, "no id", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, score double, kept boolean, fp string, row string")


@pytest.fixture(scope="session")
def empty(messy):
    return messy.filter("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def by_id(df, id_col="doc_id"):
    """Rows by id; repeated ids must agree in everything."""
    out = {}
    for r in df.collect():
        assert out.setdefault(r[id_col], r) == r
    return out
