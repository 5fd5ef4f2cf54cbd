import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, length long, offset long, size long, fp long, first long, digest string, held_out boolean, taken string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like operators' own."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    long = " ".join(f"{w}{k}" for k in range(3000) for w in word[:9])
    texts = [None, "", "   \n\t", "one", "One ONE", " ".join(word), " ".join(word), " ".join(reversed(word)), long, "ünïcödé \x00 \x1c 🙂 ñandú", "a" * 50_000, "<|endoftext|> <b>&amp;"]
    rows = [(k, t, ("en", "fr", None)[k % 3], ("a", "b", None, "")[k % 4], None if t is None else len(t), 7, 7, 7, 7, 7, "x", None, "y") for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "null id text here", None, None, 3, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session", autouse=True)
def a_key(spark):
    spark.conf.set("spark.spanwise.pii.key", "only for tests")
