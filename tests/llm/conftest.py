import pytest

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n \t",
    "one",
    "two words",
    "x" * 300,
    "ab" * 400,
    "word " * 400,
    "é̀ ß 😀   ▁ İ ΟΔΟΣ <|endoftext|> <s>",
    "line of text one\n" * 30,
    "\x00 \x0b\x0c\r\n",
    ("The quick brown fox jumps over the lazy dog while it rains in the garden of the house. " * 3).strip(),
]


@pytest.fixture(scope="session")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return lambda name: str(public.path(name))


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with distinct ids, twice each, and columns whose names clash with results."""
    rows = [(i, t, 1, "z", "q") for i, t in enumerate(ODD_TEXTS + ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, kept string, start string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
