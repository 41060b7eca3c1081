import pytest

#: Null, empty, blank, tied, repeated and very long texts.
TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "one",
    "One two three four",
    "a b c d e f g h i j",
    "a b c d e f g h i j",
    "A b c d e f g h i j k",
    "été naïve word 漢字 \U0001f600 x\x00y  z",
    "call +1 (988) 555-2485 or mail bob.42@mail8.example.com at 42.144.35.254 card 4111 1111 1111 1111.",
    "w" * 70_000,
    "rep " * 3_000,
    " ".join(f"long{i}" for i in range(150_000)),
]


@pytest.fixture
def docs(spark):
    """Odd documents, with a repeated row, a null id and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", None, None, "x", 1) for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], "en", None, None, "y", 2), (None, "one two", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, chunk int")


@pytest.fixture
def folder(docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.fixture
def empty(docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    return f"{tmp_path}/empty"
