import pytest

from probefleet.llm.workspace import ready

WORDS = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="session")
def spark(spark):
    return ready(spark)


@pytest.fixture(scope="session")
def corpus(spark):
    """The documents of the smallest test data."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, several alphabets, columns with clashing names."""
    long_text = " ".join(f"w{i * i % 997}" for i in range(30_000))
    line = "one two three four five six seven eight nine ten eleven"
    rows = [
        (1, None, "en"),
        (2, "", None),
        (3, " \t\n\r ", "fr"),
        (4, "word", "en"),
        (5, f"{line}\n{line}\n\n \n{line} ", "en"),
        (5, f"{line}\n{line}\n\n \n{line} ", "en"),
        (6, long_text, "en"),
        (7, "x" * 50_000, "en"),
        (8, "日本語 のテキスト。 日本語 のテキスト。 ###", "ja"),
        (9, " nbsp wide\x0bvertical\x0cform", None),
        (10, "a b c d e a b c d e f g", "en"),
        (None, "no id here but a few words to read on", "en"),
        (11, "<|endoftext|> special  <|endoftext|>", "en"),
        (12, "12345 67890", "de"),
        (13, "É", "fr"),
    ]
    schema = "doc_id long, text string, lang string"
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr(
        "doc_id", "text", "lang", "'s' source", "cast(length(text) as long) n_chars", "1 as n_words", "'x' as score", "0 as key"
    )
