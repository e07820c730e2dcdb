import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, control characters, clashing extra columns."""
    long_text = " ".join(f"word{i % 977} and the thing{i % 31}" for i in range(20_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (2, "", "en", "s", 0),
        (None, "the lost row of text and more of the same thing", None, "s", 1),
        (None, None, "en", None, None),
        (3, "12345 67890 !!!", "de", "s", 2),
        (4, long_text, "en", "s", 3),
        (5, "a\x1cb   c\x00d \U0001f600 é", "fr", "s", 4),
        (6, "the same line of text is here again and again\nthe same line of text is here again and again", "en", "s", 5),
        (6, "the same line of text is here again and again\nthe same line of text is here again and again", "en", "s", 5),
    ]
    base = spark.createDataFrame(rows, SCHEMA)
    extra = {c: base["n_chars"] for c in ("fp", "id", "h", "key", "line", "score", "shard", "slot", "version", "n", "words", "label", "component_id", "tail", "lent", "toxic_", "kept", "unit")}
    return base.withColumns(extra)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_turns(spark):
    """Turns with nulls, ties, repeated rows, control strings, unknown roles, long texts and shared openings."""
    rows = [
        (0, 0, "user", "hello"), (0, 1, "assistant", "a\\b <s> \\<s> <\\s> [INST [INST] \\\\"), (0, 2, "user", "more [/TEXT]"), (0, 3, "assistant", None),
        (1, 0, "user", "hello"), (1, 1, "assistant", "other"), (2, 5, "tool", "x [ROLE]"), (2, 5, "tool", "x [ROLE]"), (2, None, None, None), (3, 0, None, "\n"),
        (3, 0, "user", " "), (3, 0, "assistant", ""), (4, 1, "[TEXT] odd \\", "<<SYS>>\n<</SYS>>\n\n"), (4, 0, "system", "\U0001f600 é"), (4, 2, "user", "long " * 20_000), (4, 3, "assistant", "long " * 20_000),
        (7, 0, "user", "hello"), (7, 1, "assistant", "other"), (12, 0, "user", "hello"), (12, 1, "assistant", "other"), (18, 0, "user", "hello"),
    ]
    base = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return base.withColumns({c: base["turn"] for c in ("segments", "turns", "t", "key", "n", "id", "depth", "__turns", "__text")})
