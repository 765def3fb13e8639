"""Small tables with the cases that every operator has to stand."""

PROSE = (
    "The river that ran past the old mill was low that year, and the boys of the town would wade across it in the "
    "evening with their shoes in their hands, talking of the fair and of the horses that were to come for it. "
)
LONG = " ".join(f"word{i % 977} of{i % 31} the{i % 7}" for i in range(30_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, hits string, spans string, carried string, node string"


def documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that clash with results."""
    rows = [
        (1, PROSE * 3, "en"), (2, PROSE * 3, "en"), (3, None, "en"), (4, "", None), (None, PROSE, "xx"), (6, LONG, "en"),
        (7, " \t\n\x0b\x0c\r ", "de"), (8, "one two", "fr"), (8, "one two", "fr"), (10, "x" * 120_000, "es"), (11, "ab " * 20_000, "en"),
        (12, "\x01\x02\x03\x04 é中\U0001f600 Straße", "de"), (13, PROSE * 3 + "One more sentence stands at the end here.", "en"), (None, None, None),
    ]
    return spark.createDataFrame([(i, t, lang, None, None, "n", None, "s", None, "v") for i, t, lang in rows], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
