"""Small tables with every awkward row: nulls in any column, empty and long texts, ties, repeated rows, extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n_words int, _row string"
LONG = "lorem ipsum dolor sit amet the and of " * 3000
ROWS = [
    (1, None, "en", "a", 0, "x", 1, "r"),
    (2, "", "en", "a", 0, None, 1, "r"),
    (3, "the cat and the dog are in the house of the king\nsecond line", None, "b", 5, "x", None, None),
    (3, "the cat and the dog are in the house of the king\nsecond line", None, "b", 5, "x", None, None),
    (4, "The cat and the dog are in the house of the king second line", "fr", None, None, "x", 1, "r"),
    (None, "one two three", "de", "b", 13, "x", 1, "r"),
    (5, LONG, "en", "b", len(LONG), "x", 1, "r"),
    (6, " \t\n", "", "", 3, "x", 1, "r"),
    (7, "naïve “text” with ▁ and 日本語 😀\n\n<|im_end|>", "en", "a", 9, "x", 1, "r"),
]


def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
