"""Small tables with the odd cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, label string"

COMMON = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the deep dark wood"


def rows():
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that operators use."""
    long = " ".join(f"word{i % 977}" for i in range(20_000))
    return [
        (1, COMMON, "en", "a", 1, "x", "y"),
        (2, COMMON, "en", "b", 1, "x", "y"),
        (3, COMMON.upper(), "en", None, 1, "x", None),
        (4, None, None, "a", None, None, None),
        (5, "", "de", "b", 0, "", ""),
        (6, " \t\n ", "de", "b", 0, "", ""),
        (7, long, "en", "a", 1, "x", "y"),
        (7, long, "en", "a", 1, "x", "y"),
        (8, "one two", "fr", "c", 1, "x", "y"),
        (9, "été à l’école <|endoftext|> naïve cóte 12'34 don't", "fr", "c", 1, "x", "y"),
        (10, COMMON + " tail", "en", "é", 1, "x", "y"),
    ]
