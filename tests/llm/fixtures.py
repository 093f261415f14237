"""Small document tables with every kind of odd row."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone quiet amber ladder winter copper meadow signal harbor lantern thistle orbit velvet canyon ember willow".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "er", "ing"]) for _ in range(n))


def odd_rows():
    """Null and empty texts, a null id, exact copies, repeated rows, a repeated id with another text, a long text."""
    a, b = prose(1, 120), prose(2, 90)
    return [
        (1, a, "en", "s", len(a)),
        (2, None, None, None, None),
        (3, "", "en", "s", 0),
        (4, a, "en", "s", len(a)),
        (4, a, "en", "s", len(a)),
        (5, b, "en", None, len(b)),
        (5, prose(3, 60), "en", "s", 1),
        (None, a, "en", "s", len(a)),
        (6, "!!! --- ...", None, "s", 11),
        (7, "one two", "en", "s", 7),
        (8, prose(4, 20000), "en", "s", 1),
        (9, b + " " + prose(5, 4), "en", "s", 1),
        (10, "é日本🎉 " + b[:200], "fr", "s", 1),
    ]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
