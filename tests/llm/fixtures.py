"""Small documents with every awkward case, and words as the contracts define them."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


PROSE = "The and of this to in that was " + " ".join(f"word{i % 37}x{i}" for i in range(70)) + ". Then it is for the end.\nOf the rest."
GERMAN = "Der die das und nicht mit ein " + " ".join(f"wört{i % 31}ung{i}" for i in range(70)) + ".\nSo ist es."


def rows():
    return [
        (1, PROSE, "en", "a", 1),
        (2, PROSE, "en", "a", 1),
        (3, GERMAN, "de", "b", 1),
        (3, GERMAN, "de", "b", 1),
        (4, None, None, None, None),
        (5, "", "en", "", 0),
        (6, " \t\n\x0b\x0c\r ", None, "a", 0),
        (7, "one", "en", "a", 3),
        (8, "Two WORDS", "en", "a", 9),
        (9, "a a a a a a", "en", "c", 11),
        (10, "#tag $5 50% <x> a|b & *", "en", "c", 3),
        (11, "line one here\nline one here\n\nother", "en", "c", 3),
        (12, "日本語 😀 naïve\x85text  x", "fr", "c", 3),
        (None, "no key at all", "en", "c", 3),
        (None, None, "en", "c", 3),
        (-7, "spam! " * 3000, "en", "a", 18000),
        (2**62, " ".join(f"long{i}" for i in range(30000)), "en", "a", 1),
    ]


def documents(spark):
    return spark.createDataFrame(rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(spark):
    """The documents with columns named like those that operators make."""
    from pyspark.sql import functions as F

    extra = ["kept", "score", "size", "shard", "slot", "fp", "_text", "_salt", "_at", "length", "piece", "n_words", "_h", "h", "id", "t", "u", "v", "evidence", "_host", "_path", "_p", "component_id"]
    return documents(spark).select("*", *[F.lit("x").alias(c) for c in extra])


def same(got, expected):
    """Rows as a multiset, null first."""
    key = lambda r: [(x is not None, str(x)) for x in r]
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected), key=key)
