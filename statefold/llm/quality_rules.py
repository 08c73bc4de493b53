"""Quality rules: a threshold table compiled into one projection, without user functions.

All counts come from whole texts through JVM expressions, row by row: no shuffle, no Python. Rules compare integers
(100 * part against percent * whole), so results do not depend on floating point.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: white space of a word boundary, and the symbols that count.
SPACES = " \t\n\u000b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

# Common function words of the languages the rules know (en, de, es, fr).
STOP_WORDS = sorted(
    set(
        """the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when
        der die das und in zu den nicht von sie ist des sich mit dem ein eine auf für im als auch es an er so dass
        de la que el en y a los se del las un por con no una su para al lo como más pero sus le
        et les des est une dans pour qui au sur pas plus par je avec tout faire son mettre autre on mais nous comme ou""".split()
    )
)


class Rule(NamedTuple):
    """A text fails if 100 * part exceeds percent * whole, or, with ``below``, if it is less."""

    name: str
    part: str
    whole: str
    percent: int
    below: bool = False


#: part and whole name measures of ``measured``; ``one`` is the constant 1, so that percent / 100 is a count.
RULES = (
    Rule("too_short", "n_words", "one", 5000, below=True),
    Rule("repeated_words", "n_repeat_words", "n_words", 50),
    Rule("symbols", "n_symbols", "n_words", 25),
    Rule("word_too_long", "word_chars", "n_words", 1500),
    Rule("word_too_short", "word_chars", "n_words", 200, below=True),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 50),
    Rule("no_stop_words", "n_stop_words", "n_words", 1, below=True),
)


def measured(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the measures, all long. Null and empty texts have zero everywhere.

    Measures: n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_stop_words.
    Staged selects keep each costly array single: an array that several expressions read is made once.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    own = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    kept = [f"_keep{i}" for i in range(len(own))]
    lines = F.expr(f"filter(split(_text, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')")
    one = docs.select(*own, whole.alias("_text"), F.btrim(whole, F.lit(SPACES)).alias("_trim"))
    two = one.select(
        *kept,
        F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", SPACE_CLASS + "+", -1)).alias("_w"),
        lines.alias("_l"),
        F.length(F.translate("_trim", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    # Equal windows have equal hashes, so texts without a repeated hash, nearly all, need no exact comparison.
    hashes = F.expr("slice(transform(_w, (x, i) -> xxhash64(x, get(_w, i + 1), get(_w, i + 2))), 1, greatest(size(_w) - 2, 0))")
    three = two.select(
        *kept,
        "word_chars",
        "n_symbols",
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        hashes.alias("_h"),
    )
    # Starts of windows whose words recur, in text order: sort windows by their words, keep those equal to a neighbour.
    four = three.select(
        *kept, *[c for c in three.columns if c[0] != "_"], F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.expr("array_sort(transform(slice(_w, 1, size(_w) - 2), (x, i) -> struct(concat_ws(' ', x, _w[i + 1], _w[i + 2]) as t, i as i)))")).alias("_t")
    )
    starts = F.expr("array_sort(transform(filter(_t, (x, i) -> x.t <=> get(_t, i - 1).t or x.t <=> get(_t, i + 1).t), x -> x.i))")
    five = four.withColumn("_s", starts).drop("_t")
    covered = F.expr("aggregate(transform(_s, (x, i) -> cast(least(3, coalesce(get(_s, i + 1) - x, 3)) as bigint)), 0L, (a, x) -> a + x)")
    done = five.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_s")
    # A filter on a measure would be pushed below the staged selects, with every array copied into it over and over. A row
    # number in the way stops it here, as Spark moves no filter past an expression that is not deterministic.
    names = [c for c in done.columns if c not in kept]
    out = done.select(*kept, F.when(F.monotonically_increasing_id() >= 0, F.struct(*names)).alias("_m")).select(*kept, "_m.*")
    return out.withColumnsRenamed({f"_keep{i}": c for i, c in enumerate(keep)})


def failing(rule: Rule) -> Column:
    """True where a text fails the rule, from the measures alone."""
    whole = F.lit(1) if rule.whole == "one" else F.col(rule.whole)
    left, right = 100 * F.col(rule.part), rule.percent * whole
    return left < right if rule.below else left > right


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Measures, one boolean ``fails_<rule>`` for each row of the table, base_failed and kept, in one projection.

    Null texts have no words. Texts are measured whole, whatever their length; a measure at its threshold passes.
    base_failed: fewer than 50 words, or over half of them in repeated windows. kept: no rule fails. An empty table
    gives an empty result; repeated rows each get their verdict; other columns of docs are not read.
    """
    m = measured(docs, text, keep)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    any_fail = base
    for rule in rules:
        any_fail = any_fail | failing(rule)
    return m.select("*", *[failing(r).alias(f"fails_{r.name}") for r in rules], base.alias("base_failed"), (~any_fail).alias("kept"))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    own = [f"_c{i}" for i in range(len(docs.columns))]
    safe = docs.withColumnsRenamed(dict(zip(docs.columns, own, strict=True)))
    kept = judged(safe, rules, own[docs.columns.index(text)], own).where("kept")
    return kept.select(*[F.col(c).alias(name) for c, name in zip(own, docs.columns, strict=True)])
