"""Text column functions: scripts, words before tokenisation, stop strings, commands, templates and leak patterns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import strip

# Languages that have a Unicode block of their own, in the order that decides ties, and the other ones.
SCRIPT_RANGES = (("kan", 0x0C80, 0x0CFF), ("tam", 0x0B80, 0x0BFF), ("tel", 0x0C00, 0x0C7F), ("mal", 0x0D00, 0x0D7F))
DEFAULT_LANGUAGE = "eng"
LANGUAGES = ("kan", "tam", "tel", "mal", "eng", "tcy", "kff", "kxv", "nit")

# Fixed value: the pattern that splits text into words before tokenisation; marks and joiners stay with their letters.
PRETOKEN = r"'(?i:[sdmt]|ll|ve|re)| ?[\p{L}\p{M}‌‍]+|\p{N}| ?[^\s\p{L}\p{M}\p{N}‌‍]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"

# Labels and patterns of text that should not be public.
LEAK_PATTERNS = (
    ("windows path", r"(?<![A-Za-z])[A-Za-z]:\\{1,2}[A-Za-z_.]"),
    ("file url", r"(?i)file:///"),
    ("user home", r"(?i)[\\/]Users[\\/][^\\/\s]+"),
    ("personal mail", r"(?i)[A-Za-z0-9._%+-]+@(gmail|outlook|hotmail|yahoo|proton)\."),
)
# What a text must hold, in lower case, for a pattern to match: cheap to look for before a pattern runs.
LEAK_GATES = {"windows path": (":\\",), "file url": ("file:///",), "user home": ("users",), "personal mail": ("@gmail.", "@outlook.", "@hotmail.", "@yahoo.", "@proton.")}
BINARY_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".woff", ".woff2", ".ttf")
MAX_SCAN_BYTES = 8 * 1024 * 1024
PRIVATE_PREFIXES = ("private/", ".claude/")


def script_counts(text: Column) -> dict[str, Column]:
    """Characters of each script's block."""
    return {code: F.length(text) - F.length(F.regexp_replace(text, f"[\\x{{{lo:04X}}}-\\x{{{hi:04X}}}]", "")) for code, lo, hi in SCRIPT_RANGES}


def detect_language(text: Column) -> Column:
    """The language whose script is most frequent; ties go to the first in the list, no script to the default."""
    ranked = [F.struct(n.alias("n"), F.lit(-i).alias("first"), F.lit(code).alias("lang")) for i, (code, n) in enumerate(script_counts(text).items())]
    best = F.array_max(F.array(*ranked))
    return F.when(best["n"] > 0, best["lang"]).otherwise(F.lit(DEFAULT_LANGUAGE))


def pretokens(text: Column) -> Column:
    """The words of a text, in order; joined they give the text back. (?U) makes white space that of Unicode."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PRETOKEN), F.lit(0))


def nfc(text: Column) -> Column:
    """Canonical composition. Spark has no built-in for it, so this is an Arrow-batched function."""
    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    return composed(text)


def cut_at_stops(text: Column, stops: Sequence[str]) -> Column:
    """The text before the first occurrence of any stop string; empty stops do not count."""
    for stop in stops:
        if stop:
            text = F.substring_index(text, stop, 1)
    return text


def split_list(text: Column, by: str = ",") -> Column:
    """Parts of a list without white space around them and without empty ones."""
    return F.filter(F.transform(F.split(text, by), strip), lambda x: x != "")


def parse_command(line: Column) -> tuple[Column, Column, Column]:
    """(command, argument, message) of an input line: /lang code, /auto, /new, /code text, or a message.

    The command is 'message', 'lang', 'auto', 'new', 'once' (one message in a language, the argument) or 'unknown'. White
    space of any kind is cut at both ends; only a space ends the command's word.
    """
    clean = strip(line)
    body = F.substring(clean, 2, 2**31 - 1)
    word = F.substring_index(body, " ", 1)
    rest = strip(F.substring(body, F.length(word) + 2, F.length(body)))
    is_lang = (word == "lang") & rest.isin(*LANGUAGES, "auto")
    is_once = word.isin(*LANGUAGES) & (rest != "")
    command = F.when(~clean.startswith("/"), "message").when(is_lang, "lang").when(word.isin("auto", "new"), word).when(is_once, "once").otherwise("unknown")
    argument = F.when(is_lang, rest).when(is_once, word)
    return command, argument, F.when(~clean.startswith("/"), clean).when(is_once, rest)


def user_turn(message: Column, lang: Column) -> Column:
    """A user message ready for the reply that follows it."""
    return F.concat(F.lit("<|user|><"), lang, F.lit("> "), message, F.lit(" <|assistant|>"))


def base_prompt(message: Column, lang: Column) -> Column:
    """The same without turn markers."""
    return F.concat(F.lit("<"), lang, F.lit("> "), message)


def redact(command: Column, path: str) -> Column:
    return F.replace(command, F.lit(path), F.lit("<checkpoint>"))


def run_label(tasks: Column, limit: Column) -> Column:
    """Tasks joined by +, cut to 80 characters; a limited run is marked as a smoke test."""
    label = F.left(tasks, F.lit(80))
    return F.when(F.coalesce(limit, F.lit(0)) > 0, F.concat(F.lit("SMOKE-limit"), limit.cast("string"), F.lit("-"), label)).otherwise(label)


def word_pattern(words: Sequence[str]) -> str | None:
    """One pattern for whole words of a list, in any case."""
    import re

    quoted = [re.escape(w) for w in words if w]
    return r"(?i)\b(" + "|".join(quoted) + r")\b" if quoted else None


def scan_lines(files: DataFrame, path: str, text: str, words: Sequence[str] = (), private: Sequence[str] = PRIVATE_PREFIXES) -> DataFrame:
    """(path, line, label, excerpt) of every line and pattern that matches, and of every file with a private prefix.

    Binary suffixes and files over 8 MiB are passed over. Patterns are a few literals, so a line meets them in one
    projection and not in a join; only files and lines that hold what a pattern needs are cut into lines and matched.
    """
    gates = LEAK_GATES | {"blocked name": tuple(w.lower() for w in words if w)}

    def may_hold(c: Column, label: str) -> Column:
        return reduce(or_, [F.lower(c).contains(x) for x in gates[label]])

    name = F.col(path)
    hidden = F.lit(False)
    for prefix in private:
        hidden = hidden | name.startswith(prefix)
    binary = F.lower(name).rlike("(" + "|".join(s.replace(".", r"\.") for s in BINARY_SUFFIXES) + ")$")
    patterns = [*LEAK_PATTERNS, *([("blocked name", p)] if (p := word_pattern(words)) else [])]
    flagged = files.where(hidden).select(name.alias("path"), F.lit(0).alias("line"), F.lit("private file").alias("label"), F.lit("").alias("excerpt"))
    some = reduce(or_, [may_hold(F.col(text), label) for label, _ in patterns])
    lines = files.where(~hidden & ~binary & (F.octet_length(text) <= MAX_SCAN_BYTES) & some).select(name.alias("path"), F.posexplode(F.split(F.col(text), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")).alias("line", "_text"))
    hits = F.filter(F.array(*[F.when(may_hold(F.col("_text"), label) & F.col("_text").rlike(p), F.lit(label)) for label, p in patterns]), lambda x: x.isNotNull())
    found = lines.select("path", (F.col("line") + 1).alias("line"), F.explode(hits).alias("label"), F.left(strip(F.col("_text")), F.lit(120)).alias("excerpt"))
    return flagged.unionByName(found)
