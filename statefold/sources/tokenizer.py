"""Tokenizer files: ids and texts in Arrow batches, and ids of named special tokens."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens with a meaning of their own, besides one for each language.
END, PAD, USER, ASSISTANT, SYSTEM = "<|endoftext|>", "<|pad|>", "<|user|>", "<|assistant|>", "<|system|>"

_LOADED: dict[str, object] = {}


def load_tokenizer(path: str):
    """The tokenizer of a file, kept for the life of a process; the file must be at the same path on every executor."""
    from tokenizers import Tokenizer

    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def encoded(text: Column, path: str) -> Column:
    """array<int> of ids without special tokens; null for null."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load_tokenizer(path)
        for s in batches:
            out: list = [None] * len(s)
            for at in range(0, len(s), 256):  # encodings are large: a few texts at a time
                part = s.iloc[at : at + 256]
                some = [i for i, t in enumerate(part) if t is not None]
                for i, e in zip(some, tokenizer.encode_batch([part.iloc[i] for i in some], add_special_tokens=False), strict=True):
                    out[at + i] = e.ids
            yield pd.Series(out, index=s.index)

    return run(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of ids, special tokens left out; null for null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load_tokenizer(path)
        for s in batches:
            yield pd.Series([None if x is None else tokenizer.decode([int(t) for t in x], skip_special_tokens=True) for x in s], index=s.index, dtype=object)

    return run(ids)


def special_id(name: Column, vocabulary: dict[str, int], names: Sequence[str] | None = None) -> Column:
    """The id of a special token by its name; a query fails on one that the vocabulary lacks."""
    known = {k: v for k, v in vocabulary.items() if names is None or k in names}
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(int(v)))]) if known else F.create_map().cast("map<string,int>")
    return F.coalesce(F.element_at(table, name), F.raise_error(F.concat(F.lit("unknown special token "), name)).cast("int"))


def turn_ids(df: DataFrame, message: str, lang: str, vocabulary: dict[str, int], out: str = "ids") -> DataFrame:
    """df with the ids of a user turn: user, language, message ids, assistant."""
    head = F.array(special_id(F.lit(USER), vocabulary), special_id(F.concat(F.lit("<"), F.col(lang), F.lit(">")), vocabulary))
    return df.withColumn(out, F.concat(head, F.col(message), F.array(special_id(F.lit(ASSISTANT), vocabulary))))
