"""Best-fit packing of tokenised documents by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. Which lengths share a sequence depends on how many pieces have
each length alone, at most ``capacity`` numbers at any corpus size, so the bins are planned on the driver: for each bin, a
bitset subset-sum over the available lengths finds the fullest feasible combination, which is then removed. The plan
maps (length, rank among pieces of that length) to a place, and pieces look their place up without a join.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .ranking import gapless_rank

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
END_ID = 0

# Characters for which the standard library's classes and the tokenizer's agree: printable ASCII, line feed, Latin letters.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(f"[\\n -~{_LETTERS}]*")
# Fixed value: the word pattern of byte-level pre-tokenisation, with letters and digits written out for those characters.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_CACHED_WORDS = 400_000
_BATCH_CHARS = 2_000_000


class WordCachedBpe:
    """Token ids of the tokenizers library, as little-endian unsigned 32-bit bytes, with a bounded cache of words.

    A byte-level tokenizer without a normaliser encodes each word of its pattern alone, so a text's ids are its words' ids
    in a row. Texts with other characters, or with what may be a special token, go to the library whole: the same ids.
    """

    def __init__(self, path: str) -> None:
        import json

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.special = [t["content"][:2] for t in spec.get("added_tokens", ())]
        self.words: dict[str, bytes] = {}
        # The model alone, for words that need no parting: their bytes as the characters that a byte-level vocabulary has for
        # them, printable bytes as themselves and the others, in order, from code point 256 on.
        self.bare = Tokenizer(self.library.model)
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [x for x in range(256) if x not in shown]
        self.characters = {x: chr(x) for x in shown} | {x: chr(256 + i) for i, x in enumerate(hidden)}

    def _apart(self, words: list[str]) -> list[bytes]:
        """Ids of words without a line feed, each a whole word of the pattern."""
        mapped = "\n".join(words).encode().decode("latin-1").translate(self.characters).split(self.characters[10])
        return [array("I", e.ids).tobytes() for e in self.bare.encode_batch_fast(mapped, add_special_tokens=False)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def ids(self, texts: Sequence[str]) -> Iterator[bytes]:
        """The texts' ids, in order; texts of up to _BATCH_CHARS characters together are split into words at once."""
        batch: list[str] = []
        size = 0
        for t in texts:
            batch.append(t)
            size += len(t)
            if size >= _BATCH_CHARS:
                yield from self._batch(batch)
                batch, size = [], 0
        yield from self._batch(batch)

    def _batch(self, texts: list[str]) -> list[bytes]:
        plain = [self.by_word and not any(s in t for s in self.special) and _PLAIN.fullmatch(t) is not None for t in texts]
        split = [_WORDS.findall(t) if p else None for t, p in zip(texts, plain, strict=True)]
        known = self.words
        new = list(set(chain.from_iterable(w for w in split if w)).difference(known))
        other = [w for w in new if not w.isspace()]
        if other:
            known.update(zip(other, self._apart(other), strict=True))
        blank = [w for w in new if w.isspace()]
        known.update(zip(blank, self._whole(blank), strict=True))
        out = [b"".join(map(known.__getitem__, w)) if w is not None else self._whole([t])[0] for t, w in zip(texts, split, strict=True)]
        if len(known) > _CACHED_WORDS:  # a full cache keeps its words, as common ones come early, and forgets the batch's
            for w in new:
                del known[w]
        return out


_READY: dict[str, WordCachedBpe] = {}


def word_cached(path: str) -> WordCachedBpe:
    """The tokenizer of a Python worker, which keeps it and its words from task to task."""
    if path not in _READY:
        _READY.clear()
        _READY[path] = WordCachedBpe(path)
    return _READY[path]


def cut_points(length: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document: whole up to the capacity, else full pieces after a first that may be shorter."""
    return [0] if length <= capacity else [0, *range(length % capacity or capacity, length, capacity)]


_PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str = BYTE_BPE, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids array<bigint>]): the pieces of every document, in a row for each.

    A document is its text's ids (null: none) and then end_id, so an empty one is a piece of length 1. ids_crc32 is of the
    ids as little-endian unsigned 32-bit integers. Only documents over the capacity are cut.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    end = np.array([end_id], "<u4").tobytes()
    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores already have a worker each
        bpe = word_cached(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows: list[tuple] = []
                for i, ids in enumerate(bpe.ids([t or "" for t in part.column(1).to_pylist()])):
                    raw = memoryview(ids + end)
                    n = len(raw) // 4
                    starts = cut_points(n, capacity)
                    for p, (a, z) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        rows.append((i, p, a, z - a, zlib.crc32(raw[4 * a : 4 * z]), *([np.frombuffer(raw[4 * a : 4 * z], "<u4").astype(np.int64)] if with_ids else [])))
                cols = list(zip(*rows, strict=True))
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0])), *[pa.array(c, t) for c, t in zip(cols[1:], types, strict=False)]], names=[key, *names])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, {_PIECE}" + ", ids array<bigint>" * with_ids
    return docs.select(key, F.col(text).alias("_text")).mapInArrow(cut_batches, schema)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, with repeats as far as counts go, whose sum is the largest that fits into room.

    reach has bit s set if some combination has sum s. Lengths join from the longest down, and the search ends once room
    itself is reached, so short lengths stay for bins that need them.
    """
    reach, layers, window = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        layers.append((length, reach))
        more = reach
        for _ in range(min(counts[length], room // length)):
            grown = more | (more << length) & window
            if grown == more:
                break
            more = grown
        reach = more
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(layers):
        while not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths): bins that together use every length exactly as often as counts says.

    Each bin starts with the longest length left and is filled with the fullest combination of the others. A combination
    repeats for as many bins as its lengths allow, so the plan's size follows the number of lengths, not of pieces.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    if left and max(left) > capacity:
        raise ValueError("a piece is longer than the capacity")
    bins = []
    while left:
        first = max(left)
        left[first] -= 1
        rest = fullest({x: n for x, n in left.items() if n}, capacity - first)
        left[first] += 1
        lengths = [first, *rest]
        uses = {x: lengths.count(x) for x in set(lengths)}
        times = min(left[x] // n for x, n in uses.items())
        for x, n in uses.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        bins.append((times, lengths))
    return bins


def places(bins: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 40 | first rank), and the sequence and offset of the piece with that rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in bins:
        offset = 0
        for x in lengths:
            rows.append((x << 40 | used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()


def pack(parts: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """parts (with key, piece, length) and sequence_id, offset: a gapless place in a sequence for every piece.

    Ranks within a length come from ``gapless_rank``: a length that most pieces have spreads over tasks. Repeated rows
    are pieces of their own; an empty table gives an empty result.
    """
    ranked = gapless_rank(parts, ["length"], [key, "piece"], "_rank")
    sizes = ranked.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in sizes.collect()}  # at most ``capacity`` rows
    at, sequence, offset = places(plan_bins(counts, capacity))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            i = np.searchsorted(at, length << 40 | rank, side="right") - 1
            own = [b.column(c) for c in parts_columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence[i] + rank - (at[i] & ((1 << 40) - 1))), pa.array(offset[i])], names=[*parts_columns, "sequence_id", "offset"])

    parts_columns = parts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(placed, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str = BYTE_BPE, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of each document: its place in a sequence.

    Null texts are empty: one piece, the end token. A null key is a key; repeated rows are documents of their own; pieces of
    one length take places by key and piece, and equal rows in any order. A long text is encoded whole and cut into pieces. An
    empty table gives an empty result. Other columns are not read.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id, key, text), capacity, key)


def sequences(docs: DataFrame, **how) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves. A group is one sequence, of at most ``capacity`` ids."""
    parts = pieces(docs, with_ids=True, **how)
    packed = pack(parts, how.get("capacity", CAPACITY), how.get("key", "doc_id"))
    ordered = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return ordered.select("sequence_id", F.flatten(F.transform("_p", lambda p: p.ids)).alias("ids"))
