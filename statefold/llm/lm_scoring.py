"""Language-model scoring with a weighted backoff automaton.

Model: word n-grams with hierarchical Dirichlet smoothing. With c a count in the training texts, h a history and h' the
history without its first token,

    P(w)     = (c(w) + 1) / (N + V + 1)                      (V seen types and one for all unseen words)
    P(w | h) = (c(h w) + mu * P(w | h')) / (c(h) + mu)

so every history is a distribution. As an automaton: a history with a count is a state; a seen n-gram is an arc with
log P(w | h); a state's failure arc leads to h' and costs log(mu / (c(h) + mu)); the empty state has an arc for any word.
One pass from left to right carries the state and adds up what its arcs cost.

Data flow, with no table of the vocabulary in one place. Each scan task puts its texts, in the order it reads them, into
chunks of bounded size. A chunk sends each range of n-gram hashes the distinct ones that it has, with their training
counts, and itself, compressed, to the task that will score it. A range adds the counts of all chunks up and sends each
chunk the totals of just the n-grams that it asked for; the chunk builds the part of the automaton that its texts walk on
and scores them. Where chunks are more than ``fan`` ranges can serve, groups of chunks ask for a range together: their
blocks are merged by a node, which asks narrower ranges as a chunk would. So a chunk or node sends ``fan`` rows at most, and rows
grow as n log n with base ``fan``; with the default there is one step up to some 64 GB of text and two up to 500 TB.
N-grams travel as sorted, delta-coded hashes in binary blocks, words by 64 bits and longer ones by 60: a pair of equal
hashes is expected once in about 5 billion distinct words, and once in about 1.5 billion distinct longer n-grams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import pack, pack_sorted, unpack, unpack_sorted

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = 0x9E3779B97F4A7C15  # the end token, and what stands before a text; no word is hashed to them on purpose
BEGIN = 0xC2B2AE3D27D4EB4F
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_CACHED_WORDS = 300_000
_KEPT = np.uint64(2**64 - 16)  # bits of the hashes of two words and more; bits that are zero cost nothing to send


class _Words(dict):
    """Word -> 64-bit hash; keeps the first words that it sees, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < _CACHED_WORDS:
            self[word] = h
        return h


def tokens(text: str | None, words: _Words) -> np.ndarray:
    """Hashes of a text's words, A-Z in lower case, and then of its end."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    out = np.empty(len(found) + 1, np.uint64)
    out[:-1] = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    out[-1] = END
    return out


def is_held_out(doc_id: int | None, modulus: int, remainder: int) -> bool:
    """crc32 of the id as text; a null id is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def _extended(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of the n-gram that is a history and then a word."""
    x = (history ^ (history >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) + word
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 .. order, the n-gram that ends at each token. Before a text stands one begin token; longer ones are cut there."""
    levels = [words]
    for _ in range(1, order):
        before = np.empty_like(words)
        before[0] = BEGIN
        before[1:] = levels[-1][:-1]
        # The n-gram ending at t is the (n-1)-gram ending at t-1 and the word at t.
        levels.append(_extended(before, words))
    return levels


class Chunk:
    """The n-grams of a chunk's texts: distinct sorted keys of each order, and where each token's n-grams stand in them."""

    def __init__(self, texts: Sequence[str | None], order: int) -> None:
        words, parts = _Words(), []
        for t in texts:
            parts.append(tokens(t, words))
        del words
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.lengths)))
        levels = [grams(p, order) for p in parts]
        del parts
        self.keys: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        for n in range(order):
            every = np.concatenate([lv[n] for lv in levels]) if levels else np.empty(0, np.uint64)
            for lv in levels:
                lv[n] = None
            keys, at = np.unique(every & _KEPT if n else every, return_inverse=True)
            self.keys.append(keys)
            self.at.append(at.astype(np.int32))

    def training_counts(self, held: np.ndarray) -> list[np.ndarray]:
        used = ~np.repeat(held, self.lengths)
        return [np.bincount(at[used], minlength=len(k)).astype(np.int64) for k, at in zip(self.keys, self.at, strict=True)]


def _split(keys: np.ndarray, first: int, bits: int) -> list[int]:
    """Where the keys of each of 2**bits ranges begin, by the ``bits`` bits after the ``first`` ones, which all keys share; and the end."""
    if not bits:
        return [0, len(keys)]
    high = np.uint64(int(keys[0]) >> (64 - first) << (64 - first)) if first and len(keys) else np.uint64(0)
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - first - bits)) | high
    return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


def _frame(parts: Sequence[bytes]) -> bytes:
    """Byte strings in one compressed frame: a row of the exchange has one frame, as frames cost bytes of their own."""
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts))


def _parts(frame: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(frame)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum([4 * (n + 1), *np.frombuffer(raw, "<u4", n, 4)]).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _unpack_counts(raw: bytes) -> np.ndarray:
    return unpack(raw).view(np.int64)


def _blocks(asker: int, keys: list[np.ndarray], counts: list[np.ndarray], first: int, bits: int) -> Iterator[tuple]:
    """(range, asker, None, frame of keys and counts of each order) for each range after a prefix that the asker has keys in."""
    cuts = [_split(k, first, bits) for k in keys]
    for r in range(1 << bits):
        parts = [slice(c[r], c[r + 1]) for c in cuts]
        if any(s.stop > s.start for s in parts):
            yield r, asker, None, _frame([pack_sorted(k[s]) for k, s in zip(keys, parts, strict=True)] + [pack(c[s]) for c, s in zip(counts, parts, strict=True)])


def _merged(table: pa.Table, orders: int | None = None) -> tuple[list[np.ndarray], list[np.ndarray], list[list[np.ndarray]]]:
    """Of a group of askers' blocks: distinct keys and summed counts of each order, and where each asker's keys stand in them."""
    frames = [_parts(x.as_py()) for x in table.column("asked")]
    order = len(frames[0]) // 2
    keys, counts, places = [], [], []
    for n in range(orders or order):
        each = [unpack_sorted(x[n]) for x in frames]
        distinct, at = np.unique(np.concatenate(each), return_inverse=True)
        keys.append(distinct)
        # Sums are exact below 2**53.
        counts.append(np.bincount(at, weights=np.concatenate([_unpack_counts(x[order + n]) for x in frames]), minlength=len(distinct)).astype(np.int64))
        places.append(np.split(at, np.cumsum([len(e) for e in each])[:-1]))
    return keys, counts, places


def _told(table: pa.Table, totals: list[np.ndarray], places: list[list[np.ndarray]], r: int) -> Iterator[tuple]:
    """(asker, range, frame of the totals of each order) for each asker of a group."""
    for i, asker in enumerate(table.column("asker").to_pylist()):
        yield asker, r, _frame([pack(t[at[i]]) for t, at in zip(totals, places, strict=True)])


def _blob(part: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_table(part)
    return sink.getvalue().to_pybytes()


def _chunked(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.Table]:
    """The rows in order, in tables of about chunk_bytes of text; a longer text is a table of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("_text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        begin = 0
        while begin < b.num_rows:
            before = int(ends[begin - 1]) if begin else 0
            stop = max(int(np.searchsorted(ends, before + chunk_bytes - size, "right")), begin if held else begin + 1)
            if stop > begin:
                held.append(b.slice(begin, stop - begin))
                size += int(ends[stop - 1]) - before
            if stop < b.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            begin = stop
    if held:
        yield pa.Table.from_batches(held)


class BackoffAutomaton:
    """The part of the automaton that a chunk's texts can walk on.

    ``arc[n][g]`` is log10 of an (n+1)-gram's probability if it was seen, else NaN; ``fail[n][g]`` is the cost of the
    failure arc of the state whose history is the n-gram g; the empty state needs none, as it has an arc for any word.
    """

    def __init__(self, chunk: Chunk, counts: list[np.ndarray], total: int, types: int, texts: int, mu: float) -> None:
        self.order = len(counts)
        unigram = np.log10((counts[0] + 1) / (total + types + 1))
        self.arc = [unigram]
        self.fail = [np.log10(mu / (c + mu)) for c in counts]
        self.begin_fail = float(np.log10(mu / (texts + mu)))
        lower = 10**unigram
        for n in range(1, self.order):
            # Smoothed from the shorter gram's probability at any place where the n-gram stands: it is the same at all.
            at, shorter = chunk.at[n], chunk.at[n - 1]
            begins = np.zeros(len(at), bool)
            begins[chunk.begins[:-1]] = True
            some = np.zeros(len(chunk.keys[n]), np.int64)
            some[at] = np.arange(len(at))
            history = np.where(begins[some], texts, counts[n - 1][shorter[np.maximum(some - 1, 0)]])
            p = (counts[n] + mu * lower[shorter[some]]) / (history + mu)
            lower = p
            self.arc.append(np.where(counts[n] > 0, np.log10(p), np.nan))

    def score(self, arcs: Sequence[Sequence[float]], fails: Sequence[Sequence[float]]) -> float:
        """log10 probability of a text; arcs[n][t] and fails[n][t] are those of the (n+1)-gram that ends at its token t."""
        total, depth, limit = 0.0, 1, self.order  # depth: tokens in the state's history, the begin token included
        for t in range(len(arcs[0])):
            n = depth if depth < limit else limit - 1
            while n and arcs[n][t] != arcs[n][t]:  # NaN: no arc for the word, so fail
                total += fails[n - 1][t - 1] if t else self.begin_fail
                n -= 1
            total += arcs[n][t]
            # The next state is the longest suffix with a count; an unseen word's has none, and fails at no cost.
            depth = n + 1
        return total


def _scored(docs: pa.Table, counts: list[np.ndarray], total: int, types: int, order: int, modulus: int, remainder: int, mu: float, texts: int) -> Iterator[tuple]:
    chunk = Chunk(docs.column("_text").to_pylist(), order)
    model = BackoffAutomaton(chunk, counts, total, types, texts, mu)
    for i, doc_id in enumerate(docs.column("_id").to_pylist()):
        s = slice(chunk.begins[i], chunk.begins[i + 1])
        at = [a[s] for a in chunk.at]
        arcs = [model.arc[n][at[n]].tolist() for n in range(order)]
        fails = [model.fail[n][at[n]].tolist() for n in range(order - 1)]
        known = int((counts[0][at[0]] > 0).sum())
        base = float(model.arc[0][at[0]].sum())
        yield doc_id, is_held_out(doc_id, modulus, remainder), len(at[0]), known, total, base, model.score(arcs, fails)


def _rows(rows: Iterator[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


# A row of the exchange is a chunk on its way to where it is scored (key >= 0, its number; docs), or what an asker asks a
# range for (key < 0).
_SENT = pa.schema([("key", pa.int64()), ("asker", pa.int64()), ("docs", pa.binary()), ("asked", pa.binary())])
_SENT_SQL = "key bigint, asker bigint, docs binary, asked binary"
_ANSWERS = pa.schema([("asker", pa.int64()), ("r", pa.int64()), ("totals", pa.binary())])
_ANSWERS_SQL = "asker bigint, r bigint, totals binary"
_SIZES = pa.schema([("tokens", pa.int64()), ("types", pa.int64())])


def steps_of(chunks: int, fan: int) -> list[int]:
    """Bits by which hashes are divided in each step, 2**bits <= fan in each. In the end there are half as many ranges as
    chunks, and where chunks are few, 64 to 256, so that tasks get several small groups each and not one or two large ones."""
    bits, most = (max(chunks, 1) - 1).bit_length(), max(fan, 2).bit_length() - 1
    bits = max(bits - 1, min(bits + 1, 8), 6)
    n = max(1, -(-bits // most))
    return [bits // n + (i < bits % n) for i in range(n)]


def _key(r: int, group: int, groups: int) -> int:
    return -1 - (r * groups + group)


def exchanged(sent: DataFrame, steps: list[int], first: int = 0, nodes: int = 1) -> tuple[DataFrame, list[DataFrame]]:
    """(answers(asker, r, totals), every exchange's input) for what is ``sent``: rows of _SENT whose negative keys stand for
    the ranges of the first of ``steps``, times ``nodes`` groups of askers unless it is the last."""
    if len(steps) == 1:

        def add_up(t: pa.Table) -> pa.Table:
            if t.column("key")[0].as_py() >= 0:
                return _ANSWERS.empty_table()
            _, counts, places = _merged(t)
            return _rows(_told(t, counts, places, -1 - t.column("key")[0].as_py()), _ANSWERS)

        return sent.groupBy("key").applyInArrow(add_up, _ANSWERS_SQL), [sent]

    done = first + steps[0]
    groups = 1 if len(steps) == 2 else -(-nodes >> steps[1])

    def merge(t: pa.Table) -> pa.Table:
        key = t.column("key")[0].as_py()
        if key >= 0:
            return _SENT.empty_table()
        keys, counts, _ = _merged(t)
        r, group = divmod(-1 - key, nodes)
        rows = ((_key((r << steps[1]) + low, group % groups, groups), *rest) for low, *rest in _blocks(-1 - key, keys, counts, done, steps[1]))
        return _rows(rows, _SENT)

    answers, inputs = exchanged(sent.groupBy("key").applyInArrow(merge, _SENT_SQL), steps[1:], done, groups)

    def pass_on(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return _ANSWERS.empty_table()
        _, _, places = _merged(left)
        key = left.column("key")[0].as_py()
        return _rows(_told(left, _joined(right), places, (-1 - key) // nodes), _ANSWERS)

    back = answers.withColumn("asker", -1 - F.col("asker")).groupBy("asker")
    return sent.groupBy("key").cogroup(back).applyInArrow(pass_on, _ANSWERS_SQL), [sent, *inputs]


def _joined(answers: pa.Table) -> list[np.ndarray]:
    """The totals of all ranges that an asker asked, in the order of its keys."""
    in_order = sorted(zip(answers.column("r").to_pylist(), answers.column("totals").to_pylist(), strict=True), key=lambda x: x[0])
    parts = [_parts(frame) for _, frame in in_order]
    return [np.concatenate([_unpack_counts(p[n]) for p in parts]) for n in range(len(parts[0]))]


def score(docs: DataFrame, order: int = 3, mu: float = 8.0, modulus: int = 7, remainder: int = 2, key: str = "doc_id", text: str = "text", chunk_bytes: int = 8 << 20, fan: int = 4096) -> DataFrame:
    """One row for each row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 throughout).

    Texts whose crc32(key as text) mod ``modulus`` is ``remainder`` are held out of training and scored like all. Null
    texts are empty: one end token. A null key trains. Repeated rows count each time. Without any training text every
    word costs log10(1 / (0 + 0 + 1)) = 0; an empty table gives an empty result. Keys are integers; other columns are not
    read. Sums of equal arcs are equal, so there are no ties to break.

    A chunk holds about ``chunk_bytes`` of text, by place in the scan and not by content, so copies and hot keys are spread
    as they lie. A longer text is a chunk of its own, whole: a task needs some forty times its longest text in memory.
    """
    return _plan(docs, order, mu, modulus, remainder, key, text, chunk_bytes, fan)[0]


def _plan(docs: DataFrame, order: int, mu: float, modulus: int, remainder: int, key: str, text: str, chunk_bytes: int, fan: int) -> tuple[DataFrame, list[DataFrame]]:
    rows = docs.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    held = F.coalesce(F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))
    size, texts = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)) + 1), F.lit(0)), F.coalesce(F.sum((~held).cast("long")), F.lit(0))).first()
    chunks = max(1, -(-int(size) // chunk_bytes))
    steps = steps_of(chunks, fan)
    groups = 1 if len(steps) == 1 else -(-chunks // (1 << steps[0]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, part in enumerate(_chunked(batches, chunk_bytes)):
            number = task << 32 | i
            chunk = Chunk(part.column("_text").to_pylist(), order)
            out = np.array([is_held_out(k, modulus, remainder) for k in part.column("_id").to_pylist()], bool)
            asked = _blocks(number, chunk.keys, chunk.training_counts(out), 0, steps[0])
            group = zlib.crc32(number.to_bytes(8, "little")) % groups
            sent = [(number, number, _blob(part), None), *((_key(r, group, groups), *rest) for r, *rest in asked)]
            yield from _rows(iter(sent), _SENT).to_batches()

    def count(t: pa.Table) -> pa.Table:
        """Training tokens and types of a range."""
        if t.column("key")[0].as_py() >= 0:
            return _SIZES.empty_table()
        _, counts, _ = _merged(t, 1)
        return _rows(iter([(int(counts[0].sum()), int((counts[0] > 0).sum()))]), _SIZES)

    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return out.empty_table()
        part = pa.ipc.open_stream(left.column("docs")[0].as_py()).read_all()
        total, types = right.column("tokens")[0].as_py(), right.column("types")[0].as_py()
        return _rows(_scored(part, _joined(right), total, types, order, modulus, remainder, mu, texts), out)

    sent = rows.mapInArrow(send, _SENT_SQL)
    answers, inputs = exchanged(sent, steps, 0, groups)
    sizes = inputs[-1].groupBy("key").applyInArrow(count, "tokens bigint, types bigint").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))
    answers = answers.withColumns({"tokens": sizes.select("tokens").scalar(), "types": sizes.select("types").scalar()})
    scored = sent.groupBy("key").cogroup(answers.groupBy("asker")).applyInArrow(walk, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return scored.withColumnRenamed("doc_id", key), inputs
