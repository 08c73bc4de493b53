"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here: pieces with their scores and types, the model's type, the normaliser and its flags.
From these a tokenizers pipeline is rebuilt: character map and white space of the normaliser, the metaspace marker, a
unigram model with the pieces' scores or a BPE model whose merges are ranked by them, byte fallback, and a decoder.

Where no piece can span two runs of text (a run: markers and then letters, or other characters and then letters; the
pieces say whether that holds), runs are encoded apart, those not seen before, and a bounded
cache holds their ids. The sentencepiece library is asked for whole texts of the rows that are to be checked so, and for
each run that is encoded for other rows. Other models encode whole texts and check them all. Every text's ids are decoded.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
MARKER = "▁"
_CACHED_RUNS = 300_000
_BATCH_CHARS = 2_000_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"

# Fixed values of the public protobuf schema: model types and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Piece(NamedTuple):
    text: str
    score: float
    kind: int


class SpmModel(NamedTuple):
    pieces: tuple[Piece, ...]
    kind: int
    byte_fallback: bool
    unk_id: int
    charsmap: bytes
    add_dummy_prefix: bool
    remove_extra_whitespaces: bool
    escape_whitespaces: bool


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}.get(wire)
        if size is None:
            raise ValueError(f"not a model: wire type {wire}")
        yield tag >> 3, raw[at : at + size]
        at += size


def parse(raw: bytes) -> SpmModel:
    """Field numbers are those of the public schema: ModelProto 1 pieces, 2 trainer, 3 normaliser."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            p = dict(_fields(value))
            pieces.append(Piece(p.get(1, b"").decode("utf-8"), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    unk = next((i for i, p in enumerate(pieces) if p.kind == UNKNOWN), 0)
    return SpmModel(tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), unk, normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)))


def merges(model: SpmModel) -> list[tuple[str, str]]:
    """Pairs of pieces whose union is a piece, from the best score down: what a BPE model merges, and in which order."""
    known = {p.text: i for i, p in enumerate(model.pieces) if p.kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for p in model.pieces:
        if p.kind == NORMAL:
            halves = [(p.text[:i], p.text[i:]) for i in range(1, len(p.text)) if p.text[:i] in known and p.text[i:] in known]
            found += [(-p.score, known[p.text], n, h) for n, h in enumerate(sorted(halves, key=lambda h: (known[h[0]], known[h[1]])))]
    return [h for *_, h in sorted(found)]


def rebuild(model: SpmModel) -> Tokenizer:
    """The whole pipeline, for texts as they are."""
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARKER if model.escape_whitespaces else " "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARKER))
    tokenizer = _bare(model)
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    decode = [decoders.Metaspace(MARKER, prepend_scheme="never"), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(decode + [decoders.Strip(" ", 1, 0)] * model.add_dummy_prefix)
    return tokenizer


def _bare(model: SpmModel, cached: int = 10_000) -> Tokenizer:
    """The model without its normaliser; ``cached``: words that a BPE model keeps, the library's default."""
    if model.kind == UNIGRAM:
        return Tokenizer(models.Unigram([(p.text, p.score) for p in model.pieces], model.unk_id, model.byte_fallback))
    if model.kind == BPE:
        vocab = {p.text: i for i, p in enumerate(model.pieces)}
        return Tokenizer(models.BPE(vocab, merges(model), cache_capacity=cached, unk_token=model.pieces[model.unk_id].text, fuse_unk=True, byte_fallback=model.byte_fallback))
    raise ValueError(f"model type {model.kind} is neither unigram nor BPE")


class Encoded(NamedTuple):
    ids: bytes  # little-endian unsigned 32-bit
    decoded: str
    parity: bool  # the sentencepiece library gives the same ids, where asked for the whole text, else for each run


class SpmBackend:
    """Encodes and decodes on the tokenizers library; ``raw`` is a model file's content."""

    def __init__(self, raw: bytes) -> None:
        self.model = parse(raw)
        self.whole = rebuild(self.model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw, out_type="numpy")
        m = self.model
        plain = [p.text for p in m.pieces if p.kind in (NORMAL, USER_DEFINED)]
        marked = any(re.search(f"[^{MARKER}]{MARKER}", p) for p in plain) or any("\n" in p and len(p) > 1 for p in plain)
        mixed = any(re.search(f"[{_LETTERS}][^{_LETTERS}]", p) for p in plain)
        self.by_run = m.byte_fallback and m.add_dummy_prefix and m.escape_whitespaces and not (m.charsmap or m.remove_extra_whitespaces or marked) and not any(p.kind == USER_DEFINED for p in m.pieces)
        other = f"[^{MARKER}\\n]+" if mixed else f"(?:[{_LETTERS}]+|[^{MARKER}\\n{_LETTERS}]+[{_LETTERS}]*)"
        self.pattern = re.compile(f"{MARKER}*{other}|{MARKER}+|\\n+")
        self.bare = _bare(m, 0).model  # runs come once
        # A message that is appended is merged: field 3 (normaliser), in it field 3 (add_dummy_prefix) = 0.
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=raw + b"\x1a\x02\x18\x00")
        self.is_byte = np.array([p.kind == BYTE for p in m.pieces])
        self.runs: dict[str, bytes] = {}  # checked one by one
        self.loose: dict[str, bytes] = {}  # of texts that are checked whole
        self.unlike: set[str] = set()  # runs that the sentencepiece library encodes otherwise

    def _encode_runs(self, runs: list[str], check: bool) -> dict[str, bytes]:
        """Ids of each run; with ``check`` the library's are compared here, once for a run."""
        tokens = self.bare.tokenize  # run by run: in batches, threads would cost more than the runs
        ours = {run: array("I", [t.id for t in tokens(run)]).tobytes() for run in runs}
        if check:
            theirs = self.inner.encode([r.replace(MARKER, " ") for r in runs], num_threads=1)
            self.unlike.update(r for r, b in zip(runs, theirs, strict=True) if ours[r] != array("I", b).tobytes())
        return ours

    def encode(self, texts: Sequence[str], checked: Sequence[bool] | None = None) -> Iterator[Encoded]:
        """The texts' ids, in order; texts of up to _BATCH_CHARS characters together are split into runs at once. ``checked``
        texts are also encoded whole by the library; all are where texts are not encoded by runs."""
        batch: list[tuple[str, bool]] = []
        size = 0
        for pair in zip(texts, checked or [False] * len(texts), strict=True):
            batch.append(pair)
            size += len(pair[0])
            if size >= _BATCH_CHARS:
                yield from self._encode_batch(batch)
                batch, size = [], 0
        yield from self._encode_batch(batch)

    def _encode_batch(self, batch: list[tuple[str, bool]]) -> Iterator[Encoded]:
        texts = [t for t, _ in batch]
        if self.by_run:
            check = [c for _, c in batch]
            found, parity = self._by_runs(texts, not all(check))
        else:
            found = [array("I", e.ids).tobytes() if t else b"" for t, e in zip(texts, self.whole.encode_batch(texts, add_special_tokens=False), strict=True)]
            parity, check = [True] * len(texts), [True] * len(texts)
        for t, raw, same, whole in zip(texts, found, parity, check, strict=True):
            # Decoded one by one: threads that wait for the next batch would cost as much as they decode.
            yield Encoded(raw, self.decode(array("I", raw).tolist()), not t or np.array_equal(self.library.encode(t), np.frombuffer(raw, "<u4")) if whole else same)

    def _by_runs(self, texts: list[str], check: bool) -> tuple[list[bytes], list[bool]]:
        known = self.runs if check else self.loose
        split = [self.pattern.findall(MARKER + t.replace(" ", MARKER)) if t else [] for t in texts]
        new = set(chain.from_iterable(split)).difference(known)
        found = self._encode_runs(list(new), check) if new else {}
        known.update(found)
        ids = [b"".join(map(known.__getitem__, runs)) for runs in split]
        if len(known) > _CACHED_RUNS:  # a full cache keeps its runs: common ones come early
            for run in found:
                del known[run]
        return ids, [self.unlike.isdisjoint(runs) for runs in split] if self.unlike else [True] * len(texts)

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids, skip_special_tokens=False)


_READY: dict[str, SpmBackend] = {}


def backend(path: str, raw: bytes) -> SpmBackend:
    """The backend of a Python worker, kept from task to task."""
    if path not in _READY:
        _READY.clear()
        _READY[path] = SpmBackend(raw)
    return _READY[path]


def encode(docs: DataFrame, model: str = PIECE_BPE, key: str = "doc_id", text: str = "text", threads: int = 2, with_ids: bool = False, check: int = 100) -> DataFrame:
    """One row for each row of docs: key, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), n_byte_ids (byte
    fallbacks), decoded_crc32 (of the decoded text's UTF-8), round_trip, parity, whole_checked[, ids array<int>].

    round_trip: the ids, decoded, give the text back, but for markers (U+2581), which decode to spaces. parity: the
    sentencepiece library gives the same ids: it is asked for the whole texts of the rows that whole_checked marks, and where
    texts are encoded by runs for every distinct run of the others. whole_checked: rows whose key is divisible by ``check`` (for other keys: its hash); 1: all rows.
    Null and empty texts have no ids; both flags are true. A null key is a key; repeated rows each get a row; an empty
    table gives an empty result; a long text is encoded whole, and its task holds its ids. Other columns are not read. The
    model file is read by the driver and sent to tasks.
    """
    with open(model, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["n_ids", "ids_crc32", "n_byte_ids", "decoded_crc32", "round_trip", "parity", "whole_checked"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.update(TOKENIZERS_PARALLELISM="true", RAYON_NUM_THREADS=str(threads))
        spm = backend(model, raw.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                checked = part.column(2).to_pylist()
                for t, c, e in zip(texts, checked, spm.encode(texts, checked), strict=True):
                    ids = np.frombuffer(e.ids, "<u4")
                    fallbacks = int(spm.is_byte[ids].sum())
                    rows.append((len(ids), zlib.crc32(e.ids), fallbacks, zlib.crc32(e.decoded.encode()), e.decoded == t.replace(MARKER, " "), e.parity, c, *([ids.astype(np.int32)] if with_ids else [])))
                cols = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=[key, *names])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_ids bigint, ids_crc32 bigint, n_byte_ids bigint, decoded_crc32 bigint, round_trip boolean, parity boolean, whole_checked boolean" + ", ids array<int>" * with_ids
    number = F.col(key) if docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)
    checked = F.lit(True) if check == 1 else F.coalesce(F.pmod(number, F.lit(check)) == 0, F.lit(False))
    return docs.select(key, F.col(text).alias("_text"), checked.alias("_checked")).mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str = PIECE_BPE, ids: str = "ids", out: str = "text") -> DataFrame:
    """tokens and out: the text of each row's ids; null ids give null."""
    with open(model, "rb") as f:
        raw = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spm = backend(model, raw.value)
        for b in batches:
            rows = b.column(ids).to_pylist()
            texts = spm.whole.decode_batch([r or [] for r in rows], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if r is None else t for r, t in zip(rows, texts, strict=True)], pa.string())], names=[*b.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(run, f"{schema}, `{out}` string")
