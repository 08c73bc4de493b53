"""The model over DataFrames: sequences stream through tasks, each task holds the weights once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .generate import StopWatch, generate_many, rolling_score, score_pair
from .model import Model, Shape, fresh_weights, perturbed

TINY = Shape(vocab=97, layers=3, heads=4, width=32, chunk=8, context=4096)


def tiny_weights(seed: int = 7) -> dict[str, np.ndarray]:
    """Small deterministic weights in which every part of the model matters."""
    return perturbed(fresh_weights(TINY, seed), seed + 1)


def byte_ids(text, vocab: int = TINY.vocab):
    """A column of ids 2 .. vocab - 1 by the bytes of a text: a stand-in where no tokenizer is given."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))  # one pass: a lambda would encode the text for each byte
    return F.when(F.octet_length(text) > 0, F.transform(pairs, lambda b: F.pmod(F.conv(b, 16, 10).cast("int"), F.lit(vocab - 2)) + 2)).otherwise(F.array().cast("array<int>"))


def _ids(value: pa.Scalar, vocab: int) -> np.ndarray:
    """The ids of an array, or those that ``byte_ids`` gives for the bytes of a binary value; none for null."""
    if not value.is_valid:
        return np.zeros(0, np.int64)
    if isinstance(value, pa.BinaryScalar):
        return np.frombuffer(value.as_buffer(), np.uint8) % np.int64(vocab - 2) + 2
    return value.values.to_numpy(zero_copy_only=False)


_APART = 8  # tasks that rows of equal ids are dealt to, so that a very common request is not one task's


def _tasks(spark: SparkSession) -> int:
    """As many as the session shuffles into, or one for each core. A row costs far more to compute than to move, so the number is given:
    without one, Spark joins partitions of few bytes again."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(_tasks(rows.sparkSession), key)


def _mapped(df: DataFrame, weights: dict[str, np.ndarray], columns: list[str], key: str, schema: str, types: list[pa.DataType], names: list[str], run, options: dict) -> DataFrame:
    """(key, names): run(model, *ids of columns) of every row; columns are arrays of ids, or binary for the ids of their bytes. Rows of equal
    ids come to _APART tasks at most, one after the other, each of which works them out once."""
    shared = df.sparkSession.sparkContext.broadcast(weights)  # its size is the model's, whatever the data

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, last, got = Model(shared.value, **options), None, None
        for b in batches:
            rows = []
            for values in zip(*[b.column(c) for c in columns], strict=True):
                ids = [_ids(v, model.shape.vocab) for v in values]
                if last is None or not all(map(np.array_equal, ids, last)):
                    got, last = run(model, *ids), ids
                rows.append(got)
            out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([b.column(key), *out], names=[key, *names])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, *columns, F.xxhash64(*columns).alias("_same"))
    tasks = _tasks(df.sparkSession)
    place = F.pmod(F.pmod("_same", F.lit(tasks)) + F.pmod(F.xxhash64(key), F.lit(_APART)), F.lit(tasks)).cast("int")
    return rows.repartitionById(tasks, place).sortWithinPartitions("_same").select(key, *columns).mapInArrow(apply, f"`{key}` {kind}, {schema}")


def loglikelihood(requests: DataFrame, weights: dict[str, np.ndarray], key: str = "req_id", ctx: str = "ctx", cont: str = "cont", **options) -> DataFrame:
    """(key, logprob, greedy) of every request."""
    return _mapped(requests, weights, [ctx, cont], key, "logprob double, greedy boolean", [pa.float64(), pa.bool_()], ["logprob", "greedy"], score_pair, options)


def loglikelihood_rolling(texts: DataFrame, weights: dict[str, np.ndarray], key: str, ids: str, size: int | None = None, **options) -> DataFrame:
    """(key, logprob) of whole texts, over disjoint windows."""
    return _mapped(texts, weights, [ids], key, "logprob double", [pa.float64()], ["logprob"], lambda m, t: (rolling_score(m, t, size),), options)


_HELD = 1 << 26  # bytes of states that are stepped together


def _in_step(df: DataFrame, weights: dict[str, np.ndarray], key: str, ids: str, out: pa.DataType, name: str, reply, options: dict) -> DataFrame:
    """(key, name): reply(model, prompts) of each batch, for as many prompts at once as their states may take."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value, **options)
        at_once = max(1, _HELD // Model.state_bytes(model.empty(), 8))
        for b in batches:
            for at in range(0, b.num_rows, at_once):
                part = b.slice(at, at_once)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(reply(model, [p or [] for p in part.column(ids).to_pylist()]), out)], names=[key, name])

    kind = df.schema[key].dataType.simpleString()
    sql = "string" if out == pa.string() else "array<int>"
    return _dealt(df.select(key, ids), key).mapInArrow(apply, f"`{key}` {kind}, {name} {sql}")


def generate(prompts: DataFrame, weights: dict[str, np.ndarray], key: str, ids: str, limit: int = 16, no_repeat: int = 0, penalty: float = 1.0, **options) -> DataFrame:
    """(key, reply array<int>): greedy continuations; a null or empty prompt begins after an end token."""
    return _in_step(prompts, weights, key, ids, pa.list_(pa.int32()), "reply", lambda m, p: generate_many(m, p, limit, no_repeat=no_repeat, penalty=penalty), options)


def generate_until(prompts: DataFrame, weights: dict[str, np.ndarray], key: str, ids: str, limit: int, decode: Callable[[list[int]], str], until: Sequence[str] = (), sampling: dict | None = None, **options) -> DataFrame:
    """(key, text): decoded continuations up to the first of the stop strings. A prompt keeps its last context - limit ids."""

    def reply(m: Model, texts: list[list[int]]) -> list[str]:
        watches = [StopWatch(decode, until) for _ in texts]
        generate_many(m, [t[-max(m.shape.context - limit, 1) :] for t in texts], limit, watches=watches, **(sampling or {}))
        return [w.text for w in watches]

    return _in_step(prompts, weights, key, ids, pa.string(), "text", reply, options)
