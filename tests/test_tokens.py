import json

import pytest
from pyspark.sql import functions as F

from statefold.operators import splits
from statefold.plans import lm
from statefold.plans.model import Model
from statefold.plans.selftest import self_test
from statefold.sources import tokenizer as T
from statefold.streaming.lines import line_stream

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture
def path(tmp_path):
    """A vocabulary of bytes, with the special tokens of turns."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
    t = Tokenizer(models.BPE({c: i for i, c in enumerate(alphabet)}, []))
    t.pre_tokenizer, t.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
    t.add_special_tokens([T.END, T.USER, T.ASSISTANT, "<kan>"])
    t.save(str(tmp_path / "t.json"))
    return str(tmp_path / "t.json")


def test_texts_come_back(spark, path):
    texts = ["Hello", "ನಮಸ್ಕಾರ", "", None, "def f(x):\n  return x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("ids", T.encoded(F.col("t"), path))
    assert [r.back for r in df.select(T.decoded(F.col("ids"), path).alias("back")).collect()] == texts


def test_special_tokens(spark, path):
    vocabulary = {t["content"]: t["id"] for t in json.load(open(path))["added_tokens"]}
    df = spark.createDataFrame([([1, 2], "kan")], "m array<int>, lang string")
    assert T.turn_ids(df, "m", "lang", vocabulary).first().ids == [vocabulary[T.USER], vocabulary["<kan>"], 1, 2, vocabulary[T.ASSISTANT]]
    with pytest.raises(Exception, match="unknown special token"):
        T.turn_ids(df.withColumn("lang", F.lit("xx")), "m", "lang", vocabulary).collect()


def test_lines_are_streamed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("/kan hi\r\n hello \n\t/new\nನಮಸ್ಕಾರ\n \t\nafter the end\n")
    (tmp_path / "in" / "b.txt").write_text("\nnothing\n")
    query = line_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("lines_out").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.command, r.message, r.lang) for r in spark.table("lines_out").collect()} == {("once", "hi", "kan"), ("message", "hello", "eng"), ("new", None, None), ("message", "ನಮಸ್ಕಾರ", "kan")}


def test_self_test():
    w = lm.tiny_weights()
    report, ok = self_test(Model(w, chunk=8), Model(w, chunk=64), [5, 6, 7])
    assert ok and report.endswith("PASS")
    bad, ok = self_test(Model(w, chunk=8), Model(lm.tiny_weights(99), chunk=8), [5, 6, 7])
    assert not ok and bad.endswith("FAIL")


def test_splits_and_averages(spark):
    df = spark.range(2000).select("id", (F.col("id") < 1000).cast("int").alias("lang"))
    by_hash = splits.split_balance(df.withColumn("split", splits.hash_split(F.col("id"), 2)), "split", "lang").collect()
    assert len(by_hash) == 4 and all(0.45 < r.share < 0.55 for r in by_hash)
    tail = splits.split_balance(df.withColumn("split", (F.col("id") >= 1000).cast("int")), "split", "lang").collect()
    assert all(r.share == 1.0 for r in tail)
    e = spark.createDataFrame([(1, "w", 0, 1.0), (2, "w", 0, 3.0), (1, "w", 1, 5.0)], "checkpoint int, name string, i int, value double")
    assert {(r.i, r.value) for r in splits.average_weights(e).collect()} == {(0, 2.0), (1, 5.0)}
