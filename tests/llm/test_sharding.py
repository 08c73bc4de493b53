import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from statefold.llm import sharding as S
from statefold.llm.ranking import gapless_rank

from .fixtures import clashing, documents, empty, rows, same


def jump(key, n):
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_hash_is_the_published_one(spark):
    keys = [-5, -1, 0, 2**63 - 1, -(2**63), 12345678901234, *range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for n in (1, 2, 8, 37):
        for r in S.with_jump_hash(df, F.col("k"), n, "s", "g").collect():
            assert (r.s, r.g) == (jump(r.k, n), jump(r.k, n + 1))


def test_plan_rows(spark):
    got = S.shard_plan(documents(spark)).collect()
    want = []
    for doc_id, text, *_ in rows():
        raw = (text or "").encode()
        want.append((doc_id, len(raw) + 1, zlib.crc32(raw), "key", jump(doc_id or 0, 8), jump(doc_id or 0, 9)))
    same([(r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got], want)
    slots = defaultdict(list)
    for r in got:
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even_and_growth_moves_few(spark):
    got = S.with_jump_hash(spark.range(20000), F.col("id"), 8, "s", "g").collect()
    assert max(Counter(r.s for r in got).values()) < 1.1 * 20000 / 8
    moved = sum(r.s != r.g for r in got)
    assert 0.9 * 20000 / 9 < moved < 1.1 * 20000 / 9


def test_other_columns_empty_and_native(spark):
    same([r.doc_id and (r.doc_id,) or (r.doc_id,) for r in S.shard_plan(clashing(spark)).collect()], [(r[0],) for r in rows()])
    assert S.shard_plan(empty(spark)).collect() == []
    plan = S.shard_plan(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_write_shards(spark, tmp_path):
    S.write_shards(documents(spark).select("doc_id", "text"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    same([(r.doc_id, r.shard) for r in back.collect()], [(r[0], jump(r[0] or 0, 8)) for r in rows()])


def test_ranks_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id") % 5).alias("k"), (F.col("id") % 3).alias("o"))
    got = gapless_rank(df.repartition(16), ["k"], ["o"], "r").collect()
    by = defaultdict(list)
    for r in got:
        by[r.k].append((r.r, r.o))
    for pairs in by.values():
        assert [p[0] for p in sorted(pairs)] == list(range(len(pairs)))
        assert [p[1] for p in sorted(pairs)] == sorted(p[1] for p in pairs)
