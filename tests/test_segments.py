import math
import random

import pytest
from pyspark.sql import functions as F

from statefold.operators import decay, memory, segments

C = 8
PLANS = {"pairwise": lambda d: decay.pairwise(d, "s"), "folded": lambda d: decay.folded(d, "s"), "blocked": lambda d: decay.blocked(d, "s", C, 2), "deep": lambda d: decay.blocked(d, "s", 3, 4), "grouped": lambda d: decay.grouped(d, "s")}


def sequences(seed=0):
    """Lengths and ends that fall on, before and after block edges, and one document that is long for its decay."""
    rng, out = random.Random(seed), []
    ends = ((7, 30), (9, 15), (23, 24, 40), ())
    for n, length in enumerate((1, 3, 8, 21, 64, 77)):
        for m, at in enumerate(ends):
            out += [(10 * n + m, t, 0 if t in at else rng.randrange(2, 97), rng.uniform(-2, 0), rng.uniform(-1, 1)) for t in range(length)]
    out += [(999, t, 5, -0.35, 1.0) for t in range(700)]
    return out


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(sequences(), "s bigint, at bigint, tok int, la double, v double")
    return segments.segmented(df.repartition(7), "s", ["at"], F.col("tok") == 0).cache()


def loop():
    out, last = {}, None
    for s, t, tok, la, v in sequences():
        if last is None or last[0] != s:
            doc, y, ended = 0, 0.0, False
        doc, y = (doc + 1, 0.0) if ended else (doc, y)
        y = 2.718281828459045**la * y + v
        out[s, t] = (doc, y)
        ended, last = tok == 0, (s, t)
    return out


def test_segments_match_a_loop(rows):
    want = loop()
    assert {(r.s, r.t): r.doc for r in rows.collect()} == {k: d for k, (d, _) in want.items()}
    starts = {(r.s, r.t) for r in rows.where("reset").collect()}
    assert starts == {(s, t + 1) for s, t, tok, *_ in sequences() if tok == 0 and (s, t + 1) in want}


def test_carried_sentinel(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 6)], "s int, at int, tok int")
    assert [r.doc for r in segments.segmented(df, "s", ["at"], F.col("tok") == 0, carried=True).orderBy("t").collect()] == [1, 1]


@pytest.mark.parametrize("plan", list(PLANS))
def test_decay_plans_match_a_loop(rows, plan):
    want = loop()
    got = PLANS[plan](rows).collect()
    assert len(got) == len(want)
    assert max(abs(r.y - want[r.s, r.t][1]) for r in got) < 1e-9
    assert all(r.doc == want[r.s, r.t][0] for r in got)


def test_final_state_and_merge(rows):
    want = loop()
    for r in decay.final_state(rows, "s", C).collect():
        mine = [(t, y) for (s, t), (d, y) in want.items() if s == r.s and d == r.doc]
        assert r.n == len(mine) and abs(r.state - max(mine)[1]) < 1e-9


def test_packed_documents_equal_separate_ones(spark, rows):
    one = {(r.doc, r.y) for r in decay.blocked(rows.where("s = 52"), "s", C).collect()}
    alone = rows.where("s = 52").select(F.concat("s", F.lit("-"), "doc").alias("s"), F.row_number().over(__import__("pyspark").sql.Window.partitionBy("doc").orderBy("t")).cast("bigint").alias("t"), "doc", "la", "v")
    two = {(r.doc, r.y) for r in decay.blocked(alone, "s", C).collect()}
    assert {(d, round(y, 9)) for d, y in one} == {(d, round(y, 9)) for d, y in two}


def test_masked_pairs(rows):
    counts = {}
    docs = {k: d for k, (d, _) in loop().items()}
    for (s, i), d in docs.items():
        for j in range(i - i % C, i + 1):
            if docs[s, j] == d:
                counts[s, i // C] = counts.get((s, i // C), 0) + 1
    assert {(r.s, r.blk): r.pairs for r in decay.masked_pairs(rows, "s", C).collect()} == counts


def test_stencils(rows):
    by = {(s, t): (d, v) for (s, t), (d, _) in loop().items() for v in [next(x[4] for x in sequences() if x[:2] == (s, t))] if s < 60}
    taps = (0.1, -0.2, 0.3, 0.5)
    for r in segments.causal_conv(segments.token_shift(rows.where("s < 60"), "s", "v", 0.25), "s", "v", taps, 0.01).collect():
        same = [by[r.s, r.t - k][1] if (r.s, r.t - k) in by and by[r.s, r.t - k][0] == r.doc else 0.0 for k in range(4)]
        assert abs(r.conv - (0.01 + sum(w * x for w, x in zip(reversed(taps), same, strict=True)))) < 1e-12
        assert abs(r.shifted - (0.25 * same[0] + 0.75 * same[1])) < 1e-12


def test_history_last_and_stops(rows):
    got = {r.s: r.history for r in segments.stencil_history(rows, "s", "v").collect()}
    want = loop()
    for s, history in got.items():
        mine = sorted(t for q, t in want if q == s)
        vs = {x[1]: x[4] for x in sequences() if x[0] == s}
        open_doc = [vs[t] for t in mine if want[s, t][0] == want[s, mine[-1]][0]][-3:]
        assert history == [0.0] * (3 - len(open_doc)) + open_doc
    assert segments.keep_last(rows, "s", 0).count() == 0
    assert {(r.s, r.t) for r in segments.keep_last(rows.where("s = 52"), "s", 2).collect()} == {(52, 75), (52, 76)}
    cut = segments.before_first_stop(rows.where("s in (52, 53)"), "s", F.col("tok") == 0).collect()
    assert max(r.t for r in cut if r.s == 52) == 22 and max(r.t for r in cut if r.s == 53) == 76


def test_repeated_ngrams(spark):
    tokens = [1, 2, 3, 1, 2, 3, 4, 1, 2] + list(range(10, 75)) + [1, 2, 3]
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate(tokens)], "s int, t bigint, tok int")
    got = [r.t for r in segments.repeated_ngrams(df, "s", "tok", 3).where("repeated").orderBy("t").collect()]
    want = [t for t in range(2, len(tokens)) if any(tokens[j - 2 : j + 1] == tokens[t - 2 : t + 1] for j in range(max(2, t - 61), t))]
    assert got == want
    assert segments.repeated_ngrams(df, "s", "tok", 1).where("repeated").count() == 0


def test_matrix_memory(spark):
    trace = [(1, 0, [1.0, 0.0], [1.0, 0.0], [3.0, 1.0]), (1, 1, [1.0, 0.0], [0.0, 1.0], [-2.0, 4.0])]
    df = spark.createDataFrame([(s, t, 0, -0.6931471805599453, q, k, v) for s, t, q, k, v in trace], "s int, t bigint, doc int, la double, q array<double>, k array<double>, v array<double>")
    assert sorted(memory.scanned_reads(df, "s").collect())[1].y == pytest.approx([1.5, 0.5])
    other = df.withColumn("q", F.when(F.col("t") == 1, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.col("q")))
    assert sorted(memory.scanned_reads(other, "s").collect())[1].y == pytest.approx([-2.0, 4.0])


def test_matrix_memory_in_any_blocks(spark):
    rng = random.Random(4)
    rows = [(s, t, int(t >= 30), rng.uniform(-1, 0), *[[rng.uniform(-1, 1) for _ in range(3)] for _ in "qk"], [rng.uniform(-1, 1)]) for s in range(3) for t in range(77)]
    df = spark.createDataFrame(rows, "s int, t bigint, doc int, la double, q array<double>, k array<double>, v array<double>")
    want = {(r.s, r.t): r.y for r in memory.paired_reads(df.withColumn("v", F.col("v")[0]), "s").collect()}
    for chunk in (1, 8, 100):
        assert all(abs(r.y[0] - want[r.s, r.t]) < 1e-9 for r in memory.scanned_reads(df, "s", chunk).collect())


def test_segments_in_ranges_are_the_same(spark):
    import random

    rng = random.Random(1)
    rows = [(s, i, rng.random() < 0.2) for s, n in (("a", 3000), ("b", 1), ("c", 40), (None, 5), ("d", 500)) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, i int, stop boolean").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = segments.segmented_in_ranges(df, "s", ["i"], F.col("stop")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    key = lambda r: (str(r.s), r.i)
    want = segments.segmented(df, "s", ["i"], F.col("stop")).select(*got[0].__fields__).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len({key(r) for r in got}) == len(rows)


def test_final_state_of_a_long_document(spark):
    n = 5000
    df = spark.range(n).selectExpr("1 as s", "0 as doc", "id as t", "-0.01D as la", "cast(id % 7 as double) as v")
    want = 0.0
    for i in range(n):
        want = want * math.exp(-0.01) + i % 7
    for size, levels in ((4, 3), (8, 2), (64, 1)):
        (r,) = decay.final_state(df, "s", size, levels).collect()
        assert r.n == n and abs(r.state - want) < 1e-6
