import math
from collections import Counter

import pytest

from statefold.operators import ranking as R
from statefold.operators import recall, scoring

ROWS = [("a", 1, 3.0), ("a", 2, 3.0), ("a", 3, 1.0), ("a", 4, 2.9), ("b", 9, -1000.0), ("b", 8, -1001.0), ("c", 5, 700.0)]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(ROWS, "g string, tok int, score double").cache()


def test_greedy_takes_the_lowest_token_of_equals(scores):
    assert {(r.g, r.tok) for r in R.greedy(scores, "g").collect()} == {("a", 1), ("b", 9), ("c", 5)}


def test_top_k_keeps_ties(scores):
    assert {(r.g, r.tok) for r in R.top_k(scores, "g", 1).collect()} == {("a", 1), ("a", 2), ("b", 9), ("c", 5)}


def test_log_softmax_and_lse_do_not_overflow(scores):
    by = {}
    for g, t, s in ROWS:
        by.setdefault(g, []).append((t, s))
    for r in R.log_softmax(scores, "g").collect():
        top = max(s for _, s in by[r.g])
        want = r.score - top - math.log(sum(math.exp(s - top) for _, s in by[r.g]))
        assert r.logp == pytest.approx(want)
    assert {r.g: round(r.lse, 6) for r in R.log_sum_exp(scores, "g").collect()}["c"] == 700.0


def test_probabilities_in_order(scores):
    p = {(r.g, r.tok): r.p for r in R.probabilities(scores, "g", 1.0, k=3, min_p=0.95).collect()}
    assert p == {("a", 1): 0.5, ("a", 2): 0.5, ("b", 9): 1.0, ("c", 5): 1.0}
    all_p = {(r.g, r.tok): r.p for r in R.probabilities(scores, "g", 2.0).collect()}
    assert sum(v for (g, _), v in all_p.items() if g == "a") == pytest.approx(1.0)
    assert {(r.g, r.tok) for r in R.probabilities(scores, "g", 0.0, k=5).collect()} == {("a", 1), ("b", 9), ("c", 5)}
    only = {(r.g, r.tok) for r in R.probabilities(scores, "g", 1.0, min_p=1.0).collect()}
    assert only == {("a", 1), ("a", 2), ("b", 9), ("c", 5)}


def test_draws_follow_the_probabilities(spark):
    df = spark.range(4000).selectExpr("id as g", "explode(array(struct(1 as tok, 0.7D as p), struct(2 as tok, 0.3D as p))) as x").select("g", "x.*")
    n = Counter(r.tok for r in R.draw(df, "g", seed=3).collect())
    assert n[1] + n[2] == 4000 and abs(n[2] / 4000 - 0.3) < 0.03
    assert R.draw(df, "g", seed=3).exceptAll(R.draw(df, "g", seed=3)).count() == 0


def test_recall_cells_reproduce_published_intervals(spark):
    """Choice rates with Wilson's interval as printed for 29 of 29, 7 of 30 and 10 of 50 items."""
    items = [("x", i < k, n, 1.0 + (i % 2)) for n, k in ((29, 29), (30, 7), (50, 10)) for i in range(n)]
    df = spark.createDataFrame(items, "c string, hit boolean, n int, gain double").selectExpr("*", "n as dist")
    from pyspark.sql import functions as F

    got = {r.n: r for r in recall.recall_cells(df.withColumnRenamed("n", "cell"), ["cell"], "dist", "gain", F.col("hit"), F.col("hit")).collect()}
    shown = {n: (round(r.choice, 2), round(r.choice_lo, 2), round(r.choice_hi, 2)) for n, r in got.items()}
    assert shown == {29: (1.0, 0.88, 1.0), 30: (0.23, 0.12, 0.41), 50: (0.2, 0.11, 0.33)}
    assert got[30].mean_dist == 30 and got[30].gain == 1.5 and got[30].gain_ci == pytest.approx(1.96 * 0.5085476 / math.sqrt(30), rel=1e-4)


def test_choices_and_state_shares(spark):
    c = spark.createDataFrame([(1, 5.0, True), (1, 5.0, False), (2, 1.0, True), (2, 3.0, False)], "item int, score double, needle boolean")
    assert {(r.item, r.chosen) for r in recall.choices(c, "item", "score", "needle").collect()} == {(1, True), (2, False)}
    s = spark.createDataFrame([("k", i, layer, head, 0.1 * layer + 0.01 * head) for i in range(3) for layer in range(4) for head in range(3)], "cell string, item int, layer int, head int, share double")
    rows = {r.layer: r for r in recall.state_shares(s, ["cell"], top=3).collect()}
    assert round(rows[3].share, 2) == 0.32 and rows[0].top_heads == "3.2=0.32, 3.1=0.31, 3.0=0.30"


def test_scores_of_continuations_and_windows(spark):
    steps = spark.createDataFrame([(1, 5, 5, -0.5), (1, 6, 7, -1.0), (2, 3, 3, -0.25)], "req int, tok int, best int, logp double")
    assert {tuple(r) for r in scoring.continuation_scores(steps, "req").collect()} == {(1, -1.5, False), (2, -0.25, True)}
    t = spark.createDataFrame([(1, i, -1.0) for i in range(10)], "s int, t int, logp double")
    assert tuple(scoring.rolling_scores(t, "s", 4).first()) == (1, 3, -10.0)
    nll = scoring.negative_log_likelihood(t, "s").first()
    assert (nll.n, nll.nll, round(nll.perplexity, 6)) == (10, 1.0, round(math.e, 6))
    ce = spark.createDataFrame([(-1.0, 5), (-2.0, 0), (-9.0, -100)], "logp double, y int")
    assert scoring.weighted_cross_entropy(ce, "logp", "y", 0, 3.0).first().loss == pytest.approx((1 + 3 * 2) / 4)


def test_truncation_differences_and_parity(spark):
    pairs = spark.createDataFrame([([1, 2, 3], [4, 5]), ([1], []), ([], [1, 2, 3, 4, 5])], "context array<int>, continuation array<int>")
    got = [tuple(r) for r in scoring.truncated_pairs(pairs, 2).collect()]
    assert got == [([3], [4, 5]), ([1], []), ([], [3, 4, 5])]
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in ("abc", "bcd"))
    assert {tuple(r) for r in scoring.key_difference(a, b, "k").collect()} == {("a", "missing"), ("d", "unexpected")}
    x, y = (spark.createDataFrame(rows, "k int, v double") for rows in ([(1, 1.0), (2, 2.0)], [(1, 1.5), (3, 0.0)]))
    assert tuple(scoring.parity(x, y, ["k"], "v").first()) == (3, 0.5, 2)


def test_batches_are_longest_first(spark):
    rows = scoring.batches(spark.range(50).repartition(5), 8, "id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.batch, []).append(r.id)
    assert all(len(v) <= 8 for v in by.values()) and sum(map(len, by.values())) == 50
