"""Choosing among scored candidates: greedy, top-k with ties, min-p, softmax and draws. Rows: a group, a token, a score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def greedy(df: DataFrame, group: str, token: str = "tok", score: str = "score") -> DataFrame:
    """The best row of each group; of equal scores the lowest token."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(token))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def top_k(df: DataFrame, group: str, k: int, score: str = "score") -> DataFrame:
    """Rows whose score is at least the group's k-th best; ties with it stay. The limit is pushed below the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(score))
    return df.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= k).drop("_r")


def log_softmax(df: DataFrame, group: str, score: str = "score", out: str = "logp") -> DataFrame:
    """df with log probabilities: scores less the group's log of summed exponentials, shifted by the largest."""
    shape = df.groupBy(F.col(group).alias("_g")).agg(F.max(score).alias("_max"))
    top = df.join(shape, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    total = top.groupBy(F.col(group).alias("_g")).agg(F.sum(F.exp(F.col(score) - F.col("_max"))).alias("_sum"))
    both = top.join(total, F.col(group).eqNullSafe(F.col("_g")))
    return both.withColumn(out, F.col(score) - F.col("_max") - F.log("_sum")).drop("_g", "_max", "_sum")


def log_sum_exp(df: DataFrame, group: str, score: str = "score", out: str = "lse") -> DataFrame:
    """(group, lse), partial sums first: of (m, s) pairs the larger m wins and the other's s is scaled down to it."""
    m = df.groupBy(group).agg(F.max(score).alias("_m"))
    return df.join(m, group).groupBy(group).agg((F.max("_m") + F.log(F.sum(F.exp(F.col(score) - F.col("_m"))))).alias(out))


def probabilities(df: DataFrame, group: str, temperature: float = 1.0, k: int | None = None, min_p: float | None = None, score: str = "score", out: str = "p") -> DataFrame:
    """Candidates that may be drawn and their probabilities: temperature, then top-k, softmax, and min-p last.

    min-p keeps tokens at least min_p times as likely as the best and spreads the rest over them; 1 leaves the best only.
    """
    if temperature <= 1e-4:
        return greedy(df, group, score=score).withColumn(out, F.lit(1.0))
    scaled = df.withColumn("_s", F.col(score) / F.lit(float(temperature)))
    chosen = top_k(scaled, group, k, "_s") if k else scaled
    w = Window.partitionBy(group)
    p = chosen.withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w))).withColumn(out, F.col("_e") / F.sum("_e").over(w))
    if min_p:
        p = p.withColumn("_best", F.max(out).over(w)).where(F.col(out) >= F.lit(float(min_p)) * F.col("_best"))
        p = p.withColumn(out, F.col(out) / F.sum(out).over(w)).drop("_best")
    return p.drop("_s", "_e")


def penalised(df: DataFrame, recent: str, penalty: float, token: str = "tok", score: str = "score") -> DataFrame:
    """df with the scores of tokens in the array ``recent`` made worse: positive ones divided by the penalty, others times it."""
    s = F.col(score)
    worse = F.when(s > 0, s / penalty).otherwise(s * penalty)
    return df.withColumn(score, F.when(F.coalesce(F.array_contains(recent, F.col(token)), F.lit(False)), worse).otherwise(s))


def draw(p: DataFrame, group: str, token: str = "tok", probability: str = "p", seed: int = 0) -> DataFrame:
    """One row of each group with the given probabilities: the largest of log p - log(-log u), u from a hash of the row."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(group), F.col(token)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    noisy = p.withColumn("_z", F.log(probability) - F.log(-F.log(u)))
    return greedy(noisy, group, token, "_z").drop("_z")
