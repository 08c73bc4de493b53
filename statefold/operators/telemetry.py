"""Energy and throttling from telemetry samples: ts, watts, celsius, reasons (a bit mask)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits of the clock event reasons.
POWER_CAP = 0x4
THERMAL = 0x20 | 0x40


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def steps(samples: DataFrame, by: list[str], max_gap: float) -> DataFrame:
    """Each sample with dt to the next, and the part of it that is covered and that is a gap.

    A step that is longer than max_gap, or whose power is unknown at either end, is a gap; steps that do not go forward
    count for nothing. Without ``by`` all samples are one timeline; it is cut into ranges first, see ``next_samples``.
    """
    timed = next_samples(samples.withColumn("_t", _seconds(F.col("ts"))), by)
    dt = F.col("_next_t") - F.col("_t")
    bridged = (dt > 0) & (dt <= max_gap) & F.col("watts").isNotNull() & F.col("_next_watts").isNotNull()
    return timed.withColumn("dt", dt).withColumn("covered", F.when(bridged, dt).otherwise(0.0)).withColumn("gap", F.when((dt > 0) & ~bridged, dt).otherwise(0.0))


def next_samples(timed: DataFrame, by: list[str]) -> DataFrame:
    """timed with _next_t and _next_watts. A single timeline is sorted by ranges, not in one task: the window runs in each
    hour apart, and the hour's last sample takes the first of the next hour that has any, from one row an hour."""
    if by:
        w = Window.partitionBy(*by).orderBy("_t", *_ties(timed))
        return timed.withColumns({"_next_t": F.lead("_t").over(w), "_next_watts": F.lead("watts").over(w)})
    hour = F.floor(F.col("_t") / 3600).cast("bigint")
    w = Window.partitionBy("_hour").orderBy("_t", *_ties(timed))
    inner = timed.withColumn("_hour", hour).withColumns({"_lead_t": F.lead("_t").over(w), "_lead_watts": F.lead("watts").over(w), "_is_last": F.lead("_t").over(w).isNull()})
    firsts = timed.withColumn("_hour", hour).groupBy("_hour").agg(F.min(F.struct("_t", *_ties(timed), "watts")).alias("_first"))
    over_hours = Window.orderBy("_hour")  # one row an hour
    following = firsts.select("_hour", F.lead("_first._t").over(over_hours).alias("_hour_t"), F.lead("_first.watts").over(over_hours).alias("_hour_watts"))
    joined = inner.join(following, "_hour", "left")  # samples without a time have no hour, and count
    return joined.withColumns({"_next_t": F.when(F.col("_is_last"), F.col("_hour_t")).otherwise(F.col("_lead_t")), "_next_watts": F.when(F.col("_is_last"), F.col("_hour_watts")).otherwise(F.col("_lead_watts"))}).drop("_hour", "_lead_t", "_lead_watts", "_is_last", "_hour_t", "_hour_watts")


def _ties(df: DataFrame) -> list[str]:
    return [c for c in ("event_id", "device") if c in df.columns]


def energy_summary(samples: DataFrame, by: list[str] | None = None, max_gap: float = 5.0) -> DataFrame:
    """samples, hours_logged, hours_gap, kwh (trapezoids), mean_watts (over time), mean_celsius and peak_celsius (over
    samples), share_thermal_throttled and share_power_capped (over covered time, by the left sample's mask). Zero where there is nothing."""
    by = by or []
    s = steps(samples, by, max_gap)
    joules = F.col("covered") * (F.col("watts") + F.col("_next_watts")) / 2
    mask = F.coalesce(F.col("reasons"), F.lit(0)).cast("bigint")
    flagged = lambda bits: F.sum(F.when(mask.bitwiseAND(F.lit(bits)) != 0, F.col("covered")).otherwise(0.0))
    g = s.groupBy(*by).agg(
        F.count("*").alias("samples"),
        F.sum("covered").alias("_covered"),
        F.sum("gap").alias("_gap"),
        F.sum(F.coalesce(joules, F.lit(0.0))).alias("_joules"),
        F.avg("celsius").alias("_mean_c"),
        F.max("celsius").alias("_peak_c"),
        flagged(THERMAL).alias("_thermal"),
        flagged(POWER_CAP).alias("_capped"),
    )
    share = lambda x: F.when(F.col("_covered") > 0, F.col(x) / F.col("_covered")).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return g.select(*by, "samples", (zero("_covered") / 3600).alias("hours_logged"), (zero("_gap") / 3600).alias("hours_gap"), (zero("_joules") / 3.6e6).alias("kwh"), share("_joules").alias("mean_watts"), zero("_mean_c").alias("mean_celsius"), zero("_peak_c").alias("peak_celsius"), share("_thermal").alias("share_thermal_throttled"), share("_capped").alias("share_power_capped"))


def with_footprint(summary: DataFrame, tokens: int | None = None, grid_kg_per_kwh: float | None = None, grid_source: str | None = None, wall_kwh: float | None = None) -> DataFrame:
    """summary with energy for a million tokens and kg of CO2, from the wall meter if there is one. A factor needs its source."""
    if (grid_kg_per_kwh is None) != (grid_source is None):
        raise ValueError("a grid factor and its source go together")
    if tokens:
        summary = summary.withColumns({"tokens": F.lit(int(tokens)), "wh_per_million_tokens": F.col("kwh") * 1000 / (tokens / 1e6)})
    if wall_kwh is not None:
        summary = summary.withColumn("wall_kwh", F.lit(float(wall_kwh)))
    if grid_kg_per_kwh is not None:
        basis = F.col("kwh") if wall_kwh is None else F.col("wall_kwh")
        summary = summary.withColumns({"kg_co2": basis * float(grid_kg_per_kwh), "co2_basis": F.lit("gpu board only" if wall_kwh is None else "wall"), "grid_source": F.lit(grid_source)})
    return summary
