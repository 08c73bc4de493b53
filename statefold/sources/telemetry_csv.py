"""GPU telemetry logs: CSV text with units in the header, cut-off lines and unreadable values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import parse_hex, parse_number, parse_timestamp, strip

# Columns of the log after the unit is cut off, and the older name of the last.
TIME, WATTS, CELSIUS, REASONS, OLD_REASONS = "timestamp", "power.draw", "temperature.gpu", "clocks_event_reasons.active", "clocks_throttle_reasons.active"


def read_log(spark: SparkSession, paths: str | Sequence[str], device: str = "device") -> DataFrame:
    """(device, ts, watts, celsius, reasons) of one or more logs; device is the file's path.

    A file's first line is its header, wherever its splits are read. Lines with another number of fields, and lines without a
    readable time (a second header too), are left out; other unreadable values are null. Commas in double quotes belong to
    the field; a quoted field ends with its line. Which of two names the reasons have is taken from the header of each file.
    An empty file gives no rows.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text([paths] if isinstance(paths, str) else list(paths)).select(F.input_file_name().alias(device), "value", place.alias("_place"))
    raw = F.regexp_extract_all("value", F.lit(r'(?:^|,)\s*("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    fields = lines.select(device, "_place", F.transform(raw, lambda x: strip(F.when(x.rlike('^".*"$'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))).alias("_f"))
    header = F.transform("_f", lambda h: strip(F.substring_index(h, " [", 1)))
    heads = fields.groupBy(device).agg(F.min_by(header, "_place").alias("_h"), F.min("_place").alias("_first"))  # one row a file
    rows = fields.join(heads, device).where((F.size("_f") == F.size("_h")) & (F.col("_place") != F.col("_first")))

    def at(name: str) -> Column:
        place = F.array_position("_h", name)
        return F.when(place > 0, F.element_at("_f", place.cast("int")))

    reasons = F.when(F.array_contains("_h", REASONS), at(REASONS)).otherwise(at(OLD_REASONS))
    out = rows.select(device, parse_timestamp(at(TIME)).alias("ts"), parse_number(at(WATTS)).alias("watts"), parse_number(at(CELSIUS)).alias("celsius"), parse_hex(reasons).alias("reasons"))
    return out.where("ts is not null")
