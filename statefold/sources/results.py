"""Evaluation results: run records and samples, in folders named by the digest of the weights."""

from __future__ import annotations

import datetime
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import redact, run_label


def run_record(spark: SparkSession, tasks: Sequence[str], weights_sha256: str, weights_path: str, command: Sequence[str], results: dict, limit: int | None = None, label: str | None = None, harness_version: str = "", harness_revision: str | None = None, n_samples: dict | None = None, versions: dict | None = None, configs: dict | None = None) -> DataFrame:
    """One row: label, command without the weights' path, date, versions, limit, smoke_test, results, sample counts, versions and configurations of the tasks as JSON."""
    row = [("+".join(tasks) if label is None else label, " ".join(command), datetime.date.today().isoformat(), harness_version, harness_revision, weights_sha256, limit, json.dumps(results, default=str, ensure_ascii=False), json.dumps(n_samples or {}), json.dumps(versions or {}, default=str), json.dumps(configs or {}, default=str, ensure_ascii=False))]
    schema = "tasks string, command string, date string, harness_version string, harness_revision string, checkpoint_sha256 string, limit bigint, results string, n_samples string, versions string, configs string"
    df = spark.createDataFrame(row, schema)
    return df.withColumns({"label": run_label(F.col("tasks"), F.col("limit")), "smoke_test": F.coalesce(F.col("limit"), F.lit(0)) > 0, "command": redact(F.col("command"), weights_path)}).drop("tasks")


def write_record(record: DataFrame, path: str) -> None:
    """<path>/checkpoint_sha256=<digest>/label=<label>/*.json"""
    record.write.mode("append").partitionBy("checkpoint_sha256", "label").json(path)


def write_samples(samples: DataFrame, path: str, task: str = "task") -> None:
    """One folder for each task, one JSON line for each sample."""
    samples.write.mode("append").partitionBy(task).option("ignoreNullFields", "false").json(path)


def report(df: DataFrame, as_json: bool = False) -> tuple[str, int]:
    """A short report of a one-row summary as text or JSON, and an exit code: 1 if there were no samples."""
    row = df.limit(1).collect()
    values = row[0].asDict(recursive=True) if row else {}
    text = json.dumps(values, default=str, indent=1) if as_json else "\n".join(f"{k}: {v:.6g}" if isinstance(v, float) else f"{k}: {v}" for k, v in values.items())
    return text, 0 if values.get("samples") else 1
