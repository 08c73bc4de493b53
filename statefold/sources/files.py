"""Trees of files, word lists and digests as DataFrames, and paths resolved on the driver."""

from __future__ import annotations

import subprocess
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import strip
from ..functions.text import BINARY_SUFFIXES, MAX_SCAN_BYTES, PRIVATE_PREFIXES


def read_tree(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, content) of all files below a folder; only columns that a query uses are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("size"), "content")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of all files below a folder."""
    return read_tree(spark, path).select("path", "size", F.sha2("content", 256).alias("sha256"))


def sha256_of(path: str) -> str:
    """Digest of one file on the driver."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a list, without comments and blank lines."""
    return spark.read.text(path).select(strip(F.col("value")).alias("word")).where("word <> '' and not startswith(word, '#')")


def tracked_tree(spark: SparkSession, root: str, untracked: bool = False) -> DataFrame:
    """(path, size, private, passed_over) of what version control knows below root, with ``untracked`` also of what it does
    not ignore. private: by prefix; passed_over: binary by suffix, too large to scan, or gone from the folder."""
    listing = ["ls-files", "-z", "--cached"] + (["--others", "--exclude-standard"] if untracked else [])
    names = subprocess.run(["git", "-C", root, *listing], capture_output=True, check=True).stdout.decode().split("\0")
    found = [(name, p.stat().st_size if (p := Path(root, name)).is_file() else None) for name in names if name]
    tree = spark.createDataFrame(found, "path string, size bigint")
    private = reduce(or_, [F.col("path").startswith(x) for x in PRIVATE_PREFIXES])
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return tree.withColumns({"private": private, "passed_over": suffix.isin(*BINARY_SUFFIXES) | F.coalesce(F.col("size") > MAX_SCAN_BYTES, F.lit(True))})


def revision(root: str) -> str | None:
    """The checked-out git revision, or None where root is no checkout of its own."""
    out = subprocess.run(["git", "-C", root, "rev-parse", "--show-toplevel", "HEAD"], capture_output=True, text=True)
    top, _, head = out.stdout.strip().partition("\n")
    return head if out.returncode == 0 and Path(top).resolve() == Path(root).resolve() else None


def resolve_weights(path: str, name: str = "model.safetensors") -> Path:
    """A weights file, or the one with that name in a folder."""
    p = Path(path)
    p = p / name if p.is_dir() else p
    if not p.exists():
        raise FileNotFoundError(f"no weights at {p}; give a .safetensors file or a folder with {name}")
    return p
