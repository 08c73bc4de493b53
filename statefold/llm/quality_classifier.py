"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic classifier on text measures gives each document its evidence, a log likelihood ratio, and p, its probability
under the global rate. Hosts, and paths within hosts, have rates of their own; a grouped aggregation estimates how much
they truly vary, and each site's mean is shrunk towards the level above by n / (n + kappa), kappa being the variance within
sites over the variance between them. So a sparse site has the rate of its host or of the corpus, and a large one its own.
A document's score is its evidence on top of its path's rate, to which it does not contribute itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import cut, small_batches
from .quality_rules import STOP_WORDS
from .rows import without

SAMPLE_ROWS = 20_000  # labelled rows that the classifier is fitted on, at most about
THRESHOLD = 0.5

_SYMBOLS, _DIGITS, _MARKS, _SHOUTS = b"#*$%&|<>{}[]=_~^\\", b"0123456789", b".,;:?", b"!"
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_STOPS = frozenset(w.encode() for w in STOP_WORDS)

FEATURES = ("log_words", "word_bytes", "symbols", "digits", "marks", "shouts", "capitals", "distinct", "twice", "lines", "equal_lines", "stop_words", "per_stop")


def features(text: str | None) -> tuple[float, ...]:
    """Measures of a text, see FEATURES; zeros where there is nothing to measure."""
    t = text or ""
    raw = t.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        float(np.log1p(len(words))),
        min(size / n, 50.0),
        share(_SYMBOLS),
        share(_DIGITS),
        share(_MARKS),
        share(_SHOUTS),
        sum(map(len, _CAPITAL.findall(t))) / size,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        len(lines) / n,
        1.0 - len(set(lines)) / max(len(lines), 1),
        sum(map(_STOPS.__contains__, words)) / n,
        float(len(words) > 0),
    )


class Logistic(NamedTuple):
    """Weights over standardised measures and their squares; ``prior`` is the rate of good texts among those fitted on."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8.0, 8.0)
        return np.concatenate((np.ones((len(z), 1)), z, z * z), axis=1)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good against bad: the log odds without those of the prior, within +-12."""
        return np.clip(self.design(x) @ self.weights - _logit(self.prior), -12.0, 12.0)


def _logit(p: float) -> float:
    return float(np.log(p) - np.log1p(-p))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Logistic:
    """Ridge-penalised logistic regression by Newton steps. With one class or no rows: no evidence for any text."""
    width = len(FEATURES)
    prior = float((y.sum() + 1.0) / (len(y) + 2.0))
    empty = Logistic(np.zeros(width), np.ones(width), np.zeros(1 + 2 * width), prior)
    empty.weights[0] = _logit(prior)
    if len(y) == 0 or y.min() == y.max():
        return empty
    model = empty._replace(mean=x.mean(axis=0), scale=np.maximum(x.std(axis=0), 1e-6))
    d, w = model.design(x), empty.weights.copy()
    penalty = np.full(d.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(penalty), d.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return model._replace(weights=w)


def fit_on(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Logistic:
    """Fit on labelled documents: all, or about ``sample_rows`` of them by a hash of the key. Labels other than 0 and 1
    and keys without a document do not count; of rows that repeat a key one counts."""
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    n = usable.count()
    chosen = usable.where(F.pmod(F.xxhash64(key), F.lit(max(n, 1))) < sample_rows) if n > sample_rows else usable
    picked = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(chosen), key)  # at most about sample_rows rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py()) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("_y"), pa.array(rows, pa.list_(pa.float64()))], names=[key, "_y", "_x"])

    kind = docs.schema[key].dataType.simpleString()
    rows = picked.select(key, "_y", "_text").mapInArrow(measure, f"`{key}` {kind}, _y int, _x array<double>")
    with small_batches(docs.sparkSession):
        got = rows.groupBy(key).agg(F.min(F.struct("_x", "_y")).alias("r")).orderBy(key).select("r.*").collect()
    x = np.array([r["_x"] for r in got], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["_y"] for r in got], float))


def with_evidence(docs: DataFrame, model: Logistic, text: str = "text") -> DataFrame:
    """docs and _evidence, a column that the classifier adds row by row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(text)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.evidence(x))], names=[*b.schema.names, "_evidence"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(judge, f"{schema}, _evidence double")


def site_of_url(url: str) -> tuple[Column, Column]:
    """Host of a URL and the first part of its path."""
    return F.lower(F.parse_url(F.col(url), F.lit("HOST"))), F.regexp_extract(F.coalesce(F.parse_url(F.col(url), F.lit("PATH")), F.lit("")), "^/([^/]*)", 1)


class Rates(NamedTuple):
    """Global rate, and how many documents' worth the level above weighs against a host's and a path's own mean."""

    mean: float
    host_kappa: float
    path_kappa: float


_MOST = 1e9


def _kappa(within: float, between: float, groups: int, parents: int, n: int, n_squared: float) -> float:
    """Variance within groups over variance between groups of the same parent, by the analysis of variance."""
    if groups <= parents or n <= groups:
        return _MOST
    within /= n - groups
    typical = (n - n_squared) / (groups - parents)
    between = (between / (groups - parents) - within) / typical if typical > 0 else 0.0
    return float(np.clip(within / between, 1e-3, _MOST)) if between > 0 else _MOST


def site_rates(judged: DataFrame) -> tuple[DataFrame, Rates]:
    """From _host, _path and _p of all documents: (_host, _path, sums and counts of both levels), and the rates.

    Sums are partial before they are shuffled, so a host with most documents costs a row for each task.
    """
    paths = cut(judged.groupBy("_host", "_path").agg(F.count("*").alias("n_path"), F.sum("_p").alias("s_path"), F.sum(F.col("_p") * F.col("_p")).alias("q_path")))
    hosts = paths.groupBy("_host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"), F.sum(F.col("n_path") * F.col("n_path")).alias("_nn"))
    sites = cut(paths.join(hosts, "_host"), paths.count())
    own = F.col("s_path") * F.col("s_path") / F.col("n_path")
    r = sites.agg(F.count("*").alias("paths"), F.sum("n_path").alias("n"), F.sum("s_path").alias("s"), F.sum("q_path").alias("q"), F.sum(own).alias("by_path"), F.sum(F.col("n_path") * F.col("n_path") / F.col("n_host")).alias("nn")).first()
    h = hosts.agg(F.count("*").alias("hosts"), F.sum(F.col("s_host") * F.col("s_host") / F.col("n_host")).alias("by_host"), F.sum(F.col("n_host").cast("double") * F.col("n_host")).alias("nn")).first()
    if not r.n:
        return sites, Rates(0.5, _MOST, _MOST)
    mean = r.s / r.n
    host_kappa = _kappa(r.q - h.by_host, h.by_host - r.s * mean, h.hosts, 1, r.n, h.nn / r.n)
    path_kappa = _kappa(r.q - r.by_path, r.by_path - h.by_host, r.paths, h.hosts, r.n, r.nn)
    return sites, Rates(mean, host_kappa, path_kappa)


def _with_probability(df: DataFrame, model: Logistic, host: Column, path: Column) -> DataFrame:
    p = 1.0 / (1.0 + F.exp(-(F.col("_evidence") + F.lit(_logit(model.prior)))))
    null = "\u0000null"
    return df.withColumns({"_host": F.coalesce(host.cast("string"), F.lit(null)), "_path": F.coalesce(path.cast("string"), F.lit(null)), "_p": p})


def with_scores(judged: DataFrame, sites: DataFrame, rates: Rates, columns: Sequence[str], threshold: float) -> DataFrame:
    """columns, and evidence, host_rate, path_rate, score (0 to 1), kept; rates leave the document itself out.

    Sites join by their size: Spark broadcasts them below the session's threshold, and splits hot sites of a shuffled join.
    """
    host = (F.col("s_host") - F.col("_p") + rates.host_kappa * rates.mean) / (F.col("n_host") - 1 + rates.host_kappa)
    path = (F.col("s_path") - F.col("_p") + rates.path_kappa * F.col("_host_rate")) / (F.col("n_path") - 1 + rates.path_kappa)
    prior = F.least(F.greatest(F.col("_path_rate"), F.lit(0.02)), F.lit(0.98))
    odds = F.col("_evidence") + F.log(prior) - F.log(1.0 - prior)
    out = judged.join(sites.select("_host", "_path", "n_path", "s_path", "n_host", "s_host"), ["_host", "_path"]).withColumn("_host_rate", host).withColumn("_path_rate", path).withColumn("_score", 1.0 / (1.0 + F.exp(-odds)))
    return out.select(*columns, F.col("_evidence").alias("evidence"), F.col("_host_rate").alias("host_rate"), F.col("_path_rate").alias("path_rate"), F.col("_score").alias("score"), (F.col("_score") >= threshold).alias("kept"))


def classified(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: key, evidence, host_rate, path_rate, score, kept.

    host and path name the columns that say where a document is from; null ones are sites of their own. Null and empty
    texts are judged by their measures, all zero. Repeated rows each count. An empty table gives an empty result; without
    usable labels no text has evidence, and a score is its path's rate. A score at the threshold is kept. A text of any length
    is measured whole. Other columns are not read. Texts are read once.
    """
    model = fit_on(docs, labels, key, text)
    narrow = docs.select(F.col(key).alias("_key"), F.col(host).alias("_h"), F.col(path).alias("_q"), F.col(text).alias("_text"))
    judged = cut(_with_probability(with_evidence(narrow, model, "_text").drop("_text"), model, F.col("_h"), F.col("_q")))
    sites, rates = site_rates(judged)
    return with_scores(judged, sites, rates, ["_key"], threshold).withColumnRenamed("_key", key)


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of docs that ``classified`` keeps, with their columns. Texts are read and not shuffled: rows that are rejected
    are told by key, site and a hash of the text, and taken out.

    The classifier is fitted on ``labelled``, documents that the labels are of; without it, on docs.
    """
    model = fit_on(docs if labelled is None else labelled, labels, key, text)
    own = [f"_c{i}" for i in range(len(docs.columns))]  # names that nothing below uses
    name = dict(zip(docs.columns, own, strict=True))
    safe = docs.withColumnsRenamed(name)
    known = {"_k": F.col(name[key]), "_a": F.col(name[host]), "_b": F.col(name[path]), "_x": F.xxhash64(F.coalesce(name[text], F.lit("")))}
    measured = with_evidence(safe.select(*[c.alias(n) for n, c in known.items()], F.col(name[text]).alias("_text")), model, "_text").drop("_text")
    judged = cut(_with_probability(measured, model, F.col("_a"), F.col("_b")))
    sites, rates = site_rates(judged)
    bad = cut(with_scores(judged, sites, rates, list(known), threshold).where("not kept").select(*known).distinct(), judged.count())
    rows = without(safe, known, bad)
    return rows.select(*[F.col(c).alias(old) for old, c in name.items()])
