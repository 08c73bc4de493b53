"""Registered queries over the provided tables, and the same in SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numeric, text
from .functions.numeric import SPACE
from .operators import corpus, decay, memory, ranking, recall, scoring, segments, splits, telemetry
from .plans import lm
from .plans.model import decay_biases
from .sources import extract, results, telemetry_csv
from .sources.scan import spread
from .sources.scratch import scratch

BLOCK = 8  # one event in five ends a document, so short blocks are needed for states to be carried between them

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spread(_table(spark, sf_dir, name))


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sequences by user: an error ends a document, la is a gate of the value, v the value."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    seg = segments.segmented(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return seg.withColumn("la", numeric.log_decay(F.col("value") / 100 - 3)).withColumn("v", F.col("value"))


_SEG = """
ev AS (SELECT *, row_number() OVER w - 1 AS t, coalesce(lag(event_type) OVER w = 'error', false) AS reset FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
seg AS (SELECT event_id, user_id, ts, event_type, value, t, reset, sum(reset::INT) OVER (PARTITION BY user_id ORDER BY t)::BIGINT AS doc, -ln(1 + exp(value / 100 - 3)) AS la FROM ev)"""
_PREFIX = f"""{_SEG},
p AS (SELECT *, sum(la) OVER (PARTITION BY user_id, doc ORDER BY t) AS p FROM seg),
y AS (SELECT a.user_id, a.doc, a.t, sum(b.value * exp(a.p - b.p)) AS y FROM p a JOIN p b ON a.user_id = b.user_id AND a.doc = b.doc AND b.t <= a.t GROUP BY ALL)"""


@_query(f"WITH {_SEG} SELECT event_id, user_id, t, reset, doc FROM seg")
def q01_segments(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "user_id", "t", "reset", "doc")


@_query(f"WITH {_SEG} SELECT user_id, doc, count(*) AS n, min(t) AS first_t, max(t) AS last_t, round(sum(value), 6) AS total FROM seg GROUP BY ALL")
def q02_segment_stats(spark, sf_dir):
    """By the plan for sequences of any length."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    seg = segments.segmented_in_ranges(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return segments.segment_stats(seg, "user_id", "value").withColumn("total", _r(F.col("total")))


@_query(f"WITH {_PREFIX} SELECT user_id, doc, t, round(y, 6) AS y FROM y")
def q03_decay_prefix(spark, sf_dir):
    return decay.blocked(_events(spark, sf_dir), "user_id", BLOCK, levels=2).withColumn("y", _r(F.col("y")))


@_query(f"WITH {_PREFIX}, n AS (SELECT user_id, doc, max(t) AS t, count(*) AS n FROM seg GROUP BY ALL) SELECT n.user_id, n.doc, n.n, round(y.y, 6) AS state FROM n JOIN y ON n.user_id = y.user_id AND n.doc = y.doc AND n.t = y.t")
def q04_decay_state(spark, sf_dir):
    s = decay.final_state(_events(spark, sf_dir), "user_id", BLOCK)
    return s.select("user_id", "doc", "n", _r(F.col("state")).alias("state"))


@_query(f"""WITH {_SEG}, b AS (SELECT *, t // {BLOCK} AS blk FROM seg), p AS (SELECT *, sum(la) OVER (PARTITION BY user_id, doc, blk ORDER BY t) AS p, sum(la) OVER (PARTITION BY user_id, doc, blk) AS e FROM b)
SELECT user_id, doc, blk, round(sum(la), 6) AS la, round(sum(value * exp(e - p)), 6) AS v FROM p GROUP BY ALL""")
def q05_decay_partial_merge(spark, sf_dir):
    return decay.block_states(_events(spark, sf_dir), "user_id", BLOCK).select("user_id", "doc", "blk", _r(F.col("la")).alias("la"), _r(F.col("v")).alias("v"))


@_query(f"WITH {_SEG} SELECT event_id, round(0.3 * value + 0.7 * coalesce(lag(value) OVER (PARTITION BY user_id, doc ORDER BY t), 0), 6) AS shifted FROM seg")
def q06_token_shift(spark, sf_dir):
    return segments.token_shift(_events(spark, sf_dir), "user_id", "value", 0.3).select("event_id", _r(F.col("shifted")).alias("shifted"))


@_query(f"""WITH {_SEG} SELECT event_id, round(0.05 + 0.4 * value + 0.3 * coalesce(lag(value, 1) OVER w, 0) + 0.2 * coalesce(lag(value, 2) OVER w, 0) + 0.1 * coalesce(lag(value, 3) OVER w, 0), 6) AS conv
FROM seg WINDOW w AS (PARTITION BY user_id, doc ORDER BY t)""")
def q07_causal_conv(spark, sf_dir):
    return segments.causal_conv(_events(spark, sf_dir), "user_id", "value", (0.1, 0.2, 0.3, 0.4), 0.05).select("event_id", _r(F.col("conv")).alias("conv"))


@_query("""SELECT event_id, round(2 / (1 + exp(-(value / 50 - 1))), 6) AS beta, round(-ln(1 + exp(value / 100 - 3)), 6) AS log_alpha,
round(1 / (1 + exp(-0.5::DOUBLE)) * value + (1 - 1 / (1 + exp(-0.5::DOUBLE))) * 10, 6) AS mixed FROM events""")
def q08_gates(spark, sf_dir):
    e, v = _table(spark, sf_dir, "events"), F.col("value")
    return e.select("event_id", _r(numeric.write_gate(v / 50 - 1)).alias("beta"), _r(numeric.log_decay(v / 100 - 3)).alias("log_alpha"), _r(numeric.highway(v, F.lit(10.0), F.lit(0.5))).alias("mixed"))


@_query(f"WITH {_SEG}, b AS (SELECT *, t // {BLOCK} AS blk FROM seg) SELECT a.user_id, a.blk, count(*) AS pairs FROM b a JOIN b c ON a.user_id = c.user_id AND a.blk = c.blk AND a.doc = c.doc AND c.t <= a.t GROUP BY ALL")
def q09_masked_pairs(spark, sf_dir):
    return decay.masked_pairs(_events(spark, sf_dir), "user_id", BLOCK)


@_query("SELECT p_partkey, p_brand, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) WHERE r <= 3")
def q10_topk_ties(spark, sf_dir):
    return ranking.top_k(_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", 3, "p_size")


@_query("""WITH c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id, c.label AS best, list_dot_product(embedding::DOUBLE[], c.c) AS score FROM embeddings, c)
SELECT vec_id, best, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, best) AS r FROM s) WHERE r = 1""")
def q11_greedy(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p.m).alias("c"))
    table = centroids.agg(F.collect_list(F.struct(F.col("label").alias("best"), "c")).alias("_all"))  # one row: the labels' centroids
    scored = e.select("vec_id", "embedding").crossJoin(F.broadcast(table)).select("vec_id", "embedding", F.explode("_all").alias("k"))
    rows = scored.select("vec_id", F.col("k.best").alias("best"), numeric.dot(F.col("embedding"), F.col("k.c")).alias("score"))
    return ranking.greedy(rows, "vec_id", "best").withColumn("score", _r(F.col("score")))


@_query("""WITH r AS (SELECT user_id, event_id, value / 50 AS s FROM events), k AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY s DESC) AS r FROM r) WHERE r <= 5),
p AS (SELECT user_id, event_id, exp(s - max(s) OVER (PARTITION BY user_id)) / sum(exp(s)) OVER (PARTITION BY user_id) * exp(max(s) OVER (PARTITION BY user_id)) AS p FROM k),
m AS (SELECT * FROM (SELECT *, max(p) OVER (PARTITION BY user_id) AS best FROM p) WHERE p >= 0.9 * best)
SELECT user_id, event_id, round(p / sum(p) OVER (PARTITION BY user_id), 6) AS p FROM m""")
def q12_min_p(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("score"))
    return ranking.probabilities(rows, "user_id", temperature=50.0, k=5, min_p=0.9).select("user_id", "event_id", _r(F.col("p")).alias("p"))


@_query("SELECT user_id, round(max(value / 50) + ln(sum(exp(value / 50 - m))), 6) AS lse FROM (SELECT *, max(value / 50) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def q13_softmax_logsumexp(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", (F.col("value") / 50).alias("score"))
    return ranking.log_sum_exp(rows, "user_id").withColumn("lse", _r(F.col("lse")))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", "lang", F.posexplode(F.split("text", " ", -1)).alias("t", "tok"))


@_query("""WITH c AS (SELECT lang, tok, count(*) AS c FROM (SELECT lang, unnest(string_split(text, ' ')) AS tok FROM documents) GROUP BY ALL), n AS (SELECT lang, sum(c) AS n FROM c GROUP BY lang)
SELECT lang, n::BIGINT AS n, round(-sum(c * ln(c / n)) / n, 6) AS nll, round(exp(-sum(c * ln(c / n)) / n), 4) AS perplexity FROM c JOIN n USING (lang) GROUP BY lang, n""")
def q14_nll_ppl(spark, sf_dir):
    counts = _words(spark, sf_dir).groupBy("lang", "tok").agg(F.count("*").alias("c"))
    total = counts.groupBy("lang").agg(F.sum("c").alias("n"))  # one row a language
    g = counts.join(total, "lang").groupBy("lang", "n").agg((-F.sum(F.col("c") * F.log(F.col("c") / F.col("n"))) / F.col("n")).alias("nll"))
    return g.select("lang", "n", _r(F.col("nll")).alias("nll"), _r(F.exp("nll"), 4).alias("perplexity"))


@_query("""WITH s AS (SELECT conv_id, turn, role, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '^') AS prev FROM conversations), c AS (SELECT prev, role, count(*) AS c FROM s GROUP BY ALL),
p AS (SELECT prev, role, ln(c / sum(c) OVER (PARTITION BY prev)) AS lp, first(role) OVER (PARTITION BY prev ORDER BY c DESC, role) AS best FROM c)
SELECT conv_id, round(sum(lp), 6) AS logprob, bool_and(s.role = best) AS greedy FROM s JOIN p ON s.prev = p.prev AND s.role = p.role GROUP BY conv_id""")
def q15_loglik_greedy(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    steps = c.select("conv_id", F.col("role").alias("tok"), F.coalesce(F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("^")).alias("prev"))
    counts = steps.groupBy("prev", "tok").agg(F.count("*").alias("n"))
    w = Window.partitionBy("prev")
    model = counts.select("prev", "tok", F.log(F.col("n") / F.sum("n").over(w)).alias("logp"), F.first("tok").over(w.orderBy(F.desc("n"), "tok")).alias("best"))
    scored = scoring.continuation_scores(steps.join(model, ["prev", "tok"]), "conv_id")
    return scored.withColumn("logprob", _r(F.col("logprob")))


@_query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS tok, unnest(range(len(string_split(text, ' ')))) AS t FROM documents), c AS (SELECT tok, ln(count(*) / (SELECT count(*) FROM w)) AS lp FROM w GROUP BY tok)
SELECT doc_id, count(DISTINCT t // 64) AS windows, round(sum(lp), 4) AS logprob FROM w JOIN c USING (tok) GROUP BY doc_id""")
def q16_rolling_ll(spark, sf_dir):
    w = _words(spark, sf_dir).select("doc_id", "t", "tok")
    counts = w.groupBy("tok").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))  # one row
    logp = counts.select("tok", F.log(F.col("c") / total.scalar()).alias("logp"))
    return scoring.rolling_scores(w.join(logp, "tok"), "doc_id", 64).withColumn("logprob", _r(F.col("logprob"), 4))


@_query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def q17_keep_last_k(spark, sf_dir):
    return segments.keep_last(_events(spark, sf_dir), "user_id", 5).select("event_id", "user_id")


@_query("SELECT conv_id, turn, split_part(split_part(text, chr(10), 1), '. ', 1) AS cut FROM conversations")
def q18_stop_cut(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.cut_at_stops(F.col("text"), ["\n", "", ". "]).alias("cut"))


# Literal rows for scripts that the tables lack: one of each, a tie between the first and third, and more of the second.
_SCRIPTS = (("ನಮಸ್ಕಾರ", -1), ("வணக்கம்", -2), ("నమస్తే", -3), ("നമസ്കാരം", -4), ("abc", -5), ("నಕ", -6), ("ಕ தமிழ்", -7), ("", -8))
_SCRIPT_SQL = " UNION ALL ".join(f"SELECT {i}::BIGINT, '{s}'" for s, i in _SCRIPTS)
_COUNT_SQL = ", ".join(f"length(text) - length(regexp_replace(text, '[\\x{{{lo:04X}}}-\\x{{{hi:04X}}}]', '', 'g')) AS {code}" for code, lo, hi in text.SCRIPT_RANGES)


@_query(f"WITH d AS (SELECT doc_id, text FROM documents UNION ALL {_SCRIPT_SQL}), c AS (SELECT doc_id, {_COUNT_SQL} FROM d), m AS (SELECT *, greatest(kan, tam, tel, mal) AS m FROM c) SELECT doc_id, CASE WHEN m = 0 THEN 'eng' WHEN kan = m THEN 'kan' WHEN tam = m THEN 'tam' WHEN tel = m THEN 'tel' ELSE 'mal' END AS lang FROM m")
def q19_script_detect(spark, sf_dir):
    literal = spark.createDataFrame([(i, s) for s, i in _SCRIPTS], "doc_id bigint, text string")
    docs = _texts(spark, sf_dir).select("doc_id", "text").unionByName(literal)
    return docs.select("doc_id", text.detect_language(F.col("text")).alias("lang"))


@_query()
def q20_pretokens(spark, sf_dir):
    words = _texts(spark, sf_dir).select("doc_id", "text", text.pretokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").alias("n"), (F.array_join("w", "") == F.col("text")).alias("whole"), F.size(F.array_distinct("w")).alias("kinds"))


@_query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS tok, unnest(range(len(string_split(text, ' ')))) AS t FROM documents), g AS (SELECT doc_id, t, lag(tok, 2) OVER w || ' ' || lag(tok) OVER w || ' ' || tok AS g FROM w WINDOW w AS (PARTITION BY doc_id ORDER BY t)),
r AS (SELECT doc_id, g IS NOT NULL AND coalesce(t - lag(t) OVER (PARTITION BY doc_id, g ORDER BY t) <= 61, false) AS r FROM g) SELECT doc_id, count(*) AS n, sum(r::INT)::BIGINT AS repeated FROM r GROUP BY doc_id""")
def q21_ngram_repeat(spark, sf_dir):
    marked = segments.repeated_ngrams(_words(spark, sf_dir), "doc_id", "tok", 3, 64)
    return marked.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("repeated").cast("bigint")).alias("repeated"))


@_query("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '<|user|><eng> ' || text || ' <|assistant|>' ELSE text END, ' ' ORDER BY turn) AS prompt, string_agg('<eng> ' || text, ' ' ORDER BY turn) FILTER (WHERE role = 'user') AS base FROM conversations GROUP BY conv_id")
def q22_turn_template(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").withColumn("lang", text.detect_language(F.col("text")))
    part = F.when(F.col("role") == "user", text.user_turn(F.col("text"), F.col("lang"))).otherwise(F.col("text"))
    plain = F.when(F.col("role") == "user", text.base_prompt(F.col("text"), F.col("lang")))
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("a"), plain.alias("b")))).alias("p"))
    own = F.filter(F.transform("p", lambda x: x.b), lambda x: x.isNotNull())
    return turns.select("conv_id", F.array_join(F.transform("p", lambda x: x.a), " ").alias("prompt"), F.when(F.size(own) > 0, F.array_join(own, " ")).alias("base"))


@_query("SELECT conv_id, turn, role FROM (SELECT *, min(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS s FROM conversations) WHERE s IS NULL OR turn < s")
def q23_first_stop_filter(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("turn").alias("t"))
    return segments.before_first_stop(c, "conv_id", F.col("role") == "assistant").select("conv_id", "turn", "role")


_GAP = 7200.0


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: the power of views is unknown; the mask is k of props, shifted."""
    e = _table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") != "view", F.col("value")).alias("watts"), (F.col("value") / 2).alias("celsius"), k.alias("reasons"))


def _energy_sql(by: str) -> str:
    part, key = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return f"""WITH s AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, CASE WHEN event_type <> 'view' THEN value END AS watts, value / 2 AS celsius, (props->>'$.k')::BIGINT AS reasons FROM events),
n AS (SELECT *, lead(t) OVER w - t AS dt, lead(watts) OVER w AS w2 FROM s WINDOW w AS ({part}ORDER BY t, event_id)),
c AS (SELECT *, CASE WHEN dt > 0 AND dt <= {_GAP} AND watts IS NOT NULL AND w2 IS NOT NULL THEN dt ELSE 0 END AS covered FROM n),
g AS (SELECT {key}count(*) AS samples, sum(covered) AS cov, sum(CASE WHEN dt > 0 AND covered = 0 THEN dt ELSE 0 END) AS gap, sum(coalesce(covered * (watts + w2) / 2, 0)) AS joules, avg(celsius) AS mc, max(celsius) AS pc,
  sum(CASE WHEN coalesce(reasons, 0) & {telemetry.THERMAL} <> 0 THEN covered ELSE 0 END) AS th, sum(CASE WHEN coalesce(reasons, 0) & {telemetry.POWER_CAP} <> 0 THEN covered ELSE 0 END) AS pw FROM c {"GROUP BY " + by if by else ""})"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _r(F.col(c)) for c in columns})


@_query(f"{_energy_sql('user_id')} SELECT user_id, samples, round(cov / 3600, 6) AS hours_logged, round(gap / 3600, 6) AS hours_gap, round(joules / 3.6e6, 6) AS kwh, round(CASE WHEN cov > 0 THEN joules / cov ELSE 0 END, 6) AS mean_watts FROM g")
def q24_energy(spark, sf_dir):
    s = telemetry.energy_summary(_samples(spark, sf_dir), ["user_id"], _GAP)
    return _rounded(s.select("user_id", "samples", "hours_logged", "hours_gap", "kwh", "mean_watts"), "hours_logged", "hours_gap", "kwh", "mean_watts")


@_query(f"{_energy_sql('user_id')} SELECT user_id, round(mc, 6) AS mean_celsius, round(pc, 6) AS peak_celsius, round(CASE WHEN cov > 0 THEN th / cov ELSE 0 END, 6) AS share_thermal_throttled, round(CASE WHEN cov > 0 THEN pw / cov ELSE 0 END, 6) AS share_power_capped FROM g")
def q25_throttle_share(spark, sf_dir):
    s = telemetry.energy_summary(_samples(spark, sf_dir), ["user_id"], _GAP)
    return _rounded(s.select("user_id", "mean_celsius", "peak_celsius", "share_thermal_throttled", "share_power_capped"), "mean_celsius", "peak_celsius", "share_thermal_throttled", "share_power_capped")


@_query(f"{_energy_sql('')} SELECT samples, round(cov / 3600, 5) AS hours_logged, round(gap / 3600, 5) AS hours_gap, round(joules / 3.6e6, 5) AS kwh, 2.5e6::DOUBLE AS tokens, round(joules / 3.6e6 * 0.5, 5) AS kg_co2, 'gpu board only' AS co2_basis FROM g")
def q26_energy_global(spark, sf_dir):
    s = telemetry.energy_summary(_samples(spark, sf_dir), None, _GAP)
    s = telemetry.with_footprint(s, tokens=2_500_000, grid_kg_per_kwh=0.5, grid_source="test factor")
    return s.select("samples", *[_r(F.col(c), 5).alias(c) for c in ("hours_logged", "hours_gap", "kwh")], F.col("tokens").cast("double").alias("tokens"), _r(F.col("kg_co2"), 5).alias("kg_co2"), "co2_basis")


@_query("""WITH g AS (SELECT lang, count(*) AS n, sum(quality)::DOUBLE AS s FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, n, round(s / n, 6) AS rate, round((s / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(s / n * (1 - s / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS lo,
round((s / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(s / n * (1 - s / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS hi FROM g""")
def q27_wilson(spark, sf_dir):
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    g = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("s"))
    lo, hi = numeric.wilson(F.col("s"), F.col("n"))
    return g.select("lang", "n", _r(F.col("s") / F.col("n")).alias("rate"), _r(lo).alias("lo"), _r(hi).alias("hi"))


_CHOICE_SQL = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT vec_id, label, e, {leads} FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
s AS (SELECT vec_id, label, {dots} FROM c WHERE e5 IS NOT NULL) SELECT label, count(*) AS n, sum((s1 >= greatest(s2, s3, s4, s5))::INT)::BIGINT AS hits, round(avg(s1 - (s2 + s3 + s4 + s5) / 4), 6) AS gain FROM s GROUP BY label"""


@_query(_CHOICE_SQL.format(leads=", ".join(f"lead(e, {i}) OVER w AS e{i}" for i in range(1, 6)), dots=", ".join(f"list_dot_product(e, e{i}) AS s{i}" for i in range(1, 6))))
def q28_recall_choice(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    w = Window.partitionBy("label").orderBy("vec_id")
    near = e.withColumn("c", F.array(*[F.lead("embedding", i).over(w) for i in range(1, 6)])).where(F.element_at("c", 5).isNotNull())
    scores = near.select("vec_id", "label", F.posexplode(F.transform("c", lambda x: numeric.dot(F.col("embedding"), x))).alias("i", "score"))
    chosen = recall.choices(scores.withColumn("needle", F.col("i") == 0), "vec_id", "score", "needle")
    gains = scores.groupBy("vec_id", "label").agg((F.sum(F.when(F.col("i") == 0, F.col("score"))) - F.avg(F.when(F.col("i") > 0, F.col("score")))).alias("gain")).withColumn("dist", F.lit(0))
    cells = recall.recall_cells(gains.join(chosen, "vec_id"), ["label"], "dist", "gain", F.col("chosen"), F.col("chosen"))
    return cells.select("label", "n", F.round(F.col("choice") * F.col("n")).cast("bigint").alias("hits"), _r(F.col("gain")).alias("gain"))


_LEAK_SQL = " UNION ALL ".join(
    f"SELECT path, line, '{label}' AS label, left(regexp_replace(l, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'), 120) AS excerpt FROM x WHERE regexp_matches(l, '{pattern}')"
    for label, pattern in (("windows path", r"(^|[^A-Za-z])[A-Za-z]:\\{1,2}[A-Za-z_.]"), ("file url", "(?i)file:///"), ("user home", r"(?i)[\\/]Users[\\/][^\\/\s]+"), ("personal mail", r"(?i)[A-Za-z0-9._%+-]+@(gmail|outlook|hotmail|yahoo|proton)\."), ("blocked name", r"(?i)\b(thend|licensed)\b"))
)


@_query(f"WITH f AS (SELECT 'documents/' || doc_id AS path, text FROM documents UNION ALL SELECT 'pages/' || page_id, html FROM pages), s AS (SELECT path, string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM f), x AS (SELECT path, unnest(ls) AS l, unnest(range(1, len(ls) + 1))::INTEGER AS line FROM s) {_LEAK_SQL}")
def q29_leak_scan(spark, sf_dir):
    docs = _texts(spark, sf_dir).select(F.concat(F.lit("documents/"), "doc_id").alias("path"), "text")
    pages = _texts(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), "page_id").alias("path"), F.col("html").alias("text"))
    return text.scan_lines(docs.unionByName(pages), "path", "text", words=["thend", "licensed"])


@_query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size FROM documents")
def q30_sha_manifest(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size"))


@_query("SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def q31_set_diff(spark, sf_dir):
    return scoring.key_difference(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id")


@_query("SELECT count(*) AS rows, 0.0::DOUBLE AS max_diff, 0::BIGINT AS unmatched FROM events")
def q32_parity_max_diff(spark, sf_dir):
    e = _events(spark, sf_dir)
    p = scoring.parity(decay.pairwise(e, "user_id"), decay.blocked(e, "user_id", BLOCK, levels=3), ["user_id", "doc", "t"], "y")
    return p.withColumn("max_diff", _r(F.col("max_diff")))


@_query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t FROM embeddings)
SELECT a.vec_id, round(sum(pow(0.9::DOUBLE, a.t - b.t) * list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) / 8 * (b.vec_id % 7)), 6) AS y FROM e a JOIN e b ON a.label = b.label AND b.t <= a.t GROUP BY a.vec_id""")
def q33_assoc_memory(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    unit = segments.segmented(e, "label", ["vec_id"], F.lit(False)).withColumn("k", numeric.l2_normalised(F.col("embedding")))
    rows = unit.select("vec_id", "label", "doc", "t", F.log(F.lit(0.9)).alias("la"), "k", F.transform("k", lambda x: x / 8).alias("q"), F.array((F.col("vec_id") % 7).cast("double")).alias("v"))
    reads = memory.scanned_reads(rows, "label").select("label", "t", F.col("y")[0].alias("y"))
    return rows.select("vec_id", "label", "t").join(reads, ["label", "t"]).select("vec_id", _r(F.col("y")).alias("y"))


@_query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 > 0 THEN 'SMOKE-limit' || (n_nationkey % 3) || '-' ELSE '' END || left(repeat(n_name || '+', 12), 80) AS label, 'run --checkpoint <checkpoint> --checkpoint=<checkpoint>' AS command FROM nation""")
def q34_smoke_label(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    limit = F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey") % 3)
    command = text.redact(F.lit("run --checkpoint /w/m.bin --checkpoint=/w/m.bin"), "/w/m.bin")
    return n.select("n_nationkey", text.run_label(F.repeat(F.concat("n_name", F.lit("+")), 12), limit).alias("label"), command.alias("command"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sequences: a user turn that follows ends a document at the assistant's; characters are the value."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("double").alias("v"))
    seg = segments.segmented(c, "conv_id", ["turn"], F.col("role") == "assistant")
    return seg.withColumn("la", numeric.log_decay(F.col("v") / 100 - 3))


_SESSION_SQL = """c AS (SELECT conv_id, turn, role, length(text)::DOUBLE AS v, row_number() OVER w - 1 AS t, coalesce(lag(role) OVER w = 'assistant', false) AS reset FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, sum(reset::INT) OVER (PARTITION BY conv_id ORDER BY t)::BIGINT AS doc, -ln(1 + exp(v / 100 - 3)) AS la FROM c), p AS (SELECT *, sum(la) OVER (PARTITION BY conv_id, doc ORDER BY t) AS p FROM s)"""


@_query(f"WITH {_SESSION_SQL}, l AS (SELECT conv_id, doc, max(t) AS t, count(*) AS n FROM p GROUP BY ALL) SELECT l.conv_id, l.doc, l.n, round(sum(b.v * exp(a.p - b.p)), 6) AS state FROM l JOIN p a USING (conv_id, doc, t) JOIN p b ON a.conv_id = b.conv_id AND a.doc = b.doc GROUP BY ALL")
def q35_session_batch(spark, sf_dir):
    s = decay.final_state(_turns(spark, sf_dir), "conv_id", BLOCK)
    return s.select("conv_id", "doc", "n", _r(F.col("state")).alias("state"))


@_query(f"WITH {_SESSION_SQL} SELECT a.conv_id AS key, a.t, a.doc, round(sum(b.v * exp(a.p - b.p)), 6) AS y FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.doc = b.doc AND b.t <= a.t GROUP BY ALL")
def q36_stream_equals_batch(spark, sf_dir):
    """The stateful stream over the conversations' file, run to its end."""
    from .streaming.decay import decayed_stream

    path = f"{sf_dir}/conversations.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path + "*")
    chars = F.length("text").cast("double")
    keyed = rows.select(F.col("conv_id").alias("key"), F.col("turn").alias("t"), numeric.log_decay(chars / 100 - 3).alias("la"), chars.alias("v"), (F.col("role") == "assistant").alias("is_end"))
    folder = scratch(spark, "stream")
    sink = decayed_stream(keyed).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append")
    sink.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("key", "t", "doc", _r(F.col("y")).alias("y"))


@_query()
def q37_tiny_lm_score(spark, sf_dir):
    """Each assistant turn given the turn before it, whole texts as bytes, by the small model."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lag("text").over(w).alias("before"))
    asked = c.where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("req"), F.encode(F.coalesce("before", F.lit("")), "UTF-8").alias("ctx"), F.encode("text", "UTF-8").alias("cont"))
    scored = lm.loglikelihood(asked, lm.tiny_weights(), "req", chunk=64, context=1 << 20)
    return scored.select("req.conv_id", "req.turn", _r(F.col("logprob"), 4).alias("logprob"), "greedy")


@_query()
def q38_generate(spark, sf_dir):
    """A greedy reply of eight tokens, without a repeated trigram, to every user turn."""
    c = _table(spark, sf_dir, "conversations").where("role = 'user'")
    prompts = c.select(F.struct("conv_id", "turn").alias("req"), lm.byte_ids(F.col("text")).alias("ids"))
    return lm.generate(prompts, lm.tiny_weights(), "req", "ids", limit=8, no_repeat=3, chunk=64).select("req.conv_id", "req.turn", "reply")


@_query("SELECT i::INTEGER AS head, round(ln(exp(-ln(1 - pow(10::DOUBLE, -1 - 3.5 * i / 15))) - 1), 6) AS bias FROM range(16) t(i)")
def q39_decay_init(spark, sf_dir):
    return spark.createDataFrame([(i, float(b)) for i, b in enumerate(decay_biases(16))], "head int, bias double").withColumn("bias", _r(F.col("bias")))


@_query("""WITH c AS (SELECT tok, count(*) AS c FROM (SELECT unnest(string_split(text, ' ')) AS tok FROM documents) GROUP BY tok), n AS (SELECT sum(c) AS n FROM c),
d AS (SELECT lang, doc_id, unnest(string_split(text, ' ')) AS tok FROM documents), s AS (SELECT lang, sum(ln(c / n)) AS lp, count(*) AS k FROM d JOIN c USING (tok), n GROUP BY lang), b AS (SELECT lang, sum(octet_length(encode(text))) AS b FROM documents GROUP BY lang)
SELECT lang, round(-lp / ln(2::DOUBLE) / b, 6) AS bits_per_byte, round(k / b, 6) AS tokens_per_byte FROM s JOIN b USING (lang)""")
def q40_bits_per_byte(spark, sf_dir):
    d = _texts(spark, sf_dir).select("doc_id", "lang", "text")
    w = d.select("lang", F.explode(F.split("text", " ", -1)).alias("tok")).groupBy("lang", "tok").agg(F.count("*").alias("k"))
    counts = w.groupBy("tok").agg(F.sum("k").alias("c"))
    n = counts.agg(F.sum("c").alias("total"))  # one row
    logs = w.join(counts.select("tok", F.log(F.col("c") / n.scalar()).alias("lp")), "tok").groupBy("lang").agg(F.sum(F.col("k") * F.col("lp")).alias("logp"), F.sum("k").alias("n"))
    sizes = d.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size"))
    out = scoring.bits_per_byte(logs.join(sizes, "lang"), "lang", "logp", "size")
    return _rounded(out, "bits_per_byte", "tokens_per_byte")


@_query(f"""WITH {_SEG}, l AS (SELECT user_id, max(doc) AS doc FROM seg GROUP BY user_id), o AS (SELECT seg.user_id, value, row_number() OVER (PARTITION BY seg.user_id ORDER BY t DESC) AS r FROM seg JOIN l ON seg.user_id = l.user_id AND seg.doc = l.doc)
SELECT user_id, coalesce(max(value) FILTER (WHERE r = 3), 0) AS a, coalesce(max(value) FILTER (WHERE r = 2), 0) AS b, max(value) FILTER (WHERE r = 1) AS c FROM o GROUP BY user_id""")
def q41_conv_history(spark, sf_dir):
    h = segments.stencil_history(_events(spark, sf_dir), "user_id", "value", 3)
    return h.select("user_id", *[F.element_at("history", i + 1).alias(c) for i, c in enumerate("abc")])


@_query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))), 5) AS unit,
round(list_sum(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e) / len(e) + 1e-5) * 0.5)), 5) AS rms, round(list_sum(list_transform(e, lambda x: x / (1 + exp(-x)))), 5) AS silu FROM v""")
def q42_norms(spark, sf_dir):
    """Each vector under three functions, its components added up."""
    total = lambda a: _r(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 5)
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", total(numeric.l2_normalised(F.col("e"))).alias("unit"), total(numeric.rms_normalised(F.col("e"), [0.5] * 64)).alias("rms"), total(F.transform("e", numeric.silu)).alias("silu"))


_LINES = ("/lang kan", "/lang xyz", "/auto", "/new", "/kan namaste", "/kan", "/foo bar", "  hello there ", "/lang auto", "/eng  two  words ", "\t/lang\tkan", "\t/lang kan", "/new\tx", "/new x", "/", "\u3000/auto\u00a0", "/kan \t", "\x1c/tam \u0ba4 \x85", "//new")
_CODES = ", ".join(f"'{x}'" for x in text.LANGUAGES)


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def _sql_text(x: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in x) or "''"


@_query(f"""WITH l AS (SELECT unnest([{", ".join(map(_sql_text, _LINES))}]) AS line UNION ALL SELECT '/' || CASE conv_id % 5 WHEN 0 THEN 'lang' WHEN 1 THEN 'new' WHEN 2 THEN 'kan' WHEN 3 THEN 'say' ELSE '' END || ' ' || text FROM conversations),
c AS (SELECT line, {_stripped("line")} AS c FROM l), s AS (SELECT line, c, c LIKE '/%' AS cmd, split_part(substr(c, 2), ' ', 1) AS w FROM c), r AS (SELECT *, {_stripped("substr(c, length(w) + 3)")} AS rest FROM s),
k AS (SELECT *, CASE WHEN NOT cmd THEN 'message' WHEN w = 'lang' AND rest IN ({_CODES}, 'auto') THEN 'lang' WHEN w IN ('auto', 'new') THEN w WHEN w IN ({_CODES}) AND rest <> '' THEN 'once' ELSE 'unknown' END AS command FROM r)
SELECT line, command, CASE command WHEN 'lang' THEN rest WHEN 'once' THEN w END AS argument, CASE command WHEN 'message' THEN c WHEN 'once' THEN rest END AS message FROM k""")
def q43_commands(spark, sf_dir):
    lines = spark.createDataFrame([(x,) for x in _LINES], "line string")
    first = F.element_at(F.array(*map(F.lit, ("lang", "new", "kan", "say", ""))), (F.col("conv_id") % 5 + 1).cast("int"))
    typed = _table(spark, sf_dir, "conversations").select(F.concat(F.lit("/"), first, F.lit(" "), "text").alias("line"))
    command, argument, message = text.parse_command(F.col("line"))
    return lines.unionAll(typed).select("line", command.alias("command"), argument.alias("argument"), message.alias("message"))


@_query("""SELECT event_id, event_id AS back, event_id AS plain, NULL::BIGINT AS bad, event_id - 9223372036854775807 - 1 AS high, -event_id AS negative, event_id::DOUBLE / 8 AS number, NULL::DOUBLE AS typed, (event_id || '000')::DOUBLE AS grouped FROM events""")
def q44_parsers(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id")
    digits, number = F.lower(F.hex("event_id")), F.col("event_id").cast("string")
    return e.select(
        "event_id",
        numeric.parse_hex(F.concat(F.lit("0x0000000000000000"), digits)).alias("back"),
        numeric.parse_hex(F.concat(F.lit("\t"), digits, F.lit(" "))).alias("plain"),
        numeric.parse_hex(F.concat(digits, F.lit("zz"))).alias("bad"),
        numeric.parse_hex(F.concat(F.lit("0X8"), F.lpad(digits, 15, "0"))).alias("high"),
        numeric.parse_hex(F.concat(F.lit("-0x"), digits)).alias("negative"),
        numeric.parse_number((F.col("event_id") / 8).cast("string")).alias("number"),
        numeric.parse_number(F.concat(number, F.lit("d"))).alias("typed"),
        numeric.parse_number(F.concat(F.lit(" +"), number, F.lit("_000 "))).alias("grouped"),
    )


@_query("""WITH s AS (SELECT lang, ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT % 10 AS split FROM documents)
SELECT lang, split::INTEGER AS split, n, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM (SELECT lang, split, count(*) AS n FROM s GROUP BY ALL)""")
def q45_split_balance(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("lang", splits.hash_split(F.col("doc_id"), 10).alias("split"))
    return splits.split_balance(d, "split", "lang").withColumn("share", _r(F.col("share")))


@_query(f"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT doc_id, 0, 'probe', text FROM ({_SCRIPT_SQL}) p(doc_id, text)),
n AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next, string_split(text, ' ') AS w FROM c), g AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g, {_COUNT_SQL} FROM n)
SELECT role, count(*) AS n, round(avg((greatest(kan, tam, tel, mal) = 0)::INT), 6) AS script_ok, round(avg((len(g) > len(list_distinct(g)))::INT), 6) AS loop_rate, round(avg((text = coalesce(next, text))::INT), 6) AS exact FROM g GROUP BY role""")
def q46_reply_rates(spark, sf_dir):
    """Replies that say a run of three words twice, and, among the probes, some in other scripts."""
    probes = spark.createDataFrame([(i, 0, "probe", s) for s, i in _SCRIPTS], "conv_id bigint, turn bigint, role string, text string")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probes).withColumn("w", F.split("text", " ", -1))
    grams = F.when(F.size("w") >= 3, F.expr("transform(sequence(1, size(w) - 2), i -> array_join(slice(w, i, 3), ' '))")).otherwise(F.array().cast("array<string>"))
    c = c.withColumn("g", grams).select("role", "text", F.coalesce(F.lead("text").over(w), F.col("text")).alias("want"), F.lit("eng").alias("lang"), (F.size("g") > F.size(F.array_distinct("g"))).alias("looped"))
    return _rounded(splits.reply_rates(c, "role", "text", "lang", "want", "looped"), "script_ok", "loop_rate", "exact")


@_query("SELECT i::INTEGER AS i, name, round(avg(x), 6) AS value FROM (SELECT label::VARCHAR AS name, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL")
def q47_average_weights(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("checkpoint"), F.col("label").cast("string").alias("name"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "value"))
    return splits.average_weights(e).withColumn("value", _r(F.col("value")))


@_query()
def q48_whole_packing(spark, sf_dir):
    """Whole conversations in containers of 512 words, first fit, longest first: what of each is learned, prompt and padding."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "role", F.size(corpus.words(F.col("text"))).cast("bigint").alias("n"))
    items = c.groupBy("conv_id").agg((F.sum("n") + 1).alias("length"), (F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)) + 1).alias("learned"))
    packed = corpus.packed_whole(items, "conv_id", capacity=512)
    return packed.groupBy("container").agg(F.count("*").alias("n"), F.sum("length").alias("used"), F.sum("learned").alias("learned"), (F.lit(512) - F.sum("learned")).alias("ignored"))


_GRAMS = "list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' ')))"


@_query(f"""WITH b AS (SELECT DISTINCT unnest({_GRAMS}) AS g FROM (SELECT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark)),
d AS (SELECT doc_id, unnest({_GRAMS}) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents))
SELECT doc_id, count(*) AS n_grams FROM d JOIN b USING (g) GROUP BY doc_id""")
def q49_contaminated(spark, sf_dir):
    return corpus.contaminated(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark"), "doc_id", 8)


_TIER_SQL = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{pattern}') THEN '{tier}'" for tier, pattern in corpus.LICENCE_PATTERNS) + " ELSE 'unlicensed' END"
_RULE_SQL = "CASE tier " + " ".join(f"WHEN '{t}' THEN '{r}'" for t, r in corpus.TIERS.items()) + " END"


@_query(f"""WITH d AS (SELECT source, length(coalesce(text, '')) AS c, {_TIER_SQL} AS tier, regexp_extract(source, '[0-9]+')::INT AS k FROM documents),
r AS (SELECT *, CASE WHEN {_RULE_SQL} <> 'case' THEN {_RULE_SQL} WHEN k % 2 = 1 THEN 'undecided' WHEN k % 4 = 0 THEN 'accepted' ELSE 'refused' END AS reason FROM d)
SELECT source, tier, reason, reason IN ('used', 'accepted') AS admitted, count(*) AS n, sum(c)::BIGINT AS chars FROM r GROUP BY ALL""")
def q50_licence_ledger(spark, sf_dir):
    """Every other source has a decision, and every fourth is accepted."""
    docs = _texts(spark, sf_dir).select("doc_id", "source", "text")
    k = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    decisions = docs.select("source").distinct().where(k % 2 == 0).select("source", (k % 4 == 0).alias("accepted"))
    return corpus.ledger(corpus.admitted(docs, decisions))


@_query("""WITH p AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), c AS (SELECT doc_id, unnest(range(0, (len(w) - 1) // 64 + 1)) AS chunk, w FROM p WHERE len(w) > 0),
k AS (SELECT doc_id, chunk, w[chunk * 64 + 1 : chunk * 64 + 64] AS t FROM c), z AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM k),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t FROM benchmark), u AS (SELECT doc_id, chunk, len(t) AS l, unnest(t) AS t FROM k),
tf AS (SELECT doc_id, chunk, l, t, count(*) AS tf FROM u WHERE t IN (SELECT t FROM q) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (SELECT item_id, doc_id, chunk, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score FROM q JOIN tf USING (t) JOIN df USING (t), z GROUP BY ALL)
SELECT item_id, doc_id, chunk::INTEGER AS chunk, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk) AS rank FROM s) WHERE rank <= 3""")
def q51_bm25(spark, sf_dir):
    passages = corpus.chunks(_texts(spark, sf_dir), "doc_id", 64)
    items = _table(spark, sf_dir, "benchmark").select("item_id", corpus.words(F.col("text")).alias("tokens"))
    return corpus.bm25(items, passages, "item_id", ["doc_id", "chunk"], 3)


@_query()
def q52_page_text(spark, sf_dir):
    """What a reader of each page sees."""
    pages = _texts(spark, sf_dir, "pages")
    return pages.select("page_id", extract.extracted(F.col("html"), F.lit("html")).alias("text"))


@_query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE lang = 'fr') AS f FROM documents WHERE lang IS NOT NULL), r AS (SELECT CASE WHEN f >= 0.4 * n THEN 1 ELSE (f / 0.4 - f) / (n - f) END AS r FROM c),
d AS (SELECT lang, ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT / 4294967296.0 AS u FROM documents WHERE lang IS NOT NULL) SELECT lang, count(*) AS n FROM d, r WHERE lang = 'fr' OR u < r GROUP BY lang""")
def q53_mixture_floor(spark, sf_dir):
    """Documents thinned until two in five are French."""
    return corpus.with_mixture_floor(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", {"fr": 0.4}).groupBy("lang").agg(F.count("*").alias("n"))


@_query("""WITH e AS (SELECT user_id, event_id, event_type AS tok, value - 50 AS s, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS recent FROM events)
SELECT event_id, round(CASE WHEN coalesce(list_contains(recent, tok), false) THEN CASE WHEN s > 0 THEN s / 1.16::DOUBLE ELSE s * 1.16::DOUBLE END ELSE s END, 6) AS score FROM e""")
def q54_ring_penalty(spark, sf_dir):
    """Events as candidates, made worse if one of the user's last three was of the same type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, -1)
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("tok"), (F.col("value") - 50).alias("score"), F.collect_list("event_type").over(w).alias("recent"))
    return ranking.penalised(e, "recent", 1.16).select("event_id", _r(F.col("score")).alias("score"))


@_query(f"""WITH {_SEG}, p AS (SELECT *, sum(la + ln(0.5::DOUBLE)) OVER (PARTITION BY user_id, doc ORDER BY t) AS p FROM seg)
SELECT a.event_id, round(sum(0.5 * b.value * exp(a.p - b.p)), 6) AS y FROM p a JOIN p b ON a.user_id = b.user_id AND a.doc = b.doc AND b.t <= a.t GROUP BY ALL""")
def q55_delta_memory(spark, sf_dir):
    """With one key a write of what is not predicted yet is a decay by half the rest."""
    one = F.array(F.lit(1.0))
    e = _events(spark, sf_dir).select("event_id", "user_id", "doc", "t", "la", F.lit(0.5).alias("beta"), one.alias("q"), one.alias("k"), F.array("value").alias("v"))
    reads = memory.delta_reads(e, "user_id").select("user_id", "doc", "t", F.col("y")[0].alias("y"))
    return e.select("event_id", "user_id", "doc", "t").join(reads, ["user_id", "doc", "t"]).select("event_id", _r(F.col("y")).alias("y"))


_LOG_HEADS = ("timestamp, power.draw [W], temperature.gpu, clocks_event_reasons.active", "timestamp, clocks_throttle_reasons.active, name, power.draw [W], temperature.gpu")


@_query("""SELECT ('f' || user_id % 4) AS device, epoch_us(ts) AS us, CASE WHEN event_type <> 'view' THEN value END AS watts, value / 2 AS celsius, (props->>'$.k')::BIGINT AS reasons FROM events WHERE event_id % 7 <> 0""")
def q56_telemetry_log(spark, sf_dir):
    """Events written as four logs, of two layouts, and read back: unknown powers, quoted commas, cut-off lines and second headers."""
    e = _samples(spark, sf_dir).withColumn("device", F.concat(F.lit("f"), F.col("user_id") % 4))
    ts, watts = F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSSSSS"), F.coalesce(F.col("watts").cast("string"), F.lit("[N/A]"))
    mask = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("reasons")), 16, "0"))
    even = F.concat_ws(", ", ts, watts, F.col("celsius").cast("string"), mask)
    odd = F.concat_ws(", ", ts, mask, F.lit('"card, of two"'), watts, F.col("celsius").cast("string"))
    is_even = F.col("device").isin("f0", "f2")
    line = F.when(F.col("event_id") % 7 == 0, F.left(F.when(is_even, even).otherwise(odd), F.lit(20))).otherwise(F.when(is_even, even).otherwise(odd))
    heads = spark.createDataFrame([(f"f{i}", k, _LOG_HEADS[i % 2]) for i in range(4) for k in (-1, 50)], "device string, event_id bigint, value string")
    rows = e.select("device", "event_id", line.alias("value")).unionByName(heads)
    folder = scratch(spark, "logs")
    rows.repartition("device").sortWithinPartitions("device", "event_id").select("device", "value").write.partitionBy("device").text(folder)
    read = telemetry_csv.read_log(spark, [f"{folder}/device=f{i}" for i in range(4)], "path")
    return read.select(F.regexp_extract("path", "device=(f[0-9])", 1).alias("device"), F.unix_micros("ts").alias("us"), "watts", "celsius", "reasons")


@_query("SELECT role, conv_id, turn, text FROM conversations")
def q57_samples(spark, sf_dir):
    """Turns written as samples of a task each, a JSON line a row, and read back."""
    folder = scratch(spark, "samples")
    results.write_samples(_table(spark, sf_dir, "conversations").select("role", "conv_id", "turn", "text"), folder, "role")
    return spark.read.schema("role string, conv_id bigint, turn bigint, text string").json(folder)


@_query("""SELECT user_id, round(-sum(w * lp) / sum(w), 6) AS loss FROM (SELECT user_id, ln(value / 200 + 0.25) AS lp, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 0.5 ELSE 1 END AS w FROM events) GROUP BY user_id""")
def q58_weighted_ce(spark, sf_dir):
    """Errors are ignored, clicks are end tokens of half the weight."""
    target = F.when(F.col("event_type") == "error", -100).when(F.col("event_type") == "click", 0).otherwise(1)
    e = _table(spark, sf_dir, "events").select("user_id", F.log(F.col("value") / 200 + 0.25).alias("logp"), target.alias("target"))
    return scoring.weighted_cross_entropy(e, "logp", "target", 0, 0.5, by=["user_id"]).withColumn("loss", _r(F.col("loss")))


@_query("""SELECT doc_id, n, batch FROM (SELECT doc_id, length(text) AS n, (row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1) // 32 AS batch FROM documents)""")
def q59_batches(spark, sf_dir):
    """Documents longest first, in batches of 32."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"))
    return scoring.batches(d, 32, "n", ["doc_id"])


@_query("""WITH s AS (SELECT label, vec_id % 3 AS layer, i AS head, abs(x) / sum(abs(x)) OVER (PARTITION BY vec_id) AS share FROM (SELECT vec_id, label, unnest(embedding[1:8])::DOUBLE AS x, unnest(range(8)) AS i FROM embeddings)),
h AS (SELECT label, layer, head, avg(share) AS m FROM s GROUP BY ALL), l AS (SELECT label, layer, max(m) AS share FROM h GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m DESC, layer, head) AS r FROM h)
SELECT l.label, l.layer, round(l.share, 6) AS share, top FROM l JOIN (SELECT label, string_agg(layer || '.' || head, ', ' ORDER BY r) AS top FROM b WHERE r <= 5 GROUP BY label) USING (label)""")
def q60_state_shares(spark, sf_dir):
    """Shares of eight components as of heads, in three layers."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 3).alias("layer"), F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double"))).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a + x)
    items = e.select("label", "layer", F.posexplode(F.transform("x", lambda x: x / total)).alias("head", "share"))
    return recall.state_shares(items, ["label"]).select("label", "layer", _r(F.col("share")).alias("share"), F.regexp_replace("top_heads", "=[0-9.,]+(?=, |$)", "").alias("top"))
