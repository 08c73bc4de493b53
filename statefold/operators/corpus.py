"""What happens to texts before training: leaks of evaluation items, licences, language shares, chunk retrieval, whole-document packing."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tiers of licences, from the most to the least restricted, with what is done about them.
TIERS = {"training-blocked": "never", "noncommercial": "never", "model-generated": "case", "unlicensed": "case", "copyleft": "used", "attribution": "used", "permissive": "used"}

#: What a text says about its licence; the first that matches counts, a text that says nothing is unlicensed.
LICENCE_PATTERNS = (
    ("training-blocked", r"(?i)\b(?:no ai training|not (?:be )?used (?:for|to) train)"),
    ("noncommercial", r"(?i)\b(?:CC[ -]BY-NC|non-?commercial use only)"),
    ("model-generated", r"(?i)\bgenerated by (?:an ai|a language) model\b"),
    ("copyleft", r"(?i)\b(?:CC[ -]BY-SA|GFDL|GNU (?:Affero |Lesser )?General Public License|[AL]?GPL)"),
    ("attribution", r"(?i)\b(?:CC[ -]BY|ODC-By)"),
    ("permissive", r"(?i)\b(?:CC0|public domain|MIT License|Apache License|BSD License)"),
)

IGNORED = -100  # the label of prompts and padding


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case; null: none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def ngrams(tokens: str, n: int) -> Column:
    """The distinct n-grams of an array column, joined by spaces; none where it has fewer than n."""
    all_ = F.expr(f"transform(sequence(1, size(`{tokens}`) - {n - 1}), i -> array_join(slice(`{tokens}`, i, {n}), ' '))")
    return F.when(F.size(tokens) >= n, F.array_distinct(all_)).otherwise(F.array().cast("array<string>"))


def contaminated(docs: DataFrame, items: DataFrame, key: str, n: int = 8, text: str = "text") -> DataFrame:
    """(key, n_grams): documents that share a run of n words with an evaluation item, and how many different ones.

    Only distinct n-grams of a document meet the items' distinct ones; the items' side is broadcast where Spark finds it
    small enough, and shuffled otherwise. Texts under n words share nothing. A null key is a key.
    """
    asked = items.select(words(F.col(text)).alias("_w")).select(F.explode(ngrams("_w", n)).alias("_g")).distinct()
    own = docs.select(F.col(key), words(F.col(text)).alias("_w")).select(key, F.explode(ngrams("_w", n)).alias("_g"))
    return own.join(asked, "_g", "left_semi").groupBy(key).agg(F.count_distinct("_g").alias("n_grams"))


def decontaminated(docs: DataFrame, items: DataFrame, key: str, n: int = 8, text: str = "text") -> DataFrame:
    """docs without the contaminated ones."""
    bad = contaminated(docs, items, key, n, text).select(F.col(key).alias("_bad"))
    return docs.join(bad, F.col(key).eqNullSafe(F.col("_bad")), "left_anti")


def licence_tier(text: Column) -> Column:
    tier = None
    for name, pattern in LICENCE_PATTERNS:
        tier = F.when(text.rlike(pattern), name) if tier is None else tier.when(text.rlike(pattern), name)
    return tier.otherwise("unlicensed")


def admitted(docs: DataFrame, decisions: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """docs with tier, admitted and reason. decisions(source, accepted): case by case; a source without one is not taken.

    Reasons: used, accepted, refused, undecided, never. decisions must name a source once.
    """
    tiers = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    known = decisions.select(F.col(source).alias("_source"), F.col("accepted").alias("_accepted"))
    judged = docs.withColumn("tier", licence_tier(F.coalesce(F.col(text), F.lit("")))).join(known, F.col(source) == F.col("_source"), "left")
    rule = F.element_at(tiers, F.col("tier"))
    reason = F.when(rule != "case", rule).when(F.col("_accepted").isNull(), "undecided").when(F.col("_accepted"), "accepted").otherwise("refused")
    return judged.withColumn("reason", reason).withColumn("admitted", F.col("reason").isin("used", "accepted")).drop("_source", "_accepted")


def ledger(judged: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, tier, reason, admitted, n, chars): what was taken of each source and what not, and why."""
    return judged.groupBy(source, "tier", "reason", "admitted").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce(text, F.lit("")))).alias("chars"))


def uniform(key: Column) -> Column:
    """A number from 0 to 1 by a digest of the key, the same on every engine."""
    return F.conv(F.left(F.md5(key.cast("string").cast("binary")), F.lit(8)), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def mixture_rates(counts: Mapping[str, int], floors: Mapping[str, float]) -> dict[str, float]:
    """Share of each group that is kept, so that every group with a floor has at least that share of what is kept.

    As much is kept as the scarcest group allows, which is kept whole. Others are thinned alike, but not below their floors.
    """
    if not all(0 < f for f in floors.values()) or sum(floors.values()) >= 1:
        raise ValueError("floors must be positive and leave room for others")
    wanted = {g: f for g, f in floors.items() if counts.get(g)}
    total = min([sum(counts.values()), *(counts[g] / f for g, f in wanted.items())])
    at_floor: dict[str, float] = {}
    while True:
        rest = sum(n for g, n in counts.items() if g not in at_floor)
        rate = min((total - sum(at_floor.values())) / rest, 1.0) if rest else 1.0
        more = {g: f * total for g, f in wanted.items() if g not in at_floor and f * total > rate * counts[g]}
        if not more:
            return {g: min(at_floor[g] / n, 1.0) if g in at_floor else rate for g, n in counts.items()}
        at_floor |= more


def with_mixture_floor(docs: DataFrame, group: str, key: str, floors: Mapping[str, float]) -> DataFrame:
    """docs thinned by ``mixture_rates`` with a digest of the key. Groups are few: their counts go to the driver."""
    counts = {r[0]: r[1] for r in docs.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*")).collect()}
    rates = mixture_rates(counts, floors)
    if not rates:
        return docs.limit(0)
    rate = F.element_at(F.create_map(*[x for g, r in sorted(rates.items()) for x in (F.lit(g), F.lit(r))]), F.col(group))
    return docs.where(uniform(F.col(key)) < rate)


def chunks(docs: DataFrame, key: str, size: int = 64, text: str = "text") -> DataFrame:
    """(key, chunk, tokens): runs of ``size`` words of each text, the last one shorter."""
    own = docs.select(key, words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    cut = F.expr(f"transform(sequence(0, cast((size(_w) - 1) div {size} as int)), i -> slice(_w, i * {size} + 1, {size}))")
    return own.select(key, F.posexplode(cut).alias("chunk", "tokens"))


_ASKED = 1_000_000  # words of queries that are looked for in one pass over the passages
_AT_ONCE = 1 << 21  # scores of passages for queries that a task holds together


def _met(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of a batch's passages (null: 0); passage, number of the term and count of each different term in a passage."""
    tokens = batch.column("tokens")
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
    code = pc.fill_null(pc.index_in(tokens.flatten(), value_set=terms), -1).to_numpy().astype(np.int64)
    row, hit = np.repeat(np.arange(len(sizes)), sizes), code >= 0
    pairs, tf = np.unique(row[hit] * len(terms) + code[hit], return_counts=True)
    return sizes, pairs // len(terms), pairs % len(terms), tf


def _frequencies(passages: DataFrame, terms: pa.Array) -> tuple[np.ndarray, int, float]:
    """In how many passages each term is, how many there are, and their mean length. A task sends a row a term at most."""
    given = passages.sparkSession.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = given.value
        n = np.zeros(len(terms) + 3, np.int64)  # then: passages, those with tokens, their tokens
        for batch in batches:
            sizes, _, code, _ = _met(batch, terms)
            n[:-3] += np.bincount(code, minlength=len(terms))
            n[-3:] += len(sizes), len(sizes) - batch.column("tokens").null_count, sizes.sum()
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    rows = passages.select("tokens").mapInArrow(counted, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(terms) + 3, np.int64)
    n[[r["at"] for r in rows]] = [r["n"] for r in rows]
    return n[:-3], int(n[-3]), n[-1] / max(n[-2], 1)


def _best(table: pa.Table, query: str, ids: list[str], k: int) -> pa.Table:
    """The k best rows of each query, by score and then ids."""
    order = [("_q", "ascending"), ("score", "descending"), *[(c, "ascending") for c in ids]]
    table = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_start"))
    q = table.column("_q").to_numpy()
    begins = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    return table.filter(pa.array(np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q)))) < k))


def _leading(asked: DataFrame, passages: DataFrame, query: str, ids: list[str], k: int, k1: float, b: float) -> DataFrame:
    """(query, ids, score): what each task finds best for each query of asked(query, _t)."""
    table = asked.toArrow().combine_chunks()
    terms = pc.unique(table.column("_t"))
    coded = pc.dictionary_encode(table.column(query), null_encoding="encode").combine_chunks()
    coded = coded if isinstance(coded, pa.DictionaryArray) else coded.chunk(0) if coded.num_chunks else pa.array([], table.schema.field(query).type).dictionary_encode()
    names, of, term = coded.dictionary, coded.indices.to_numpy(), pc.index_in(table.column("_t"), value_set=terms).to_numpy()
    df, n, mean = _frequencies(passages, terms)
    idf = np.log(1.0 + (n - df + 0.5) / (df + 0.5))
    order = np.argsort(term, kind="stable")
    begin = np.searchsorted(term[order], np.arange(len(terms) + 1))
    given = passages.sparkSession.sparkContext.broadcast((terms, names, idf, of[order].astype(np.int64), begin))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, names, idf, askers, begin = given.value
        held, least = None, np.zeros(len(names))  # the best so far, and the last score that is among them
        for batch in batches if len(terms) else ():
            sizes, row, code, tf = _met(batch, terms)
            weight = idf[code] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[row] / mean)))
            step = max(1, _AT_ONCE // len(names))
            for at in range(0, batch.num_rows, step):
                i, j = np.searchsorted(row, (at, at + step))
                many = np.diff(begin)[code[i:j]]
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                cell = np.repeat(row[i:j] - at, many) * len(names) + askers[np.repeat(begin[code[i:j]], many) + nth]
                score = np.bincount(cell, np.repeat(weight[i:j], many), step * len(names)).reshape(step, -1)
                last = np.partition(score, max(step - k, 0), axis=0)[max(step - k, 0)]
                r, q = np.nonzero((score > 0) & (score >= np.maximum(last, least) - 1e-6))
                if len(r):
                    own = pa.Table.from_batches([batch.select(ids)]).take(pa.array(r + at))
                    own = own.append_column("_q", pa.array(q)).append_column("score", pa.array(np.round(score[r, q], 6)))
                    held = _best(own if held is None else pa.concat_tables([held, own]), query, ids, k)
                    nth, had = held.column("_q").to_numpy(), np.bincount(held.column("_q").to_numpy(), minlength=len(names))
                    full = had[nth] >= k
                    least[nth[full]] = held.column("score").to_numpy()[full]  # rows are in order: the last one stays
        if held is not None:
            out = held.append_column(query, names.take(held.column("_q").combine_chunks()))
            yield from out.select([query, *ids, "score"]).combine_chunks().to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [asked.schema[query], *[passages.schema[c] for c in ids]])
    return passages.select(*ids, "tokens").mapInArrow(scored, f"{kinds}, score double")


def bm25(queries: DataFrame, passages: DataFrame, query: str, ids: list[str], k: int = 3, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, ids, score, rank): the k best passages(ids, tokens) for each of queries(query, tokens), by BM25.

    Passages are read twice, for the frequencies of the queries' words and for scores, and not shuffled: a task scores each of its
    passages for all queries and sends the k best for each. Words of queries are sent to tasks, _ASKED at most for a pass; more
    take further passes. Ties go by ids. A passage without a word of the query is never returned. Scores are rounded to
    six digits, so that order does not depend on how sums were grouped.
    """
    asked = queries.select(query, F.explode(F.array_distinct("tokens")).alias("_t")).where("_t is not null").distinct()
    passes = max(1, -(-asked.count() // _ASKED))
    leading = None
    for i in range(passes):
        part = asked.where(F.pmod(F.xxhash64(query), F.lit(passes)) == i) if passes > 1 else asked
        found = _leading(part, passages, query, ids, k, k1, b)
        leading = found if leading is None else leading.unionAll(found)
    best = Window.partitionBy(query).orderBy(F.desc("score"), *ids)
    return leading.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def first_fit_decreasing(counts: Mapping[int, int], capacity: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(length, first rank, n, container, each, offset): n documents of a length, from a rank on, ``each`` in a container from
    ``container`` on, the first of them at ``offset`` there.

    Longest first, each into the first container with room. Containers filled alike are one run of neighbours, so the work
    follows the number of lengths and not of documents. A length over the capacity is not placed.
    """
    runs: list[tuple[int, int]] = []  # (containers, room) in order
    for length in sorted((x for x in counts if 0 < x <= capacity), reverse=True):
        left, rank, at, after = counts[length], 0, 0, []
        for i, (n, room) in enumerate(runs):
            each = room // length
            if not left or not each:
                after.append((n, room))
            else:
                full = min(left // each, n)
                if full:
                    yield length, rank, full * each, at, each, capacity - room
                    after.append((full, room - each * length))
                rank, left = rank + full * each, left - full * each
                if left and full < n:
                    yield length, rank, left, at + full, each, capacity - room
                    after.append((1, room - left * length))
                    rank, full, left = rank + left, full + 1, 0
                if full < n:
                    after.append((n - full, room))
            at += n
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            yield length, rank, left, at, each, 0
            after += [(full, capacity - each * length)] * (full > 0) + [(1, capacity - rest * length)] * (rest > 0)
        runs = []
        for n, room in after:  # neighbours alike are one run
            if runs and runs[-1][1] == room:
                runs[-1] = (runs[-1][0] + n, room)
            else:
                runs.append((n, room))


def packed_whole(docs: DataFrame, key: str, length: str = "length", capacity: int = 4096, spread: int = 64) -> DataFrame:
    """docs with container and offset, no document cut: first fit, longest first. Null where a document is over the capacity.

    Ranks within a length run through ``spread`` hash classes one after the other, so that a length that most documents have
    is ranked in as many tasks. The plan has rows by lengths, at most some times the capacity, and is broadcast.
    """
    own = docs.withColumn("_class", F.pmod(F.xxhash64(key), F.lit(spread)))
    sizes = own.groupBy(length, "_class").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col(length).alias("_l"), F.col("_class").alias("_c"), F.coalesce(F.sum("_n").over(Window.partitionBy(length).orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    counts = {r[0]: r[1] for r in sizes.where(F.col(length).between(1, capacity)).groupBy(length).agg(F.sum("_n")).collect()}
    plan = list(first_fit_decreasing(counts, capacity))
    place = docs.sparkSession.createDataFrame(plan, "_length bigint, _first bigint, _many bigint, _container bigint, _each bigint, _offset bigint")
    ranked = own.withColumn("_rank", F.row_number().over(Window.partitionBy(length, "_class").orderBy(key)) - 1)
    ranked = ranked.join(F.broadcast(before), (F.col(length) == F.col("_l")) & (F.col("_class") == F.col("_c")), "left").withColumn("_rank", F.col("_rank") + F.col("_before"))
    met = ranked.join(F.broadcast(place), (F.col(length) == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_many")), "left")
    nth = F.col("_rank") - F.col("_first")
    container = F.col("_container") + F.floor(nth / F.col("_each"))
    offset = F.col("_offset") + F.pmod(nth, F.col("_each")) * F.col(length)
    return met.select(*docs.columns, container.cast("bigint").alias("container"), offset.cast("bigint").alias("offset"))


def container_labels(packed: DataFrame, capacity: int = 4096, labels: str = "labels", end: int = 0) -> DataFrame:
    """(container, labels): the labels of each container: every document's own (IGNORED for its prompts) and ``end``, then
    IGNORED to the capacity. A group is one container. packed as ``packed_whole`` gives it, lengths with the end token."""
    of = packed.where("container is not null").groupBy("container").agg(F.array_sort(F.collect_list(F.struct("offset", F.concat(F.col(labels), F.array(F.lit(end))).alias("l")))).alias("_p"))
    flat = F.flatten(F.transform("_p", lambda p: p.l))
    return of.select("container", F.concat(flat, F.array_repeat(F.lit(IGNORED), F.lit(capacity) - F.size(flat))).alias("labels"))
