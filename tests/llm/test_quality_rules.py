from collections import Counter

import duckdb

from statefold.llm import quality_rules as Q
from statefold.llm.queries import ORACLE_SQL

from .fixtures import clashing, documents, empty, rows, same, words


def measures(text):
    t = text or ""
    w = words(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def expected():
    for doc_id, text, *_ in rows():
        m = measures(text)
        yield doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]


def test_measures_match_brute_force(spark):
    got = Q.judged(documents(spark)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    same(got, expected())


def test_kept_follows_the_table(spark):
    for r in Q.judged(documents(spark)).collect():
        assert r.kept == (not (r.base_failed or any(r[f"fails_{x.name}"] for x in Q.RULES)))
    kept = {r.doc_id for r in Q.judged(documents(spark)).where("kept").collect()}
    assert {1, 2, 3} <= kept and not kept & {4, 5, 6, 7, 9, 10, -7}


def test_other_columns_and_empty_tables(spark):
    wide = clashing(spark)
    same(Q.judged(wide).select("doc_id", "n_words").collect(), [(r[0], measures(r[1])[0]) for r in rows()])
    good = Q.keep_good(wide)
    assert good.columns == wide.columns
    same(good.select("doc_id").collect(), [(r.doc_id,) for r in Q.judged(documents(spark)).where("kept").collect()])
    assert Q.judged(empty(spark)).collect() == [] and Q.keep_good(empty(spark)).collect() == []


def test_plan_is_native_and_without_shuffle(spark):
    plan = Q.judged(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan


def test_sql_agrees(spark):
    db = duckdb.connect()
    documents = rows()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", documents)
    theirs = db.sql(ORACLE_SQL["op9_quality_rules"])
    ours = Q.judged(spark.createDataFrame(documents, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    same(ours.select(*theirs.columns).collect(), theirs.fetchall())
