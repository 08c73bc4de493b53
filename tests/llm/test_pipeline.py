import corpus_pipeline
from statefold.llm import packing, quality_classifier, quality_rules, simhash

from .fixtures import clashing, documents, rows as awkward, words
from .test_near_copies import slow_components
from .test_packing import check_packing
from .test_quality_classifier import brute
from .test_quality_rules import measures

SF = "/root/testdata/sf0.01"


def passes(text):
    """The rules' table by hand."""
    n, chars, symbols, equal_lines, repeated = measures(text)
    lines = sum(bool(words(x)) for x in (text or "").split("\n"))
    stops = sum(w.lower() in quality_rules.STOP_WORDS for w in words(text))
    return n >= 50 and 2 * repeated <= n and 4 * symbols <= n and 2 * n <= chars <= 15 * n and 2 * equal_lines <= lines and 100 * stops >= n


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash_near_dedup", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    results = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        results.append((docs, out))
        docs = out
    (first, ruled), (_, good), (_, unique), (_, packed) = results
    assert ids(ruled) == {r.doc_id for r in first.collect() if passes(r.text)}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.fit_on(first, labels)
    scores = brute([(r.doc_id, r.source, r.lang, r.text) for r in ruled.collect()], model)
    assert ids(good) == {k for k, score in scores if score >= 0.5}
    rows = good.collect()
    assert ids(unique) == set(slow_components([(r.doc_id, r.text) for r in rows]))
    assert all(df.columns == columns for df in (ruled, good, unique)) and unique.count() == len(ids(unique))
    texts = {r.doc_id: r.text for r in first.collect()}
    assert all(texts[r.doc_id] == r.text for r in unique.collect())
    n, total = check_packing(packed.collect(), [(r.doc_id, r.text) for r in unique.collect()], packing.CAPACITY)
    assert n <= -(-total // packing.CAPACITY) + 1
    clean = {r.doc_id for r in labels.where("quality = 1").collect()}
    long_enough = ids(first) & clean & ids(quality_rules.judged(first).where("not base_failed"))
    assert long_enough <= ids(good)


def test_run_gives_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    run = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.piece)
    assert [(r.doc_id, r.piece, r.ids_crc32) for r in sorted(run.collect(), key=key)] == [(r.doc_id, r.piece, r.ids_crc32) for r in sorted(docs.collect(), key=key)]


def test_empty_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
    assert simhash.keep_first(spark.read.parquet(f"{SF}/documents.parquet").limit(0)).collect() == []


def test_awkward_rows_pass_through(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and keys, and columns with the names that stages use."""
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (10, 0, 0), (3, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    results = []
    for docs in (documents(spark), clashing(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path)).cache()
            assert name == "best_fit_packing" or docs.columns == columns
        results.append(sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in docs.collect()))
    assert results[0] == results[1]
    kept = {k for k, *_ in results[0]}
    assert {"1", "3"} <= kept and not kept & {"2", "4", "5", "6", "7", "None"}  # 2 is a copy of 1; the others are too short
    assert kept <= {str(r[0]) for r in awkward() if passes(r[1])}
