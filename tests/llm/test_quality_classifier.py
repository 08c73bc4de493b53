import numpy as np
import pytest

from statefold.llm import quality_classifier as Q

from .fixtures import clashing, documents, empty, rows

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def brute(docs, model):
    """Scores by plain Python from the same evidence."""
    e = model.evidence(np.array([Q.features(t) for _, _, _, t in docs]))
    p = 1 / (1 + np.exp(-(e + np.log(model.prior / (1 - model.prior)))))
    host, path = [d[1] for d in docs], [(d[1], d[2]) for d in docs]

    def spread(groups, parents, count):
        names = sorted(set(groups), key=str)
        sums = {g: (sum(p[i] for i, x in enumerate(groups) if x == g), sum(x == g for x in groups)) for g in names}
        within = sum((p[i] - sums[g][0] / sums[g][1]) ** 2 for i, g in enumerate(groups))
        above = {g: parents(g) for g in names}
        between = sum(n * (s / n - above[g][0]) ** 2 for g, (s, n) in sums.items())
        nn = sum(n * n / above[g][1] for g, (s, n) in sums.items())
        if len(names) <= count or len(p) <= len(names):
            return 1e9, sums
        w = within / (len(p) - len(names))
        b = (between / (len(names) - count) - w) / ((len(p) - nn) / (len(names) - count))
        return (min(max(w / b, 1e-3), 1e9) if b > 0 else 1e9), sums

    mean = p.mean()
    host_kappa, hosts = spread(host, lambda g: (mean, len(p)), 1)
    path_kappa, paths = spread(path, lambda g: (hosts[g[0]][0] / hosts[g[0]][1], hosts[g[0]][1]), len(hosts))
    for i, (k, h, _, _) in enumerate(docs):
        s, n = hosts[h]
        rate = (s - p[i] + host_kappa * mean) / (n - 1 + host_kappa)
        s, n = paths[path[i]]
        rate = (s - p[i] + path_kappa * rate) / (n - 1 + path_kappa)
        prior = min(max(rate, 0.02), 0.98)
        yield k, 1 / (1 + np.exp(-(e[i] + np.log(prior / (1 - prior)))))


def test_scores_against_brute_force(spark):
    docs, labels = tables(spark)
    model = Q.fit_on(docs, labels)
    want = dict(brute([(r.doc_id, r.source, r.lang, r.text) for r in docs.collect()], model))
    got = {r.doc_id: r.score for r in Q.classified(docs, labels).collect()}
    assert got.keys() == want.keys()
    assert np.allclose([got[k] for k in want], list(want.values()), atol=1e-6)


def test_labels_are_learned(spark):
    docs, labels = tables(spark)
    held = "pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 0"
    got = Q.classified(docs, labels.where(f"not ({held})")).join(labels.where(held), "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.97
    assert all(r.kept for r in got if r.quality == 1 and r.toxic == 0)


def test_sparse_sites_shrink_and_large_ones_do_not(spark):
    rows = [("big-bad", "p", 0.1 + 0.02 * (i % 5)) for i in range(400)] + [("big-good", "p", 0.9 - 0.02 * (i % 5)) for i in range(400)] + [(f"h{j}", "p", 0.8 - 0.1 * (j % 7)) for j in range(12) for _ in range(4)] + [("lone", "p", 0.05)]
    judged = spark.createDataFrame(rows, "_host string, _path string, _p double").selectExpr("*", "0.0D as _evidence")
    sites, rates = Q.site_rates(judged)
    got = {r._host: r.host_rate for r in Q.with_scores(judged, sites, rates, ["_host"], 0.5).collect()}
    assert got["lone"] == pytest.approx(rates.mean, abs=0.02)  # without itself the site has nothing
    assert got["big-bad"] < 0.2 and got["big-good"] > 0.8
    assert rates.host_kappa < 10 and rates.path_kappa > 1e3


def test_keep_good_keeps_columns_and_decisions(spark):
    docs, labels = tables(spark)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in Q.classified(docs, labels).where("kept").collect()}


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (10, 0, 0), (None, 1, 0), (3, None, 0), (9, 5, 0), (-7, 0, 0), (1, 1, 1), (77, 0, 0)], "doc_id bigint, quality int, toxic int")
    docs = documents(spark)
    got = Q.classified(docs, labels).collect()
    assert len(got) == len(rows()) and all(r.score is not None and r.kept is not None for r in got)
    assert Q.classified(clashing(spark), labels).count() == len(rows()) and Q.keep_good(clashing(spark), labels).columns == clashing(spark).columns
    assert Q.classified(empty(spark), labels).collect() == [] == Q.keep_good(empty(spark), labels).collect()
    none = Q.classified(docs, labels.limit(0)).collect()
    assert {r.evidence for r in none} == {0.0}


def test_sample_is_bounded(spark):
    docs, labels = tables(spark)
    assert Q.fit_on(docs, labels, sample_rows=50).weights.any()


def test_site_of_url(spark):
    df = spark.createDataFrame([("https://Ex.org/blog/a?x=1",), ("http://b.net",), (None,)], "url string")
    host, path = Q.site_of_url("url")
    assert [tuple(r) for r in df.select(host, path).collect()] == [("ex.org", "blog"), ("b.net", ""), (None, "")]
