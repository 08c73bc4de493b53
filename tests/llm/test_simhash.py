import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from statefold.llm import simhash as S
from statefold.llm.graph import components

from .fixtures import clashing, documents, empty, lowered, rows, same, words


def slow_fingerprint(text):
    w = words(lowered(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs, radius=2):
    """pairs: (key, fingerprint); key -> smallest key reachable, null only among nulls."""
    root = list(range(len(pairs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= radius:
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(pairs):
        if k is not None and (least.get(top(i)) is None or k < least[top(i)]):
            least[top(i)] = k
    return [least.get(top(i)) for i in range(len(pairs))]


def test_against_brute_force(spark):
    fps = [(r[0], slow_fingerprint(r[1])) for r in rows()]
    want = [(k, f"{fp:016x}", c) for (k, fp), c in zip(fps, slow_components(fps), strict=True)]
    same(S.near_duplicates(documents(spark)).collect(), want)


def test_query_matches_brute_force(spark):
    from statefold.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    fps = [(r.doc_id, slow_fingerprint(r.text)) for r in docs]
    want = [(k, f"{fp:016x}", c) for (k, fp), c in zip(fps, slow_components(fps), strict=True)]
    same(QUERIES["op8_simhash_near_dedup"](spark, "/root/testdata/sf0.001").collect(), want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(0, 2**64 - 1), st.integers(0, 6))
def test_tree_finds_all_within_the_radius(keys, query, radius):
    keys += [query ^ (1 << (k % 64)) for k in keys[:5]]
    tree = S.BkTree()
    for i, k in enumerate(keys):
        tree.add(k, i)
    assert sorted(tree.within(query, radius)) == [i for i, k in enumerate(keys) if (k ^ query).bit_count() <= radius]


def _clusters(n, seed=0):
    rng, out = random.Random(seed), set()
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice((1, 1, 3, 40))):
            out.add(base)
            base ^= 1 << rng.randrange(64)
            base ^= rng.choice((0, 1 << rng.randrange(64)))
    return sorted(out)[:n]


def test_links_when_shards_are_cut_into_parts(spark):
    fps = _clusters(400)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = slow_components(list(zip(signed, fps, strict=True)))
    for size in (3, 1024):
        links = S.near_links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), tree_size=size)
        got = {r.node: r.root for r in components(links).collect()}
        assert [got.get(s, s) for s in signed] == want


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (5, 5), (300, 300)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 0 for i in range(40)) and {got[i] for i in (200, 201, 202)} == {200}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_keep_first_and_other_columns(spark):
    docs = documents(spark)
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns
    fps = [(r[0], slow_fingerprint(r[1])) for r in rows()]
    comps = set(slow_components(fps))
    assert len([r for r in kept.collect() if r.doc_id is not None]) == len({c for c in comps if c is not None})
    assert S.keep_first(clashing(spark)).columns == clashing(spark).columns
    assert S.near_duplicates(empty(spark)).collect() == [] and S.keep_first(empty(spark)).collect() == []


def test_a_very_long_text():
    text = " ".join(f"w{i % 1000}" for i in range(200_000))
    assert S.fingerprint(text) == slow_fingerprint(text)


def test_trees_keep_their_size(spark):
    """Shards are few and trees large, whatever the number of fingerprints; each fingerprint is in radius + 1 trees."""
    rng = random.Random(2)
    for n in (500, 4_000, 16_000):
        fps = spark.createDataFrame([(rng.getrandbits(64) - 2**63,) for _ in range(n)], "fp bigint")
        r = S.tree_sizes(fps, 2, 500).first()
        assert r.nodes == 3 * n and 200 <= r["median"] <= 520 and r.most < 750 and r.trees <= 3 * 2 ** S.shard_bits(n, 2, 500)


def test_other_radii(spark):
    fps = _clusters(200, 3)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for radius in (0, 1, 5):
        got = {r.node: r.root for r in components(S.near_links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), radius, 16)).collect()}
        assert [got.get(s, s) for s in signed] == slow_components(list(zip(signed, fps, strict=True)), radius)
