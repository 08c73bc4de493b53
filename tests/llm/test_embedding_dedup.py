import math

import numpy as np
import pytest

from statefold.llm import embedding_dedup as E

from .fixtures import same

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(n=160, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)).astype(np.float32)
    out = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    for i in range(min(60, n)):
        v, noise = base[i], rng.normal(size=dim)
        noise *= np.linalg.norm(v) / np.linalg.norm(noise) * rng.uniform(0.05, 0.45)
        out.append((1000 + i, (v + noise).astype(np.float32).tolist(), int(i % 3)))
    out += [(2000 + i, base[0].tolist(), 0) for i in range(5)] + [(2000, base[0].tolist(), 0)]
    out += [(2100, (2 * base[0]).tolist(), 0), (2101, (-base[0]).tolist(), 0), (2102, base[0].tolist(), None), (2103, base[0].tolist(), 1)]
    out += [(3000, None, 0), (3001, [], 0), (3002, [0.0] * dim, 0), (3003, [math.nan] + [1.0] * (dim - 1), 0), (3004, [math.inf] + [1.0] * (dim - 1), 0), (3005, [None] + [1.0] * (dim - 1), 0), (3006, base[0][:32].tolist(), 0), (None, base[1].tolist(), 1), (None, None, None)]
    return out


def brute(rows, cosine=0.93):
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]
    arrays = [np.array(v, np.float32).astype(float) if ok else None for (_, v, _), ok in zip(rows, good, strict=True)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = arrays[i], arrays[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return [(k, links[i], least.get(top(i)), k == least.get(top(i))) for i, (k, _, _) in enumerate(rows)]


def test_against_brute_force(spark):
    rows = vectors()
    same(E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect(), brute(rows))


def test_buckets_cut_into_parts_count_links_once(spark):
    rng = np.random.default_rng(5)
    center = rng.normal(size=64)
    rows = [(i, (center + 0.15 * rng.normal(size=64)).tolist(), 1) for i in range(90)]
    same(E.near_duplicates(spark.createDataFrame(rows, SCHEMA), unit_size=7).collect(), brute(rows))


def pairs(dim, n, seed=1):
    """Vectors and others at a cosine of just 0.93 to them."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, 0.93 * a + math.sqrt(1 - 0.93**2) * b


@pytest.mark.parametrize("dim", [8, 64, 256])
@pytest.mark.parametrize("level", [0, 8, 16, 26])
def test_recall_at_the_threshold(dim, level):
    a, c = pairs(dim, 1000 if level < 20 else 300)
    how = E.hashing_for(level)
    x, y = E.bucket_codes(a, how), E.bucket_codes(c, how)
    assert (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3)).mean() > (0.985 if dim > 8 else 0.95)


def test_company_by_chance_does_not_grow():
    """Pairs of unrelated vectors that share a bucket, for each vector: about as many whatever a label holds."""
    per_vector = []
    for n in (500, 5_000, 50_000):
        x = np.random.default_rng(n).normal(size=(n, 64))
        how = E.hashing_for(math.ceil(math.log2(n)))
        names = np.sort(E.bucket_names(E.bucket_codes(x, how), np.zeros(n, np.int64)).reshape(-1))
        size = np.diff(np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1], [True]))))
        per_vector.append((size * (size - 1) // 2).sum() / n)
    assert max(per_vector) < 6 and max(per_vector) < 3 * min(per_vector)


def test_a_label_of_thousands(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(2_500, 32))
    near = base + 0.2 * rng.normal(size=base.shape)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate((base, near)).astype(np.float32))]
    unit = np.array([v for _, v, _ in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = [int((unit[s : s + 500] @ unit.T >= 0.93).sum()) - 500 for s in range(0, 5_000, 500)]
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(want) > 4_000 and 0.98 * sum(want) <= sum(r.n_links for r in got) <= sum(want)


def test_codes_do_not_depend_on_the_batch_and_ignore_scale():
    x, how = np.random.default_rng(2).normal(size=(50, 24)), E.Hashing(17, 5)
    one = np.concatenate([E.bucket_codes(r[None], how) for r in x])
    assert (E.bucket_codes(x, how) == one).all() and (E.bucket_codes(4 * x, how) == one).all()
    assert one.max() < 2**17 and one.min() >= 0


def test_hadamard_is_orthogonal():
    h = E._hadamard(np.eye(16))
    assert np.allclose(h @ h.T, 16 * np.eye(16)) and set(np.unique(h)) == {-1.0, 1.0}


def test_other_columns_types_and_empty(spark):
    rows = [(i, v, None if lab is None else f"l{lab}") for i, v, lab in vectors(40)]
    wide = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string").selectExpr("*", "1 as cls", "2 as n", "'x' as links", "0 as root", "'k' as kept")
    plain = E.near_duplicates(spark.createDataFrame(vectors(40), SCHEMA)).collect()
    assert len(E.near_duplicates(wide).collect()) == len(plain)
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
