"""Embedding near-duplicates and exact top-k against all pairs."""

import math
import random

import numpy as np

from actfold.llm import embeddings, topk

VECS = "vec_id long, embedding array<float>, label int"


def table(n=600, dim=32, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    for i in range(n // 2, n):  # copies of others, some exact
        j = rng.integers(0, n // 2)
        x[i] = x[j] + (0 if i % 4 == 0 else 0.06) * rng.standard_normal(dim)
    label = rng.integers(0, 3, n)
    rows = [(i, [float(v) for v in x[i]], int(label[i % (n // 2)])) for i in range(n)]
    odd = [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * dim, 1), (n + 3, [float("nan")] * dim, 1), (n + 4, [None] * dim, 1), (n + 5, rows[0][1], None), (n + 6, rows[0][1][:5], rows[0][2]), (None, rows[1][1], 1)]
    return rows + odd


def ok(v):
    return v and None not in v and np.isfinite(v).all()


def test_links_equal_all_pairs(spark):
    rows = table()
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, VECS), block=64).collect() if r.vec_id is not None}
    assert len(got) == len(rows) - 1
    use = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if i is not None and lab is not None and ok(v) and any(v)]
    near = {i: [] for i, _, _ in rows if i is not None}
    for a, (i, u, p) in enumerate(use):
        for j, v, q in use[:a]:
            if p == q and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                near[i].append(j)
                near[j].append(i)
    root = {i: i for i in near}
    while (new := {i: min([root[i], *(root[j] for j in near[i])]) for i in near}) != root:
        root = new
    links = sum(len(v) for v in near.values())
    found = sum(r.n_links for r in got.values())
    assert links > 200 and 0.97 * links <= found <= links
    assert all(got[i].n_links <= len(near[i]) for i in near)
    assert sum(got[i].component_id != root[i] for i in near) <= 0.01 * len(near)
    assert got[600].n_links == 0 and got[605].component_id == 605


def test_longer_substrings_find_as_much(spark):
    assert embeddings.layout(5_000, 0.93) == (8, 8) and embeddings.layout(256 << 12, 0.93) == (12, 15)
    rows = [r for r in table(500, 24, seed=9) if r[0] is not None]
    df = spark.createDataFrame(rows, VECS)
    one = sum(r.n_links for r in embeddings.near_vectors(df).collect())
    assert sum(r.n_links for r in embeddings.near_vectors(df, at_once=1 / 16).collect()) >= 0.97 * one > 100


def test_a_common_direction_loses_no_links(spark):
    rng = np.random.default_rng(12)
    x = 0.8**0.5 * np.full(64, 1 / 8) + 0.2**0.5 * rng.standard_normal((700, 64)) / 8  # unrelated ones have cosine 0.8
    x = np.concatenate((x, embeddings.turned(x, 0.94)))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93).sum() - len(x)
    got = embeddings.near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECS)).collect()
    assert 1400 <= links < 3000 and 0.95 * links <= sum(r.n_links for r in got) <= links
    codes, tables, _ = embeddings.fit_codes(x, 8, 8, 0.93, most=8)  # no further tables allowed: about the origin
    assert tables == 8 and not codes.mean.any()


def test_one_hot_group_counts_every_link(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal(16)
    rows = [(i, [float(x) for x in v + 0.001 * rng.standard_normal(16)], 0) for i in range(300)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, VECS), block=32).collect()
    assert {r.n_links for r in got} == {299} and {r.component_id for r in got} == {0}


def test_no_rows(spark):
    none = spark.createDataFrame([], VECS)
    assert embeddings.near_vectors(none).count() == 0 and topk.top_k(none).count() == 0


def test_top_k_equals_full_scores(spark):
    rows = table(400) + [(1000 + 100 * i, [0.5] * 32, 0) for i in range(3)] + [(2001 + i, [0.5] * 32, 1) for i in range(40)]
    got = topk.top_k(spark.createDataFrame(rows, VECS), query_block=4, row_block=64).collect()
    use = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v, _ in rows if i is not None and ok(v)]
    want = []
    for i, u in use:
        if i % 100 == 0:
            best = sorted((-int(u @ v), j) for j, v in use if j != i and len(u) == len(v))[:10]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_top_k_of_few_rows(spark):
    got = topk.top_k(spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [1.0, 1.0], 0), (2, [-1.0, 0.0], 0)], VECS)).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 3 * 1024**2), (2, -(1024**2))]


def test_large_scores_are_exact_or_raise(spark):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-80, 80), *(rng.uniform(-3e5, 3e5) if rng.random() < 0.2 else 0.0 for _ in range(11)), i / 64], 0) for i in range(120)]
    rows += [(300, [1e8] + [0.0] * 12, 0), (301, [80.0] + [1e-3] * 12, 0), (302, [-80.0, 2.0] + [0.0] * 11, 0)]  # scores of up to 2^62
    got = topk.top_k(spark.createDataFrame(rows, VECS.replace("float", "double")), query_block=4, row_block=64).collect()
    use = {i: [math.floor(1024 * x) for x in v] for i, v, _ in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(use[a], use[b], strict=True))
    want = []
    for q in (i for i in use if i % 100 == 0):
        best = sorted((-dot(q, j), j) for j in use if j != q)[:10]
        want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert max(abs(dot(300, j)) for j in use if j != 300) > 2**52
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    for bad in ([1e8, 1e8], [1e300, 0.0]):
        rows = [(0, bad, 0), (1, bad, 0), (2, [1.0, 1.0], 0), (3, [-x for x in bad], 0)]
        got = {(r["rank"], r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, VECS.replace("float", "double"))).where("query_id = 0").collect()}
        assert {(1, 1, None), (3, 3, None)} <= got and {g[:2] for g in got} == {(1, 1), (2, 2), (3, 3)}
        assert bad[0] > 1e10 or (2, 2, 2 * 1024 * int(1024e8)) in got


def test_products_near_the_limit():
    a = np.array([[2**40, 2**40, 2**22]], dtype=np.int64)
    x = np.array([[2**22, -(2**22) + 1, 5], [2**21, 2**21, 2**20], [-(2**40), 2**40, 3]], dtype=np.int64)
    assert topk._product(a, x)[0].tolist() == [sum(int(p) * int(q) for p, q in zip(a[0], y, strict=True)) for y in x]
    assert topk._product(a, np.array([[2**23, 0, 0], [-(2**30), 0, 5]], dtype=np.int64)).tolist() == [[topk.FULL, -topk.FULL]]
    assert sum(topk._parts_of(a, x, [slice(0, 1), slice(1, 3)]))[0].tolist() == topk._product(a, x)[0].tolist()


def test_codes_are_balanced():
    x = np.random.default_rng(3).standard_normal((2000, 32)) + 1
    c = embeddings.Codes(x, bits=32)
    s = embeddings.substrings(c.code(list(x)), 4, 8)
    assert s.max() < 16 and all(abs((s >> b & 1).mean() - 0.5) < 0.05 for b in range(4))
