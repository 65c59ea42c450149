"""Near-duplicates against all pairs."""

import random
import time
import re

import numpy as np

from actfold.llm import minhash
from actfold.llm.common import Scratch, components

DOCS = "doc_id long, text string"


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    s = [sets(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and None not in (rows[a][0], rows[b][0]) and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((top(rows[a][0]), top(rows[b][0])))
                root[y] = x
    return [(i, len(s[k]), i if i is None else top(i)) for k, (i, _) in enumerate(rows)]


def corpus(n=250, seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 30))
    base = [[word() for _ in range(rng.randint(30, 120))] for _ in range(25)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        out.append((i, rng.choice([" ", "\n", "\t "]).join(w).title() if rng.random() < 0.3 else " ".join(w)))
    return out


def run(spark, rows, **kw):
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), **kw).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


def test_equals_all_pairs(spark):
    rows = corpus()
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_small_blocks_and_chains(spark):
    rng = random.Random(6)
    w = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):  # neighbours are similar, ends are not
        rows.append((i, " ".join(w)))
        for _ in range(2):
            w[rng.randrange(200)] = f"v{rng.random()}"
    assert run(spark, rows, block=8) == sorted(brute(rows), key=str)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (6, "two one"), (None, "one two"), (7, "É a b c d e"), (8, "é a b c d e"), (4, "one two"), (9, "x " * 30000)]
    got = run(spark, rows)
    assert (5, 1, 4) in got and (6, 1, 6) in got and (None, 1, None) in got and (7, 2, 7) in got and (8, 2, 8) in got and (9, 1, 9) in got
    assert len(got) == len(rows) and got.count((4, 1, 4)) == 2 and (1, 0, 1) in got and (3, 0, 3) in got
    assert run(spark, rows[:0] or []) == [] if rows[:0] else minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_rows_of_a_link_cost_nothing(spark):
    one, two = " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(302))
    few = spark.createDataFrame([(1, one), (2, two)], DOCS)
    many = few.crossJoin(spark.range(1000)).select("doc_id", "text").repartition(4)
    times = []
    for df in (few, many):
        began = time.time()
        got = minhash.near_duplicates(df).collect()
        times.append(time.time() - began)
        assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1)} and len(got) == df.count()
    assert times[1] < times[0] + 8
    other = many.union(spark.createDataFrame([(2, one + " x"), (2, "quite another text than that")], DOCS))
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(other).collect()} >= {(1, 1), (2, 1)}


def test_a_text_of_ten_megabytes(spark):
    long = " ".join(f"{i:x}" for i in range(1_700_000))
    got = minhash.near_duplicates(spark.createDataFrame([(1, long), (2, long + " end"), (3, "end")], DOCS)).collect()
    assert len(long) > 10_000_000 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)}


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b", 3, "x"), (2, "a b", 4, "y")], "doc_id long, text string, kept int, component_id string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()} == {(1, 1), (2, 1)}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(7)
    a = np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
    b = np.concatenate((a[:1500], np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))))
    agree = (minhash.signature(a, 1024) == minhash.signature(np.sort(b), 1024)).mean()
    assert abs(agree - 1500 / 2500) < 0.06


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {(i, 100) for i in range(100, 161)} | {(i, 5) for i in range(5, 40)}
