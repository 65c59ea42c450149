"""Agreement of whole texts, against difflib."""

import random
from difflib import SequenceMatcher

import numpy as np

from actfold.operators import lookup


def want(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_long_sequences_match_difflib():
    rng = random.Random(4)
    for n, kinds, edits in [(900, 3, 40), (1500, 400, 30), (1200, 1, 5), (700, 30, 700)]:
        a = [rng.randrange(kinds) for _ in range(n)]
        b = list(a)
        for _ in range(edits):
            k = rng.randrange(len(b))
            b[k : k + rng.randrange(3)] = [rng.randrange(kinds + 1) for _ in range(rng.randrange(3))]
        got = 2 * lookup.matched(np.array(a), np.array(b)) / (len(a) + len(b))
        assert abs(got - want(a, b)) < 1e-12
        assert abs(lookup.agreement([str(x) for x in a], [str(x) for x in b]) - want(a, b)) < 1e-12
    assert lookup.matched(np.array([], int), np.array([1])) == 0


def test_all_pairs_of_components(spark):
    rng = random.Random(8)
    rows = [(91, 91, None), (92, 92, "")]
    for base in range(3):
        w = [f"w{base}.{rng.randrange(300)}" for _ in range([40, 150, 1200][base])]
        for k in range(4):
            v = list(w)
            if k:
                v[rng.randrange(len(w))] = f"x{k}"
            rows.append((10 * base + k, 10 * base, " ".join(v)))
    text = {i: (t or "").split() for i, _, t in rows}
    pairs = {(i, j): round(want(text[i], text[j]), 6) for i, c, _ in rows for j, e, _ in rows if i > j and c == e}
    got = lookup.sequence_ratios(spark.createDataFrame(rows, "doc_id long, component long, text string"), block=2).collect()
    assert len(got) == len(pairs) == 18 and {(r.doc_id, r.other): round(r.ratio, 6) for r in got} == pairs


def test_characters_match_difflib():
    rng = random.Random(6)
    for n, kinds, edits in [(0, 1, 0), (1, 1, 1), (60, 2, 9), (60, 1, 2), (300, 900, 8), (300, 3, 40), (2000, 700, 20), (2000, 4, 900)]:
        for _ in range(4):
            a = [rng.randrange(kinds) for _ in range(n)]
            b = list(a)
            for _ in range(edits):
                k = rng.randrange(len(b) + 1)
                b[k : k + rng.randrange(3)] = [rng.randrange(kinds + 1) for _ in range(rng.randrange(3))]
            x, y = ("".join(chr(0xD7F0 + c) for c in v) for v in (a, b))  # surrogates too
            m = SequenceMatcher(None, a, b, autojunk=False)
            block, total = m.find_longest_match(), sum(r.size for r in m.get_matching_blocks())
            i, j, size, tied = lookup.longest(x, y, 0, len(x), 0, len(y), 10**9)
            assert size == block.size and (not size or (i, j) == (block.a, block.b))
            if 0 < size and n < 100:
                assert tied == (sum(a[i : i + size] == b[j : j + size] for i in range(len(a) - size + 1) for j in range(len(b) - size + 1)) > 1)
            for most in (0, 5, 2_000):
                got, both = lookup.shared(x, y, most)
                assert got == total
                assert not both or sum(r.size for r in SequenceMatcher(None, b, a, autojunk=False).get_matching_blocks()) == total


def test_copies_are_one_row_and_pair_both_ways(spark):
    texts = ["a a c c b", "c b a a b", "b b d b", "d b b b", "a d c a a"]  # some agree otherwise the other way round
    rows = [(k, 7, texts[k % 5]) for k in range(60)] + [(100 + k, 8, "only this") for k in range(150)] + [(300, 9, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, component long, text string")
    same = lookup.same_texts(docs).collect()
    assert sorted(r.ids for r in same if r.component == 7) == [list(range(k, 60, 5)) for k in range(5)]  # compared as five texts, not as sixty rows
    assert sorted(i for r in same for i in r.ids) == sorted(i for i, _, _ in rows) and all(r.doc_id == r.ids[0] for r in same)
    text = {i: t.split() for i, _, t in rows}
    pairs = {(i, j): round(want(text[i], text[j]), 6) for i, c, _ in rows for j, e, _ in rows if i > j and c == e}
    assert any(pairs[i, j] != round(want(text[j], text[i]), 6) for i, j in pairs)
    for block, copies in [(48, 64), (2, 4)]:
        got = lookup.sequence_ratios(docs, block, copies).collect()
        assert len(got) == len(pairs) and {(r.doc_id, r.other): round(r.ratio, 6) for r in got} == pairs
