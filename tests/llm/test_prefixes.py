"""The prefix trie against a plain loop over rebuilt conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from actfold.llm import prefixes
from actfold.llm.common import Scratch

ROWS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x, key=lambda y: y[0])] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def brute(rows):
    seqs = rebuilt(rows)
    nodes = {tuple(s[:d]) for s in seqs.values() for d in range(len(s) + 1)}
    members = {p: [c for c, s in seqs.items() if tuple(s[: len(p)]) == p] for p in nodes}
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        out, todo = [], [p]
        while todo:
            q = todo.pop()
            out.append(q)
            todo += kids[q]
        return out

    words = lambda p: len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
    out = []
    for p in nodes:
        sub = below(p)
        ends = sorted(c for c in members[p] if len(seqs[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), sum(not kids[q] for q in sub), sum((len(members[q]) - 1) * words(q) for q in sub), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def table(rng, n, hot=0.3, texts=("a", "b c", "", None, "d  e\tf")):
    rows = []
    for c in rng.sample(range(-40, 4 * n), n):
        first = ("user", "same start") if rng.random() < hot else ("user", f"w{rng.randint(0, 3)}")
        turns = [first] + [(rng.choice(["user", "bot", None]), rng.choice(texts)) for _ in range(rng.choice([0, 1, 2, 3, 7]))]
        if rng.random() < hot:
            turns = [("user", "copy one"), ("bot", "two"), ("user", "three four"), ("bot", "five")]
        at = [None if k == 0 and rng.random() < 0.2 else k for k in range(len(turns))]
        rows += [(c, k, r, t) for k, (r, t) in zip(at, turns, strict=True)]
    return rows


@pytest.mark.parametrize("shard_turns", [3, 40, 100_000])
def test_nodes_equal_a_loop(spark, shard_turns):
    rows = table(random.Random(shard_turns), 150)
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], ROWS + ", depth int, TEXT string").repartition(5)
    got = prefixes.prefix_trie(df, shard_turns=shard_turns)
    assert got.columns == list(prefixes.TRIE)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_copies_extensions_and_one_hot_conversation(spark):
    rows = [(20 * k, t, "u", f"turn {t}") for k in range(1, 30) for t in range(3 + k % 2)] + [(7, t, "u", str(t)) for t in range(300)] + [(5, 0, "u", "only")]
    got = prefixes.prefix_trie(spark.createDataFrame(rows, ROWS), shard_turns=10).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_edges(spark):
    df = spark.createDataFrame([(None, 1, "u", "lost"), (1, 1, None, None), (1, 1, None, None), (2, None, "u", "x")], ROWS)
    assert sorted(map(tuple, prefixes.prefix_trie(df).collect()), key=str) == brute([tuple(r) for r in df.collect()])
    assert prefixes.prefix_trie(df.limit(0)).collect() == []
    assert prefixes.prefix_trie(df.where("conv_id is null")).collect() == []
    # a conversation of which nothing is left is a member of the root alone
    gone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    (root,) = prefixes.prefix_trie(spark.createDataFrame([(gone, 0, "u", "x")], ROWS)).collect()
    assert tuple(root) == (gone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())


def test_double_arrays_hold_exactly_what_was_put_in():
    rng = random.Random(3)
    seqs = sorted({tuple(rng.randint(0, 30) for _ in range(rng.randint(0, 6))) for _ in range(400)})
    ids, sizes = np.array([x for s in seqs for x in s], dtype=np.int64), np.array([len(s) for s in seqs], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    trie = prefixes.packed_trie(ids, starts, sizes)
    prefix = {s[:d] for s in seqs for d in range(len(s) + 1)}
    slots = {(): 0}
    for p in sorted(prefix, key=len):
        if p:
            slots[p] = int(trie.child(np.array([slots[p[:-1]]]), np.array([p[-1]]))[0])
    assert -1 not in slots.values() and len(set(slots.values())) == len(prefix)
    for p in list(prefix)[:200]:
        for c in range(31):
            assert (int(trie.child(np.array([slots[p]]), np.array([c]))[0]) == -1) == ((*p, c) not in prefix)
    assert trie.top < 2 * len(prefix)
    assert (prefixes.walked(trie, ids, starts, sizes) >= 0).all()


def test_shards_are_short_and_meet(spark):
    rows = table(random.Random(9), 120)
    ordered = prefixes.in_order(prefixes.sequences(spark.createDataFrame(rows, ROWS), "conv_id", "turn", "role", "text", Scratch(spark)), 12, Scratch(spark))
    got = sorted(ordered.collect(), key=lambda r: (r.keys, r.conv_id))
    assert [(r.part, r.sub) for r in got] == sorted((r.part, r.sub) for r in got)
    meets = prefixes.joints(ordered)
    for a, b in zip(got, got[1:], strict=False):
        n = prefixes.common(a["keys"], b["keys"])
        assert n == (a.next if a.part == b.part else meets[a.part][1]) == (b.lcp if a.part == b.part else meets[b.part][0])
