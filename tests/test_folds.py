"""Random cases: what Spark folds in groups and windows against a loop."""

import random
import time
import re

from pyspark.sql import functions as F

from actfold.functions import rules
from actfold.operators import events, segments, verify
from actfold.plans import adapters as ad
from actfold.streaming import live

KEYS = ["session", "num"]


def random_logs(n=150, seed=1):
    rng = random.Random(seed)
    labels = ["HB {}", "HJR {}", "SR {}", "CS/SB {}"]
    logs = {i: [rng.choice(ad.ACTIONS) for _ in range(rng.randint(0, 9))] for i in range(n)}
    return logs, {i: rng.choice(labels).format(i) for i in logs}


def stage(action):
    if re.match(rules.NO_STAGE, action, re.I):
        return -1
    return next((rules.STAGES.index(s) for p, s in rules.STAGE_RULES if re.search(p, action, re.I)), -1)


def walk(actions, kind):
    best, rank, outcome, died, comp, hits = -1, 0, "pending", None, None, []
    for k, a in enumerate(a.strip() for a in actions):
        if not a:
            continue
        if (s := stage(a)) > best:
            best = rank = s
            hits.append((k, s))
        m = re.search(rules.COMPANION, a, re.I)
        if re.match("Vetoed by Governor", a, re.I):
            outcome = "vetoed"
        elif re.match(r"(Approved by Governor|Became Law without|Chapter No\.)", a, re.I):
            outcome = "became_law"
        elif re.match("Adopted", a, re.I) and kind != "bill":
            outcome = "adopted"
            comp = m[1] if m else comp
        elif re.search("filed with Secretary of State", a, re.I):
            outcome = "to_ballot" if kind == "joint_resolution" else "adopted"
        elif any(re.match(p, a, re.I) for p in rules.DEATH_RULES):
            comp = m[1] if m else comp
            if outcome not in rules.SETTLED:
                outcome = "superseded" if m else "died"
                d = re.match(rules.DIED_IN, a, re.I)
                died = d[1].strip() if d and not m else died
    return rank, outcome, died, comp, hits


def test_progress_and_milestones(spark):
    logs, labels = random_logs()
    h = spark.createDataFrame([("s", i, k, "1/1/2026", "House", a) for i, log in logs.items() for k, a in enumerate(log)], "session string, num long, seq long, date string, chamber string, action string")
    b = spark.createDataFrame([("s", i, x, "") for i, x in labels.items()], "session string, num long, label string, chapter_law string")
    kinds = {"HB": "bill", "HJR": "joint_resolution", "SR": "resolution", "SB": "bill"}
    want = {i: walk(log, kinds[labels[i].replace("CS/", "").split()[0]]) for i, log in logs.items()}
    got = {r.num: (r["rank"], r.outcome, r.died_in, r.companion) for r in events.progress(h, b).collect()}
    assert got == {i: w[:4] for i, w in want.items()}
    hits = {}
    for r in events.milestones(h, b).orderBy("num", "seq").collect():
        hits.setdefault(r.num, []).append((r.seq, r["rank"]))
    assert hits == {i: w[4] for i, w in want.items() if w[4]}
    live_rows = h.select("session", "num", "seq", "action", F.lit("bill").alias("kind"))
    streamed = {r.num: (r["rank"], r.outcome) for r in live.live_progress(live_rows).collect()}
    assert streamed == {i: walk(log, "bill")[:2] for i, log in logs.items() if log}


def random_segments(rng, n):
    return [(rng.choice(["plain", "plain", "insert", "delete"]), "x" * rng.randint(1, 150), rng.choice([None, None, k]), rng.choice([None, 1 + k // 10])) for k in range(n)]


def test_context_blocks(spark):
    rng = random.Random(2)
    docs = {i: random_segments(rng, rng.randint(1, 30)) for i in range(60)}
    rows = [("s", i, k, *s) for i, d in docs.items() for k, s in enumerate(d)]
    df = spark.createDataFrame(rows, "session string, num long, seg_ix long, kind string, text string, line long, page long")
    got = {}
    for r in segments.context_blocks(df, KEYS).collect():
        got.setdefault(r.num, []).append((r.lo, r.hi, r.line, r.changed))
    want = {}
    for i, d in docs.items():
        merged = []
        for k in (k for k, s in enumerate(d) if s[0] != "plain"):
            lo = hi = k
            left = right = 220
            while lo > 0 and left > 0:
                lo -= 1
                left -= len(d[lo][1])
            while hi < len(d) - 1 and right > 0:
                hi += 1
                right -= len(d[hi][1])
            if merged and lo <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        if merged:
            want[i] = [(lo, hi, next((s[2] for s in d[lo : hi + 1] if s[2]), None), sum(s[0] != "plain" for s in d[lo : hi + 1])) for lo, hi in merged]
    assert {i: sorted(v) for i, v in got.items()} == want


def test_budget_and_parts(spark):
    rng = random.Random(3)
    docs = {i: [(rng.randint(1, 5), rng.randint(1, 900)) for _ in range(rng.randint(1, 20))] for i in range(80)}
    df = spark.createDataFrame([("s", i, k, c, "x" * n) for i, d in docs.items() for k, (c, n) in enumerate(d)], "session string, num long, block_ix long, changed long, passage string")
    kept, parts = {}, {}
    for r in verify.within_budget(df, KEYS, 2000).collect():
        kept.setdefault(r.num, set()).add(r.block_ix)
    for r in verify.parted(df, KEYS, 1500).collect():
        parts.setdefault(r.num, {})[r.block_ix] = (r.part, r.parts)
    for i, d in docs.items():
        keep, used = set(), 0
        for k, (_, n) in sorted(enumerate(d), key=lambda x: -x[1][0]):
            if used + n > 2000 and keep:
                continue
            keep.add(k)
            used += n
        assert kept[i] == keep
        part, used, of = 1, 0, []
        for _, n in d:
            if used and used + n > 1500:
                part, used = part + 1, 0
            used += n
            of.append(part)
        assert parts[i] == {k: (p, part) for k, p in enumerate(of)}


def test_lines(spark):
    rng = random.Random(4)
    docs = {i: random_segments(rng, rng.randint(1, 25)) for i in range(40)}
    df = spark.createDataFrame([("s", i, k, *s) for i, d in docs.items() for k, s in enumerate(d)], "session string, num long, seg_ix long, kind string, text string, line long, page long")
    got = {}
    for r in segments.numbered_lines(df, KEYS).orderBy("num", "line_ix").collect():
        got.setdefault(r.num, []).append((r.line, r.parts, r.changed))
    for i, d in docs.items():
        out, cur = [], None
        for kind, _, line, _ in d:
            if cur is None or (line is not None and line != cur[0]):
                cur = [line, 0, False]
                out.append(cur)
            cur[1] += 1
            cur[2] |= kind != "plain"
        assert len(got[i]) == len(out) and sum(p for _, p, _ in got[i]) == len(d)


def timed(df):
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_one_long_document_takes_linear_time(spark):
    """A document of 20,000 segments, and of 80,000 blocks against 40,000."""
    kind = F.when(F.col("id") % 3 == 1, "insert").otherwise("plain")
    doc = spark.range(20_000).select(F.lit("s").alias("session"), F.lit(1).cast("long").alias("num"), F.col("id").alias("seg_ix"), kind.alias("kind"), F.repeat(F.lit("word "), (F.col("id") % 90).cast("int") + 1).alias("text"), (F.col("id") + 1).alias("line"), F.lit(1).cast("long").alias("page"))
    assert timed(segments.context_blocks(doc, KEYS)) < 20
    quotes = spark.range(100).select(F.lit("s").alias("session"), F.lit(1).cast("long").alias("num"), F.concat(F.repeat(F.lit("word "), 4), F.lit("x"), F.col("id").cast("string")).alias("quote"))
    assert timed(segments.located(doc, quotes, KEYS)) < 20
    block = lambda n: spark.range(n).select(F.lit("s").alias("session"), F.lit(1).cast("long").alias("num"), F.col("id").alias("block_ix"), F.repeat(F.lit("x"), (F.col("id") * 7 % 40).cast("int")).alias("passage"))
    timed(verify.parted(block(1000), KEYS, 4000))
    times = [min(timed(verify.parted(block(n), KEYS, 4000)) for _ in range(2)) for n in (40_000, 80_000)]
    assert times[1] < 2.5 * times[0] + 2
    got = {r.block_ix: (r.part, r.parts) for r in verify.parted(block(5000), KEYS, 4000).collect()}
    part, used, want = 1, 0, {}
    for k in range(5000):
        n = k * 7 % 40
        if used and used + n > 4000:
            part, used = part + 1, 0
        used += n
        want[k] = part
    assert got == {k: (p, part) for k, p in want.items()}


def test_parts_of_empty_and_single_blocks(spark):
    rows = [("s", 1, 0, ""), ("s", 1, 1, "x" * 30), ("s", 1, 2, ""), ("s", 1, 3, "x" * 30), ("s", 2, 5, "x" * 99), ("s", 3, 1, ""), ("s", 4, 0, "x" * 10), ("s", 4, 1, "")]
    df = spark.createDataFrame(rows, "session string, num long, block_ix long, passage string")
    got = {(r.num, r.block_ix): (r.part, r.parts) for r in verify.parted(df, KEYS, 20).collect()}
    assert got == {(1, 0): (1, 2), (1, 1): (1, 2), (1, 2): (2, 2), (1, 3): (2, 2), (2, 5): (1, 1), (3, 1): (1, 1), (4, 0): (1, 1), (4, 1): (1, 1)}
    assert verify.parted(df.limit(0), KEYS, 20).collect() == []


def test_located_is_an_as_of_join(spark):
    seg = spark.createDataFrame([("s", 1, k, "plain", t, n, 1) for k, (t, n) in enumerate([("The first line of it", 4), ("goes on without number", None), ("the Second Part begins", 9), ("and ends", 0)])], "session string, num long, seg_ix long, kind string, text string, line long, page long")
    asked = spark.createDataFrame([("s", 1, q, 7) for q in ("first line of it goes", "goes on without number", "SECOND part begins and", "and ends", "not there at all", None, "short", "first line of it goes")] + [("s", 2, "first line of it goes", 7)], "session string, num long, quote string, line long")
    got = segments.located(seg, asked, KEYS)
    assert got.columns == ["session", "num", "quote", "line"]
    assert sorted((r.num, str(r.quote), r.line) for r in got.collect()) == sorted([(1, "first line of it goes", 4), (1, "first line of it goes", 4), (1, "goes on without number", 4), (1, "SECOND part begins and", 9), (1, "and ends", None), (1, "not there at all", None), (1, "None", None), (1, "short", None), (2, "first line of it goes", None)], key=lambda r: (r[0], r[1]))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "marks" not in plan and "NestedLoop" not in plan
