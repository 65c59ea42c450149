"""Sections and the segments they overlap, against loops; quotes found in documents, against plain search; ranks against a sort."""

import random
import re

from pyspark.sql import functions as F

from actfold.functions import text as tx
from actfold.operators import lookup, statutes, verify
from actfold.plans import adapters


def drawn(seed):
    """Segments in which sections open at, inside and across segment borders."""
    rng, rows = random.Random(seed), []
    for num in range(25):
        number = 0
        for ix in range(rng.randint(1, 14)):
            text = ""
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                if rng.random() < 0.5:
                    number += 1
                    wide = rng.random() < 0.3
                    text += f"Section {number}. " + (f"Chapter {number + 100}, Florida Statutes, is repealed. " if wide else f"Section {number + 10}.0{number % 10}, Florida Statutes, is amended to read: ")
                text += " ".join(rng.choices(["shall", "apply", "fee-", "of", "trade"], k=rng.randint(0, 6))) + " "
            rows.append(("s", num, ix, rng.choice(["plain", "insert", "delete"]), re.sub(" +", " ", text).strip(), rng.choice([None, 0, ix * 2 + 1]), 1))
    return rows


def looped(rows):
    """(num, bill_section, line_start, line_end, words_added, words_deleted) section by section over all segments."""
    out = []
    for num in sorted({r[1] for r in rows}):
        segs = sorted((r for r in rows if r[1] == num), key=lambda r: r[2])
        full, spans = "", []
        for r in segs:
            full += (" " if spans else "") + r[4]
            spans.append((len(full) - len(r[4]), len(full), r))
        starts = [(m.start(), int(m.group(1))) for m in re.finditer(r"\bSection\s+(\d+)\.\s", full)]
        for (start, number), end in zip(starts, [s for s, _ in starts[1:]] + [len(full)]):
            body = full[start : start + 320]
            if re.match(rf"Section {number}\. Chapter", body):
                lines = [r[5] for s0, s1, r in spans if s0 >= start and s1 > start and r[5]]
                out.append((num, number, lines[0] if lines else None, None, 0, 0))
            elif re.search(r"(?i)\bsection\s+\d+[0-9A-Za-z.]*\s*,\s*Florida\s+Statutes", body):
                met = [r for s0, s1, r in spans if s1 > start and s0 < end]
                lines = [r[5] for r in met if r[5]]
                words = [sum(len(re.findall(tx.WORD, r[4])) for r in met if r[3] == k) for k in ("insert", "delete")]
                out.append((num, number, min(lines, default=None), max(lines, default=None), *words))
    return out


def test_sections_meet_their_segments(spark):
    for seed in range(3):
        rows = drawn(seed)
        df = spark.createDataFrame(rows, "session string, num long, seg_ix long, kind string, text string, line long, page long")
        found = statutes.cross_reference(df, ["session", "num"]).where("bill_section is not null").collect()
        columns = ("num", "bill_section", "line_start", "line_end", "words_added", "words_deleted")
        assert sorted((tuple(r[c] for c in columns) for r in found), key=repr) == sorted(looped(rows), key=repr)


def test_quotes_by_their_rarest_run(spark):
    rng = random.Random(5)
    stock = "be it enacted by the legislature of the state that"
    texts = [(k, f"{stock} " * (k % 2) + " ".join(rng.choices(["fee", "tax", "road", "bridge"], k=40))) for k in range(60)] + [(60, None), (61, ""), (3, f"{stock} again fee")]
    quotes = [(k, " ".join(t.split()[5:19])) for k, t in texts[:30]] + [(90, stock), (91, "two words"), (92, None), (93, "no such run of words anywhere in them"), (94, "fee tax road bri")]
    q, d = spark.createDataFrame(quotes, "q long, text string"), spark.createDataFrame(texts, "d long, text string")
    want = sorted({(k, j) for k, quote in quotes for j, t in texts if quote and t and len(quote.split()) > 2 and quote in t})
    got = [tuple(r) for r in verify.contained(q, d, "q", "d").collect()]
    assert sorted(set(got)) == want
    assert verify.contained(q.where("q < 0"), d, "q", "d").count() == 0 and verify.contained(q, d.where("d < 0"), "q", "d").count() == 0


def test_the_filter_of_runs_loses_none_and_passes_few(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    others = spark.range(10_000, 60_000).select(F.xxhash64("id").alias("key"))
    bits = lambda n: verify.key_bits(keys, n)
    assert keys.where(verify.may_have(F.col("key"), bits(3000))).count() == 3000
    assert others.where(verify.may_have(F.col("key"), bits(3000))).count() < 1500
    assert keys.where(verify.may_have(F.col("key"), bits(1))).count() == 3000  # too small a filter passes more, and still loses none
    edges = spark.createDataFrame([(0,), (-1,), (2**63 - 1,), (-(2**63),), (63,), (64,)], "key long")
    assert edges.where(verify.may_have(F.col("key"), verify.key_bits(edges, 6))).count() == 6
    plan = others.where(verify.may_have(F.col("key"), bits(3000))).groupBy("key").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("Filter")  # printed from the top: what the filter drops is not shuffled


def test_ranks_across_ranges(spark):
    rng = random.Random(2)
    rows = [("s", n, rng.randint(0, 3)) for n in rng.sample(range(400_000), 300)] + [("s", None, 2)]
    got = {r.num: r.place for r in lookup.ranked(spark.createDataFrame(rows, "session string, num long, activity long")).collect()}
    assert got == {r[1]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[2], -1 if r[1] is None else r[1])), 1)}


def test_references_read_segments_once(spark):
    """The segments come together once, without windows; a document of more sections than a block of running sums is as its loop."""
    rows = []
    for k in range(700):
        rows.append(("s", 1, 2 * k, "plain", f"Section {k + 1}. Section {k + 10}.01, Florida Statutes, is amended:" if k % 3 else f"Section {k + 1}. Chapter {k + 10}, Florida Statutes, is repealed.", k % 5 and 3 * k, 1))
        rows.append(("s", 1, 2 * k + 1, ["insert", "delete"][k % 2], "of trade " * (k % 4), 3 * k + 1, 1))
    rows = [(*r[:4], r[4].strip(), *r[5:]) for r in rows]
    df = spark.createDataFrame(rows, "session string, num long, seg_ix long, kind string, text string, line long, page long")
    found = statutes.cross_reference(df, ["session", "num"])
    columns = ("num", "bill_section", "line_start", "line_end", "words_added", "words_deleted")
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == sorted(looped(rows), key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Window" not in plan


def test_acts_and_blocks_are_made_once(spark):
    acts = adapters.acts(spark, "/root/testdata/sf0.001")
    assert acts._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1
    rows = [("s", 1, 0, 1, 3, "a"), ("s", 1, 1, 2, None, "b" * 90)]
    blocks = spark.createDataFrame(rows, "session string, num long, block_ix long, changed long, line long, passage string")
    head = spark.createDataFrame([("s", 1, "BILL")], "session string, num long, header string")
    for made in (verify.briefs(head, blocks), verify.brief_parts(head, blocks, 50)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # the header's
