"""Marks over whole tables, against a loop over all words and rules."""

from collections import Counter

import __spark_entry__

WORD = "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double"


def test_every_word_and_rule_counts(spark, tmp_path):
    words = [(k, (k * 37 + n * 11) % 500, (k + n * 7) % 60, float(1 + k * n % 50)) for k in range(1, 101) for n in range(8)]
    rules = [(k, k * 37 % 450) for k in range(1, 101)]
    spark.createDataFrame(words, WORD).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(rules, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    want = Counter()
    for key, part, supp, wide in words:
        x0, top = part % 500, supp % 60 * 10 + 100
        if not 120 <= top <= 650:
            continue
        best = None
        for rule, cust in rules:
            r0, r_top = cust % 450, rule % 600 + 100
            cov = (min(x0 + wide, r0 + 80) - max(x0, r0)) / wide
            if rule // 40 == key // 40 and top - 3 <= r_top <= top + 14 and cov >= 0.45 and (best is None or (cov, -rule) > best[:2]):
                best = (cov, -rule, "delete" if (r_top - top) / 10 < 0.78 else "insert")
        want[best[2] if best else "plain", key // 40] += 1
    got = {(r.kind, r.page): r.n for r in __spark_entry__.queries()["geometry_marks"](spark, str(tmp_path)).collect()}
    assert got == dict(want) and {k for k, _ in got} == {"delete", "insert", "plain"} and {p for _, p in got} == {0, 1, 2}
    assert sum(got.values()) == sum(120 <= s * 10 + 100 <= 650 for _, _, s, _ in words)
