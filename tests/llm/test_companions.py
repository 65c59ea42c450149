"""Agreement of whole texts in components of near copies, against difflib over all pairs."""

import random
from difflib import SequenceMatcher

from actfold.llm import queries
from tests.llm.test_minhash import brute


def want(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_all_pairs_of_whole_texts(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for base in range(3):
        w = [f"w{base}.{rng.randrange(300)}" for _ in range([40, 150, 1200][base])]  # the last is far over 3,000 characters
        for k in range(4):
            v = list(w)
            if k:
                v[rng.randrange(1 + (k > 1), len(w))] = f"x{k}"
            rows.append((10 * base + k, " ".join(["start"] * (k == 3) + v)))  # k = 3 begins with another word
    rows += [(90, rows[1][1]), (91, None), (92, ""), (93, "alone here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    comp, text = {i: c for i, _, c in brute(rows)}, {i: (t or "").split() for i, t in rows}
    pairs = {(i, j): round(want(text[i], text[j]), 6) for i in text for j in text if i > j and comp[i] == comp[j]}
    got = queries.companion_sequences(spark, str(tmp_path)).collect()
    assert len(pairs) > 12 and len(got) == len(pairs) and {(r.doc_id, r.other): r.ratio for r in got} == pairs


def test_rows_that_share_an_id_count_once(spark, tmp_path):
    w = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:59])), (2, " ".join([*w[:59], "z"])), (3, " ".join(w)), (3, " ".join(w)), (4, " ".join(w))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    text = {1: w, 2: w[:59], 3: w, 4: w}  # of id 2 the smallest text
    got = queries.companion_sequences(spark, str(tmp_path)).collect()
    assert len(got) == 6 and {(r.doc_id, r.other): r.ratio for r in got} == {(i, j): round(want(text[i], text[j]), 6) for i in text for j in text if i > j}
