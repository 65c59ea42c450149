"""The pipeline's stages on a small corpus, each against what plain Python says of its input."""

import random

import corpus_pipeline
from actfold.llm import minhash, secrets
from tests.llm.test_minhash import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(1)
    words = {"en": ["the", "weather", "ringing", "thanks", "hearing"], "fr": ["mentre", "leaux", "voient", "quelle", "été"]}
    rows = []
    for i in range(200):
        lang = rng.choice(["en", "fr"])
        text = " ".join(rng.choice(words[lang]) + str(rng.choice(["", "", i])) for _ in range(40))
        rows.append([i, text, lang, f"s{i % 4}"])
    for i in range(200, 230):
        rows.append([i, rows[i - 200][1], rows[i - 200][2], "copy"])
    rows[5][1] += " password=b7db7aa4a5fcc78305"
    rows += [[300, "12 34", "en", "s1"], [301, None, "en", "s1"]]
    return [(*r, len(r[1] or "")) for r in rows]


def test_stages(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scans", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, "unused")
        if name != "packing":
            assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), out.schema)
        after = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            assert set(before) - set(after) == {300, 301}
        elif name == "near_duplicates":
            kept = {i for i, _, c in brute([(i, r.text) for i, r in before.items()]) if i == c}
            assert set(after) == kept and not any(200 <= i < 230 for i in kept)
        elif name == "secret_scans":
            assert set(after) == set(before)
            assert "[SECRET]" in after[5].text and not secrets.base_spans(after[5].text) and after[5].n_chars == len(after[5].text)
            assert all(after[i] == before[i] for i in after if i != 5)
        elif name == "mixing":
            assert set(after) <= set(before) and len(after) > 0.4 * len(before)
        else:
            assert set(after) == set(before)
        docs = out


def test_near_copies_from_four_fifths_on_go(spark):
    texts = {}
    for k in range(12):
        w = [f"w{k}_{i}" for i in range(104)]
        texts[k], texts[100 + k] = " ".join(w), " ".join("new" if i in (30, 70) else x for i, x in enumerate(w))  # 90 of 110 shingles
        texts[200 + k] = " ".join("other" if i in (20, 50, 80) else x for i, x in enumerate(w))  # 85 of 115
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, _, c in brute(list(texts.items()), percent=80) if i == c} == {*range(12), *range(200, 212)}


def test_one_of_repeated_rows_stays(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)] * 3 + [(None, "q", "en", "s", 1)], DOCS)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == ["1", "None"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
    assert minhash.near_duplicates(empty).count() == 0
