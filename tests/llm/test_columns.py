"""Further columns of any name: those that operators use or add, case variants, doubled names."""

import corpus_pipeline
import numpy as np
import pytest
from actfold.llm import embeddings, language, minhash, mixing, packing, pii, quality, secrets, sharding, topk

#: Names that operators or stages add or use inside, each with a value that must come through.
CLASHES = ["score", "clean_text", "TEXT", "n_secrets", "_kept", "_c0", "Doc_Id", "topic", "tokens", "component_id", "lang_pred", "score"]
WORDS = ["the weather is", "ringing and hearing", "thanks for the", "weather thanks", "ringing hear"]


def documents(spark, extra=CLASHES):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(WORDS, 30)) + (" password=b7db7aa4a5fcc78305" if i == 3 else ""), "en", f"s{i % 3}", 9) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return spark.createDataFrame([(*r, *[f"mine {k}" for k in range(len(extra))]) for r in df.collect()], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"x{k} string" for k in range(len(extra)))).toDF(*df.columns, *extra)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, name):
    docs = documents(spark)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    if name == "packing":
        assert {r.doc_id for r in out.collect()} == set(range(40))
        return
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(list(r)[5:] == [f"mine {k}" for k in range(len(CLASHES))] for r in rows)
    if name == "secret_scans":
        assert "[SECRET]" in next(r for r in rows if r[0] == 3)[1]


def test_operators_take_columns_of_any_name(spark):
    docs = documents(spark)
    assert secrets.find_secrets(docs).count() == pii.find_personal(docs).count() == language.identify(docs).count() == 40
    assert minhash.near_duplicates(docs).count() == 40
    assert packing.pack(docs).select("doc_id").distinct().count() == 40
    marks = documents(spark, ["QUALITY"]).selectExpr("doc_id", "doc_id % 2 as quality", "QUALITY as Quality")
    assert quality.classify(docs, marks, "source", "lang").count() == 40
    out = sharding.shard(docs.toDF(*["size" if c == "n_chars" else c for c in docs.columns]), 4)
    assert out.columns[-2:] == ["shard", "slot"] and out.count() == 40
    assert sharding.query_rows(docs).count() == 40
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == ["doc_id", "source", "lang", "topic", "tokens", "_cell", "_weight", "_probability", "_kept", "_error"] and mixed.count() == 40


def test_vector_operators_take_columns_of_any_name(spark):
    rows = [(i, [float(i % 5), 1.0, 2.0], i % 2, "a", 1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, a string, b int, c int").toDF("vec_id", "embedding", "label", "VEC", "Label", "n_links")
    assert embeddings.near_vectors(df).count() == 20 and topk.top_k(df).count() == 10


def test_large_components_rank_and_scores_beyond_a_long_are_null(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0**50, 0.0]), (2, [2.0**30, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in topk.top_k(df).collect()}
    assert got == {1: None, 2: 1024 * 1024 * 2**30 + 1024 * 2048, 3: 3 * 1024**2}


def test_quality_equals_the_same_in_numpy(spark):
    rng = np.random.default_rng(2)
    sites = [(f"h{k}", f"p{j}") for k in range(4) for j in range(3)]
    rows = [(i, " ".join(rng.choice(WORDS, 12)), *sites[int(rng.integers(12))]) for i in range(300)]
    label = {i: float(rng.random() < 0.2 + 0.2 * int(h[1])) for i, _, h, _ in rows if i % 2}
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, p string")
    got = {r.doc_id: r for r in quality.classify(df, spark.createDataFrame([(i, int(q)) for i, q in label.items()], "doc_id long, quality int"), "h", "p").collect()}
    at = {i: (h, p) for i, _, h, p in rows}
    mean, total = np.mean(list(label.values())), lambda test: (sum(q for i, q in label.items() if test(at[i])), sum(test(at[i]) for i in label))

    def strength(groups):  # (good, n, prior mean)
        n = sum(g[1] for g in groups)
        excess = (sum(m * (a / m - p) ** 2 for a, m, p in groups) - sum(p * (1 - p) for *_, p in groups)) / (n - sum(m * m for _, m, _ in groups) / n)
        return max(1.0, min(1e4, np.mean([p * (1 - p) for *_, p in groups]) / excess - 1)) if excess > 0 else 1e4

    hosts = {h: total(lambda s, h=h: s[0] == h) for h in {s[0] for s in sites}}
    s_host = strength([(*hosts[h], mean) for h in hosts])
    paths = {s: total(lambda x, s=s: x == s) for s in sites}
    s_path = strength([(*paths[s], (hosts[s[0]][0] + s_host * mean) / (hosts[s[0]][1] + s_host)) for s in paths if paths[s][1]])
    for i, _, h, p in rows:
        own, one = label.get(i, 0.0), float(i in label)
        host = (hosts[h][0] - own + s_host * mean) / (hosts[h][1] - one + s_host)
        path = (paths[h, p][0] - own + s_path * host) / (paths[h, p][1] - one + s_path)
        odds = np.log(got[i].doc_prob / (1 - got[i].doc_prob)) + np.log(path / (1 - path)) - np.log(mean / (1 - mean))
        assert np.allclose([got[i].host_post, got[i].path_post, got[i].quality], [host, path, 1 / (1 + np.exp(-odds))])
