"""The registered queries of this package, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actfold.functions import text as tx
from actfold.llm import alignment, embeddings, language, minhash, mixing, packing, pii, prefixes, quality, secrets, sharding, topk, warc
from actfold.llm.common import Scratch, pick
from actfold.operators import lookup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return secrets.digest(secrets.find_secrets(docs, model=secrets.fit_markov(docs)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), host="source", path="lang")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(sharding.query_rows(table(spark, sf_dir, "documents")), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.identify(pick(docs, doc_id="doc_id", text="text"), model=language.fit(docs))
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return pii.digest(pii.find_personal(docs, tagger=pii.fit_tagger(docs)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.col("_weight").alias("weight"), F.col("_probability").alias("probability"), F.col("_kept").alias("kept"), F.col("_error").alias("error"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


def companion_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a component of near-duplicates, over their whole texts."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text").where("doc_id is not null and text is not null")
    work = Scratch(spark)
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # of rows that share an id, one; texts are not sent about otherwise
        docs = work.save(docs.groupBy("doc_id").agg(F.min("text").alias("text")), "docs")
    found = work.save(minhash.near_duplicates(docs, work=work).where("n_shingles > 0").select("doc_id", F.col("component_id").alias("component")), "found")
    shared = found.groupBy("component").count().where("count > 1").select("component")
    found = found.join(shared.hint("merge"), "component", "left_semi")
    rows = work.save(docs.join(found.hint("merge"), "doc_id").select("doc_id", "component", tx.canonical(F.col("text")).alias("text")), "texts")
    return lookup.sequence_ratios(rows).select("doc_id", "other", F.round("ratio", 6).alias("ratio"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_quality, op3_sharding, op4_embeddings, op5_topk, op6_language, op7_minhash, op8_pii, op9_packing, op10_mixing, op11_warc, op12_alignment, op13_prefixes, companion_sequences)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links between nodes(id) as edge(a, b), both ways, to the smallest id that each reaches.
_REACH = "reach AS (SELECT id AS a, id AS b FROM node UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a), comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"
#: CRC-32 of a decimal number as SQL: each digit's code enters at the first of its eight shifts.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda x, e: xor(xor(x, e) >> 1, 3988292384 * (xor(x, e) & 1))), 4294967295)"

ORACLE_SQL: dict[str, str] = {
    "op4_embeddings": f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        edge AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
        node AS (SELECT vec_id AS id FROM embeddings), {_REACH}
        SELECT id AS vec_id, (SELECT count(*) FROM edge WHERE edge.a = comp.id) AS n_links, component_id, id = component_id AS kept FROM comp""",
    "op5_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
        SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
    "op7_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
        n AS (SELECT doc_id, len(g) AS n FROM g), u AS (SELECT doc_id, unnest(g) AS s FROM g),
        i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM u x JOIN u y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
        edge AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
        node AS (SELECT doc_id AS id FROM documents), {_REACH}
        SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN comp ON doc_id = id""",
    "op11_warc": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT *, rpad(sha1(b), 40, '0') AS hex, row_number() OVER (PARTITION BY b ORDER BY page_id NULLS LAST) AS k, first(page_id) OVER (PARTITION BY b ORDER BY page_id NULLS LAST) AS response FROM p)
        SELECT page_id, octet_length(b) AS payload_bytes, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), lambda x, y: x || y) AS payload_digest,
            CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN response END AS refers_to FROM d""",
    "op13_prefixes": f"""WITH o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (SELECT *, ({_CRC} % 4)::INT AS h FROM o),
        b AS (SELECT h.conv_id, list_concat(CASE WHEN h > 0 THEN coalesce(d.turns[1:h], []) ELSE [] END, h.turns[h + 1:]) AS turns FROM h LEFT JOIN o d ON d.conv_id = h.conv_id - h.conv_id % 20),
        p AS (SELECT conv_id, d, len(turns) AS n, CASE WHEN d > 0 THEN turns[d].t ELSE '' END AS last, sha256(CASE WHEN d > 0 THEN to_json(turns[1:d])::VARCHAR ELSE '' END) AS node, sha256(CASE WHEN d > 1 THEN to_json(turns[1:d - 1])::VARCHAR ELSE '' END) AS up FROM b, unnest(range(0, len(turns) + 1)) AS x(d)),
        n AS (SELECT node, min(conv_id) AS conv_id, min(d) AS depth, min(CASE WHEN d > 0 THEN up END) AS up, count(*) AS n_convs, len(regexp_extract_all(min(last), '[^\x20\x09-\x0D]+')) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = n), '')) AS ends_sha256 FROM p GROUP BY node),
        k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
        a AS (SELECT DISTINCT x.node AS top, y.node FROM p x JOIN p y ON x.conv_id = y.conv_id AND x.d <= y.d),
        s AS (SELECT a.top AS node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens FROM a JOIN n ON n.node = a.node LEFT JOIN k ON k.node = a.node GROUP BY a.top)
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256 FROM n JOIN s ON s.node = n.node LEFT JOIN n u ON u.node = n.up LEFT JOIN k ON k.node = n.node""",
}
