"""Every registered query against its SQL on the smallest tables."""

import math
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from actfold.operators import lookup, verify, writes
from actfold.plans.adapters import with_
from actfold.streaming import live

DATA = Path("/root/testdata/sf0.001")
NAMES = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]
#: Queries without SQL, and the tests that compare their rows with literal cases, loops or plain SQL in parts.
OTHERWISE = {
    "page_blocks": "test_pages: test_every_page, test_broken_pages",
    "page_marked_segments": "test_pages: test_every_page; test_golden: test_marked_html",
    "bill_pages": "test_bill_pages, below",
    "companion_sequences": "llm/test_companions: test_all_pairs_of_whole_texts",
}
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 9)
    return x.isoformat()[:19].replace("T00:00:00", "") if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert name in OTHERWISE and got
        return
    out = duck.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_bill_pages(spark, duck):
    """Each bill once, with exactly its references, claims, segment counts, areas and sponsors."""
    rows = __spark_entry__.queries()["bill_pages"](spark, str(DATA)).collect()
    ask = lambda q: duck.execute(q).fetchall()
    assert sorted(r.num for r in rows) == sorted(n for (n,) in ask("SELECT c_custkey FROM customer"))
    refs, claims = defaultdict(list), defaultdict(list)
    for num, *ref in ask(with_("statute_ref") + "SELECT num % 1500, bill_section, statute, action, words_added, words_deleted FROM statute_ref"):
        refs[num].append(tuple(ref))
    for num, *claim in ask(with_("claim") + "SELECT num, ord, quote, statute FROM claim"):
        claims[num].append(tuple(claim))
    sizes = dict(ask(with_("segment") + "SELECT num, count(*) FROM segment GROUP BY num"))
    area = {r.num: r.area for r in __spark_entry__.queries()["bill_areas"](spark, str(DATA)).collect()}
    for r in rows:
        assert Counter(map(tuple, r.refs or [])) == Counter(refs[r.num]) and sorted(map(tuple, r.claims or [])) == sorted(claims[r.num])
        assert r.segments == sizes.get(r.num) and r.area == area[r.num] and r.outcome
        assert sorted((r.panels or []) + (r.people or [])) == sorted(p.strip() for p in r.sponsor.split(";") if p.strip())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_upsert_keeps_null_keys(spark):
    old = spark.createDataFrame([(1, None, 1), (1, 2, 1)], "k long, section long, ingest_seq long")
    new = spark.createDataFrame([(1, None, 2), (1, 2, 2)], "k long, section long, ingest_seq long")
    got = writes.upserted(old, new, ["k", "section"]).collect()
    assert sorted((str(r.section), r.ingest_seq) for r in got) == [("2", 2), ("None", 1), ("None", 2)]


def test_rewrite_touches_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "session string, n long")
    writes.write_partitions(df, path)
    writes.rewrite(spark, path, lambda t: t.where("session = 'a'").selectExpr("session", "n + 10 as n"))
    assert sorted((r.session, r.n) for r in spark.read.parquet(path).collect()) == [("a", 11), ("b", 2)]


def test_streams_resume(spark, tmp_path):
    src, state = str(tmp_path / "src"), str(tmp_path / "state")
    seen = []
    for k in range(2):
        spark.createDataFrame([(k,)], "n long").write.mode("append").parquet(src)
        live.run_available(live.read_new(spark, src, "n long"), state, lambda b, _: seen.extend(r.n for r in b.collect())).awaitTermination()
    assert seen == [0, 1]


def test_small_operators(spark):
    replies = spark.createDataFrame([("s", 1, "summary", 1, "{bad"), ("s", 1, "summary", 2, '{"one_line": "Removes the requirement.", "summary": []}'), ("s", 1, "summary", 3, '{"one_line": "Adds a fee.", "summary": ["x"]}')], "session string, num long, pass string, attempt int, text string")
    deleted = spark.createDataFrame([("s", 1, "")], "session string, num long, deleted string")
    (r,) = verify.accepted(replies, deleted, ["session", "num"]).collect()
    assert r.attempt == 3 and [f.attempt for f in r.failures] == [1, 2]
    b = spark.createDataFrame([("s", 1)], "session string, num long")
    assert verify.requests(b, {"summary": 900, "provisions": 2000}).count() == 2
    head = spark.createDataFrame([("s", 1, "BILL")], "session string, num long, header string")
    blocks = spark.createDataFrame([("s", 1, k, 1, 5, "x" * 50) for k in range(5)], "session string, num long, block_ix long, changed long, line long, passage string")
    assert verify.brief_parts(head, blocks, 100).count() == 3 and "[line 5]" in verify.briefs(head, blocks).first().text
    totals = spark.createDataFrame([("s", 1, 1200, 3)], "session string, num long, space_words_added long, space_words_deleted long")
    assert "adds 1,200 words and deletes 3." in verify.briefs(head, blocks, totals).first().text
    prov = spark.createDataFrame([("s", 1, 0, "1.01", "major", "h", "e", "q")], "session string, num long, ord int, statute string, significance string, heading string, effect string, quote string")
    assert "1. [major] h (s. 1.01)" in verify.provision_digest(head, prov).first().text
    claims = spark.createDataFrame([("s", 1, 0, "as printed here", "c", "failed", None), ("s", 1, 1, "nowhere to be", "c", "failed", None)], "session string, num long, ord int, quote string, consequence string, quote_status string, flagged_for string").withColumn("drop_reason", verify.F.lit("x"))
    texts = spark.createDataFrame([("s", 1, "as printed here", "", "as printed here")], "session string, num long, amended string, standing string, printed string")
    assert [x.restored for x in verify.reverified(claims, texts, ["session", "num"]).orderBy("ord").collect()] == [True, False]
    assert lookup.keep_first(spark.createDataFrame([(1, 2), (1, 1)], "k int, v int"), ["k"], ["v"]).first().v == 1
