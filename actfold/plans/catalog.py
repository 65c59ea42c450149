"""Registered queries: each operator bound to the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from actfold.functions import rules
from actfold.functions import text as tx
from actfold.operators import areas, digest, events, lookup, segments, statutes, verify, writes
from actfold.plans import adapters as ad
from actfold.plans.adapters import with_
from actfold.sources import pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DOC = ["session", "num"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def case_sql(found: list[tuple[str, str]], c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{_q(p)}', 'i') THEN '{_q(v)}'" for p, v in found) + " END"


STAGE_SQL = f"CASE WHEN NOT regexp_matches(action, '{rules.NO_STAGE}', 'i') THEN {case_sql(rules.STAGE_RULES, 'action')} END"
RANK_SQL = f"list_position([{', '.join(repr(s) for s in rules.STAGES)}], stage) - 1"
TERMINAL_SQL = "(" + " OR ".join(f"regexp_matches(action, '{_q(p)}', 'i')" for p in rules.DEATH_RULES) + ")"
KIND_SQL = "coalesce(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in rules.KIND_PREFIX.items()) + "}[regexp_extract(upper(trim(regexp_replace(label, '^(?:CS/)+', ''))), '^([A-Z]+)', 1)], 'bill')"
AREA_TITLE_SQL = case_sql([(p, a) for a, p in rules.TITLE_RULES], "title")
CHAPTER_SQL = "CASE " + " ".join(f"WHEN chapter BETWEEN {lo} AND {hi} THEN '{a}'" for a, rs in rules.CHAPTERS for lo, hi in rs) + " END"

FOLD = f"""ev AS (
    SELECT h.session, h.num, h.seq, h.date, h.chamber, trim(h.action) AS action, coalesce({KIND_SQL}, 'bill') AS kind FROM history h LEFT JOIN bill b ON h.session = b.session AND h.num = b.num WHERE trim(h.action) <> ''),
  st AS (SELECT *, {STAGE_SQL} AS stage,
    CASE WHEN regexp_matches(action, '^Vetoed by Governor', 'i') THEN 'vetoed' WHEN regexp_matches(action, '^(Approved by Governor|Became Law without|Chapter No\\.)', 'i') THEN 'became_law'
         WHEN regexp_matches(action, '^Adopted', 'i') AND kind <> 'bill' THEN 'adopted' WHEN regexp_matches(action, 'filed with Secretary of State', 'i') THEN CASE WHEN kind = 'joint_resolution' THEN 'to_ballot' ELSE 'adopted' END END AS settled,
    regexp_extract(action, '{_q(rules.COMPANION)}', 1, 'i') AS comp FROM ev),
  rk AS (SELECT *, {RANK_SQL} AS rank, CASE WHEN settled IS NULL AND {TERMINAL_SQL} THEN CASE WHEN comp <> '' THEN 'superseded' ELSE 'died' END END AS ending FROM st),
  fs AS (SELECT *, min(CASE WHEN settled IS NOT NULL THEN seq END) OVER (PARTITION BY session, num) AS first_settled, regexp_extract(action, '{_q(rules.DIED_IN)}', 1, 'i') AS died FROM rk),
  folded AS (SELECT session, num, max(rank) AS top, arg_max(settled, seq) FILTER (settled IS NOT NULL) AS settled, arg_max(ending, seq) FILTER (ending IS NOT NULL) AS ending,
    arg_max(comp, seq) FILTER (comp <> '' AND (ending IS NOT NULL OR (settled = 'adopted' AND regexp_matches(action, '^Adopted', 'i')))) AS companion,
    arg_max(trim(died), seq) FILTER (ending = 'died' AND died <> '' AND (first_settled IS NULL OR seq < first_settled)) AS died_in FROM fs GROUP BY ALL),
  track AS (SELECT b.session, b.num, b.label, {KIND_SQL} AS kind, CASE WHEN chapter_law <> '' THEN 10 ELSE coalesce(top, 0) END AS rank,
    CASE WHEN chapter_law <> '' THEN 'became_law' ELSE coalesce(settled, ending, 'pending') END AS outcome, died_in, companion, nullif(chapter_law, '') AS chapter_law,
    coalesce((SELECT count(*) FROM history h WHERE h.session = b.session AND h.num = b.num), 0) AS events FROM bill b LEFT JOIN folded f ON b.session = f.session AND b.num = f.num)"""
STAGE_OF_RANK = f"[{', '.join(repr(s) for s in rules.STAGES)}][rank + 1]"


def _track(spark: SparkSession, d: str) -> DataFrame:
    return events.progress(ad.history(spark, d), ad.bills(spark, d))


# --- reverse lookup, activity, work lists -------------------------------------------------


@query(with_("statute_ref") + "SELECT statute, count(DISTINCT (session, num)) AS bills, sum(words_added)::BIGINT AS added, sum(words_deleted)::BIGINT AS deleted FROM statute_ref GROUP BY statute")
def statute_index(spark: SparkSession, d: str) -> DataFrame:
    return statutes.statute_index(ad.refs(spark, d))


@query(with_("statute_ref") + "SELECT statute, count(DISTINCT (session, num)) AS bills, sum(words_added)::BIGINT AS added, sum(words_deleted)::BIGINT AS deleted FROM statute_ref GROUP BY statute ORDER BY bills DESC, statute LIMIT 10")
def statute_top10(spark: SparkSession, d: str) -> DataFrame:
    return statutes.statute_index(ad.refs(spark, d)).orderBy(F.desc("bills"), "statute").limit(10)


@query(with_("statute_ref", "obill") + "SELECT r.session, r.num, statute, action, bill_section, words_added, words_deleted, label, title, chapter_law FROM statute_ref r JOIN obill b ON r.num = b.num WHERE statute = '101.01'")
def statute_touching(spark: SparkSession, d: str) -> DataFrame:
    return statutes.touching(ad.refs(spark, d), ad.orders_as_bills(spark, d), "101.01")


@query(with_("statute_ref", "obill") + "SELECT DISTINCT r.session, r.num, statute, action, bill_section, label, title, CASE WHEN chapter_law <> '' THEN 'became_law' ELSE 'pending' END AS outcome FROM statute_ref r JOIN obill b ON r.num = b.num")
def statute_pages(spark: SparkSession, d: str) -> DataFrame:
    bills = ad.orders_as_bills(spark, d)
    track = bills.where("chapter_law != ''").select(*DOC, F.lit("became_law").alias("outcome"))
    return statutes.statute_pages(ad.refs(spark, d), bills, track)


ACTIVITY = "act AS (SELECT b.session, b.num, (SELECT count(*) FROM bill_text t WHERE t.num = b.num) + (SELECT count(*) FROM statute_ref r WHERE r.num = b.num AND action = 'amend') + (SELECT count(*) FROM statute_ref r WHERE r.num = b.num AND action = 'repeal') AS activity FROM obill b)"


def _activity(spark: SparkSession, d: str) -> DataFrame:
    refs = ad.refs(spark, d)
    return lookup.activity(ad.orders_as_bills(spark, d), ad.texts(spark, d), refs.where("action = 'amend'"), refs.where("action = 'repeal'"))


@query(with_("obill", "bill_text", "statute_ref", more=ACTIVITY) + "SELECT session, num, activity, row_number() OVER (PARTITION BY session ORDER BY activity DESC, num) AS place FROM act")
def activity_order(spark: SparkSession, d: str) -> DataFrame:
    return lookup.ranked(_activity(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(with_("bill_text") + "SELECT * FROM bill_text t WHERE fmt = 'HTML' OR NOT EXISTS (SELECT 1 FROM bill_text h WHERE h.num = t.num AND h.version = t.version AND h.fmt = 'HTML')")
def html_preferred(spark: SparkSession, d: str) -> DataFrame:
    return lookup.html_preferred(ad.texts(spark, d))


@query(with_("bill_text") + "SELECT session, num, version, fmt, url, text_seq FROM bill_text QUALIFY row_number() OVER (PARTITION BY num, version ORDER BY fmt, text_seq) = 1")
def one_per_version(spark: SparkSession, d: str) -> DataFrame:
    return lookup.one_per_version(ad.texts(spark, d))


@query(with_("bill_text") + "SELECT t.* FROM bill_text t JOIN (SELECT num, arg_max(version, text_seq) AS version FROM bill_text GROUP BY num) l USING (num, version) QUALIFY row_number() OVER (PARTITION BY num ORDER BY fmt, text_seq DESC) = 1")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return lookup.latest_version(ad.texts(spark, d))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def undone_work(spark: SparkSession, d: str) -> DataFrame:
    done = ad.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return lookup.undone(ad.table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query(with_("statute_ref", "obill") + "SELECT r.* FROM statute_ref r WHERE num IN (SELECT num FROM obill WHERE chapter_law <> '')")
def refs_of_enacted(spark: SparkSession, d: str) -> DataFrame:
    return lookup.restricted(ad.refs(spark, d), lookup.enacted(ad.orders_as_bills(spark, d)), DOC)


@query(with_("obill") + "SELECT session, num, label, title, chapter_law FROM obill WHERE chapter_law <> ''")
def enacted_list(spark: SparkSession, d: str) -> DataFrame:
    return lookup.enacted_in_order(ad.orders_as_bills(spark, d))


@query(with_("bill", "statute_ref", "bill_text") + "SELECT DISTINCT 'sponsor' AS list, sponsor_url AS value FROM bill UNION ALL SELECT DISTINCT 'statute', statute FROM statute_ref UNION ALL SELECT DISTINCT 'number', num::VARCHAR FROM bill_text")
def distinct_lists(spark: SparkSession, d: str) -> DataFrame:
    return lookup.distinct_lists({"sponsor": (ad.bills(spark, d), "sponsor_url"), "statute": (ad.refs(spark, d), "statute"), "number": (ad.texts(spark, d), "num")})


@query(with_("bill") + "SELECT b.session, b.num, b.sponsor_url, s_name AS member, 'district ' || s_nationkey AS party FROM bill b LEFT JOIN supplier s ON b.sponsor_url = '/Senators/S' || s_suppkey")
def sponsor_member(spark: SparkSession, d: str) -> DataFrame:
    s = ad.table(spark, d, "supplier")
    members = s.select(F.concat(F.lit("/Senators/S"), F.col("s_suppkey").cast("string")).alias("url"), F.col("s_name").alias("name"), F.concat(F.lit("district "), F.col("s_nationkey").cast("string")).alias("party"))
    return lookup.with_member(ad.bills(spark, d).select(*DOC, "sponsor_url"), members)


@query(with_("bill_text", "statute_ref") + """, j AS (
    SELECT 0 AS o, 'text' AS kind, url, session, num FROM bill_text t WHERE fmt = 'HTML' OR NOT EXISTS (SELECT 1 FROM bill_text h WHERE h.num = t.num AND h.version = t.version AND h.fmt = 'HTML')
    UNION ALL SELECT 1, 'analysis', '/a/' || statute, session, num FROM statute_ref UNION ALL SELECT 2, 'vote', CASE WHEN words_deleted > 5 THEN '/a/' || statute ELSE '' END, session, num FROM statute_ref
    UNION ALL SELECT 3, 'amendment', '/m/' || num, session, num FROM statute_ref)
    SELECT kind, url, session, num FROM j WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY o, session, num) = 1""")
def work_list(spark: SparkSession, d: str) -> DataFrame:
    r = ad.refs(spark, d)
    a, v, m = (r.select(u.alias("url"), *DOC) for u in (F.concat(F.lit("/a/"), "statute"), F.when(F.col("words_deleted") > 5, F.concat(F.lit("/a/"), "statute")).otherwise(""), F.concat(F.lit("/m/"), F.col("num").cast("string"))))
    return lookup.work_list(ad.texts(spark, d), a, v, m)


@query(with_("obill", "bill_text", "statute_ref", more=ACTIVITY) + ", p AS (SELECT session, num, row_number() OVER (PARTITION BY session ORDER BY activity DESC, num) AS place FROM act WHERE num % 3 = 0) SELECT session, num, 'text' AS kind, url, coalesce(place, 1 << 30)::BIGINT AS place FROM (SELECT DISTINCT session, num, url FROM bill_text) LEFT JOIN p USING (session, num)")
def ordered_work(spark: SparkSession, d: str) -> DataFrame:
    places = lookup.ranked(_activity(spark, d).where("num % 3 = 0"))
    work = ad.texts(spark, d).select("session", F.lit("text").alias("kind"), "url").distinct()
    return lookup.ordered_work(work, places).withColumn("place", F.col("place").cast("long"))


@query("SELECT 'o' AS session, 700000::BIGINT AS reported, count(DISTINCT l_orderkey) AS found, 700000 - count(DISTINCT l_orderkey) AS missing, 700000 = count(DISTINCT l_orderkey) AS complete FROM lineitem")
def enumeration_complete(spark: SparkSession, d: str) -> DataFrame:
    li = ad.table(spark, d, "lineitem")
    return lookup.completeness(li.select(F.lit("o").alias("session"), F.col("l_orderkey").alias("num"), F.lit(700000).cast("long").alias("total")))


@query("SELECT 'orders' AS \"table\", count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return lookup.table_counts({t: ad.table(spark, d, t) for t in ("orders", "lineitem", "documents")})


@query("SELECT count(*) FILTER (o_custkey % 100 < 90) AS ok, count(*) FILTER (o_custkey % 100 >= 90) AS failed, sum(o_custkey) FILTER (o_custkey % 100 < 90)::BIGINT AS bytes FROM orders")
def fetch_status(spark: SparkSession, d: str) -> DataFrame:
    o = ad.table(spark, d, "orders")
    return lookup.fetch_status(o.select(F.when(F.col("o_custkey") % 100 < 90, 200).otherwise(404).alias("status"), F.col("o_custkey").alias("nbytes")))


# --- events ------------------------------------------------------------------------------


@query(with_("history") + f"SELECT DISTINCT action, {STAGE_SQL} AS stage, {TERMINAL_SQL} AS terminal, nullif(trim(regexp_extract(action, '{_q(rules.DIED_IN)}', 1, 'i')), '') AS died_in, nullif(regexp_extract(action, '{_q(rules.COMPANION)}', 1, 'i'), '') AS companion FROM history")
def action_classes(spark: SparkSession, d: str) -> DataFrame:
    a = ad.history(spark, d).select("action").distinct()
    return a.select("action", rules.stage_of(F.col("action")).alias("stage"), rules.is_terminal(F.col("action")).alias("terminal"), rules.died_in(F.col("action")).alias("died_in"), rules.companion_of(F.col("action")).alias("companion"))


@query(with_("history", "bill", more=FOLD) + f"SELECT session, num, label, kind, {STAGE_OF_RANK} AS stage, rank::BIGINT AS rank, (rank * 10)::BIGINT AS percent, outcome, died_in, companion, chapter_law, events FROM track")
def progress(spark: SparkSession, d: str) -> DataFrame:
    return _track(spark, d).select(*DOC, "label", "kind", "stage", F.col("rank").cast("long").alias("rank"), F.col("percent").cast("long").alias("percent"), "outcome", "died_in", "companion", "chapter_law", "events")


@query(with_("history", "bill", more=FOLD) + ", m AS (SELECT *, coalesce(max(rank) OVER (PARTITION BY session, num ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS best FROM rk WHERE rank IS NOT NULL) SELECT session, num, seq, stage, rank::BIGINT AS rank, date, chamber, action FROM m WHERE rank > best")
def milestones(spark: SparkSession, d: str) -> DataFrame:
    return events.milestones(ad.history(spark, d), ad.bills(spark, d)).drop("label").withColumn("rank", F.col("rank").cast("long"))


@query(with_("history", "bill", more=FOLD) + f""", m AS (SELECT *, coalesce(max(rank) OVER (PARTITION BY session, num ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS best FROM rk WHERE rank IS NOT NULL),
    l AS (SELECT session, num, rank AS top, unnest(range(11)) AS rung FROM track)
    SELECT l.session, l.num, rung::BIGINT AS rung, [{', '.join(repr(s) for s in rules.STAGES)}][rung + 1] AS stage, rung <= top AS reached, rung = top AS current, date FROM l LEFT JOIN (SELECT * FROM m WHERE rank > best) m ON l.session = m.session AND l.num = m.num AND l.rung = m.rank""")
def pathway(spark: SparkSession, d: str) -> DataFrame:
    h, b = ad.history(spark, d), ad.bills(spark, d)
    return events.pathway(events.progress(h, b), events.milestones(h, b)).drop("label").withColumn("rung", F.col("rung").cast("long"))


@query(with_("history") + "SELECT *, row_number() OVER (PARTITION BY num ORDER BY seq DESC) AS place, row_number() OVER (PARTITION BY num ORDER BY seq DESC) > 6 AS folded FROM history")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    return events.timeline(ad.history(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(with_("history", "bill", more=FOLD) + f", v AS (SELECT 'outcome' AS what, outcome AS value FROM track UNION ALL SELECT 'stage', {STAGE_OF_RANK} FROM track) SELECT what, value, count(*) AS n, round(count(*) / (SELECT count(*) FROM track), 9) AS share FROM v GROUP BY ALL")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    return events.distribution(_track(spark, d)).withColumn("share", F.round("share", 9))


@query(with_("history", "bill", more=FOLD) + ", c AS (SELECT outcome, count(*) AS n, list_position(['became_law', 'vetoed', 'died', 'superseded', 'adopted', 'to_ballot', 'pending'], outcome)::BIGINT AS ord FROM track GROUP BY ALL) SELECT *, ord = min(ord) OVER () AS opens FROM c")
def outcome_tiles(spark: SparkSession, d: str) -> DataFrame:
    return events.outcome_tiles(_track(spark, d))


@query(with_("history", "bill", more=FOLD) + "SELECT chapter_law IS NOT NULL AS enacted, outcome, count(*) AS n FROM (SELECT b.num, nullif(b.chapter_law, '') AS chapter_law, coalesce(settled, ending, 'pending') AS outcome FROM bill b LEFT JOIN folded f ON b.num = f.num) GROUP BY ALL")
def outcome_confusion(spark: SparkSession, d: str) -> DataFrame:
    b = ad.bills(spark, d)
    return lookup.confusion(events.progress(ad.history(spark, d), b.withColumn("chapter_law", F.lit(""))), b)


@query(with_("bill") + f"SELECT session, num, last_action, {TERMINAL_SQL.replace('action', 'last')} AS dead FROM (SELECT *, regexp_replace(last_action, '^\\d[\\d/]*\\s+\\w*\\s*-\\s*', '') AS last FROM bill)")
def live_first(spark: SparkSession, d: str) -> DataFrame:
    return lookup.live_first(ad.bills(spark, d)).select(*DOC, "last_action", "dead")


SPANS = "hd AS (SELECT session, strptime(date, '%m/%d/%Y')::DATE AS day, action FROM history), sp AS (SELECT session, what, min(day) AS first, max(day) AS last, count(*) AS n FROM (SELECT *, unnest(['filed', 'introduced', 'governor', 'vetoed']) AS what, unnest(['^\\s*Filed', 'Introduced', 'Approved by Governor', 'Vetoed']) AS p FROM hd) WHERE regexp_matches(action, p, 'i') GROUP BY ALL)"


@query(with_("history", more=SPANS) + "SELECT * FROM sp")
def calendar_spans(spark: SparkSession, d: str) -> DataFrame:
    return events.calendar(ad.history(spark, d))


@query(with_("history", more=SPANS) + """SELECT session, first AS day, 'Filing opens — first of ' || format('{:,}', n) || ' bills filed' AS text FROM sp WHERE what = 'filed'
    UNION ALL SELECT session, first, 'Session convenes — bills introduced' FROM sp WHERE what = 'introduced' UNION ALL SELECT session, last, 'Last bill introduced' FROM sp WHERE what = 'introduced'
    UNION ALL SELECT session, first, 'Governor begins acting on bills' FROM sp WHERE what = 'governor' UNION ALL SELECT session, last, 'Governor''s last action — ' || n || ' signed' FROM sp WHERE what = 'governor'
    UNION ALL SELECT session, last, n || ' vetoed' FROM sp WHERE what = 'vetoed'""")
def calendar_events(spark: SparkSession, d: str) -> DataFrame:
    return events.calendar_events(events.calendar(ad.history(spark, d)))


@query(with_("history", more=SPANS) + "SELECT session, CASE WHEN DATE '2024-01-15' BETWEEN max(first) FILTER (what = 'introduced') AND max(last) FILTER (what = 'introduced') THEN 'IN SESSION' ELSE 'IN RECESS' END AS phase FROM sp GROUP BY session")
def session_phase(spark: SparkSession, d: str) -> DataFrame:
    return events.phase(events.calendar(ad.history(spark, d)), F.lit("2024-01-15").cast("date"))


@query(with_("bill") + "SELECT session, try_strptime(effective_date, '%m/%d/%Y')::DATE AS day, count(*) AS n, count(*) >= 10 AS big FROM bill WHERE chapter_law <> '' AND try_strptime(effective_date, '%m/%d/%Y') IS NOT NULL GROUP BY ALL HAVING count(*) >= 3")
def effective_dates(spark: SparkSession, d: str) -> DataFrame:
    return events.effective_dates(ad.bills(spark, d))


@query(with_("history") + "SELECT session, num, min(strptime(date, '%m/%d/%Y')::DATE) AS first FROM history GROUP BY ALL")
def first_actions(spark: SparkSession, d: str) -> DataFrame:
    return events.first_actions(ad.history(spark, d))


@query(with_("history") + "SELECT session, num, min(strptime(date, '%m/%d/%Y')::DATE) AS first FROM history GROUP BY ALL HAVING first BETWEEN DATE '2024-01-05' AND DATE '2024-01-06'")
def recent_bills(spark: SparkSession, d: str) -> DataFrame:
    return events.recent(ad.history(spark, d), "2024-01-05", "2024-01-06")


# --- areas, sponsors, search -------------------------------------------------------------


@query(f"SELECT p_partkey, chapter, {CHAPTER_SQL} AS area FROM (SELECT p_partkey, p_partkey % 1100 AS chapter FROM part)")
def chapter_areas(spark: SparkSession, d: str) -> DataFrame:
    p = ad.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 1100).cast("string").alias("statute"))
    return areas.areas_of_refs(p).select("p_partkey", F.col("chapter").cast("long").alias("chapter"), "area")


AREA_CTE = f"""votes AS (SELECT session, num, area, count(*) AS n FROM (SELECT *, {CHAPTER_SQL} AS area FROM (SELECT '2024' AS session, num % 1500 AS num, split_part(statute, '.', 1)::INT AS chapter FROM statute_ref)) WHERE area IS NOT NULL GROUP BY ALL),
    top AS (SELECT session, num, area AS voted FROM votes QUALIFY row_number() OVER (PARTITION BY session, num ORDER BY n DESC, area) = 1),
    area AS (SELECT b.session, b.num, title, coalesce(CASE WHEN regexp_matches(title, '{_q(rules.TITLE_RULES[0][1])}', 'i') THEN 'AI & Technology' END, voted, {AREA_TITLE_SQL}) AS area FROM bill b LEFT JOIN top USING (session, num)),
    slugged AS (SELECT *, coalesce(trim(regexp_replace(lower(area), '[^a-z0-9]+', '-', 'g'), '-'), '') AS area_slug FROM area)"""


def _areas(spark: SparkSession, d: str) -> DataFrame:
    refs = ad.refs(spark, d).select(F.lit("2024").alias("session"), (F.col("num") % 1500).alias("num"), "statute")
    return areas.classify(ad.bills(spark, d), refs)


@query(with_("statute_ref", "bill", more=AREA_CTE) + "SELECT session, num, title, area, area_slug FROM slugged")
def bill_areas(spark: SparkSession, d: str) -> DataFrame:
    return _areas(spark, d)


@query(with_("statute_ref", "bill", more=AREA_CTE) + "SELECT session, num, title, area, area_slug, count(*) OVER (PARTITION BY area) AS n FROM slugged WHERE area IS NOT NULL")
def area_listing(spark: SparkSession, d: str) -> DataFrame:
    return areas.listing(_areas(spark, d))


@query(with_("bill") + """, p AS (SELECT session, num, trim(part) AS part, pos FROM (SELECT session, num, unnest(string_split(sponsor, ';')) AS part, generate_subscripts(string_split(sponsor, ';'), 1) AS pos FROM bill) WHERE trim(part) <> ''),
    f AS (SELECT *, part IN ('Rules', 'Judiciary') OR regexp_matches(part, '\\b(?:Committee|Subcommittee)\\b') AS panel FROM p)
    SELECT session, num, coalesce(string_agg(part, '|' ORDER BY pos) FILTER (panel), '') AS panels, coalesce(string_agg(part, '|' ORDER BY pos) FILTER (NOT panel), '') AS people FROM f GROUP BY ALL""")
def sponsor_split(spark: SparkSession, d: str) -> DataFrame:
    committees = ad.bills(spark, d).where("num < 2").select(pick_name(F.col("num")).alias("name"))
    out = areas.split_sponsors(ad.bills(spark, d), committees)
    return out.select(*DOC, F.array_join("panels", "|").alias("panels"), F.array_join("people", "|").alias("people"))


def pick_name(num):
    return ad.pick(["Rules", "Judiciary"], num % 2)


INDEX_SQL = f"ix AS (SELECT b.session, b.num AS n, b.label AS l, left(title, 120) AS t, outcome AS o, CASE WHEN b.chapter_law <> '' THEN 'LAW · ch ' || b.chapter_law ELSE upper(MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in rules.OUTCOME_LABEL.items())}}}[outcome]) END AS d, lower(concat_ws(' ', b.label, title, nullif(sponsor, ''), nullif(cosponsors, ''))) AS s FROM bill b JOIN track USING (session, num))"


@query(with_("history", "bill", more=FOLD + ", " + INDEX_SQL) + "SELECT * FROM ix")
def search_index(spark: SparkSession, d: str) -> DataFrame:
    return lookup.search_index(ad.bills(spark, d), _track(spark, d))


@query(with_("history", "bill", more=FOLD + ", " + INDEX_SQL) + "SELECT *, (SELECT count(*) FROM ix WHERE contains(s, 'water') AND o = 'pending') AS \"of\" FROM ix WHERE contains(s, 'water') AND o = 'pending' ORDER BY n LIMIT 400")
def search_hits(spark: SparkSession, d: str) -> DataFrame:
    return lookup.search(lookup.search_index(ad.bills(spark, d), _track(spark, d)), "Water", "pending").withColumn("of", F.col("of").cast("long"))


# --- digests -----------------------------------------------------------------------------

PAYLOAD = """new AS (SELECT session, num, min(strptime(date, '%m/%d/%Y')::DATE) AS first FROM history GROUP BY ALL HAVING first BETWEEN DATE '2024-01-05' AND DATE '2024-01-06'),
    rows_ AS (SELECT n.session, n.num, s.title, label, coalesce(area, 'General') AS area, area_slug, CASE WHEN n.num % 2 = 0 THEN 'Changes ' || n.num || '.' ELSE '' END AS one_line FROM (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY session ORDER BY num) <= 40) n JOIN slugged s USING (session, num) JOIN bill b USING (session, num))"""


def _payload(spark: SparkSession, d: str) -> DataFrame:
    b = ad.bills(spark, d)
    lines = b.where("num % 2 = 0").select(*DOC, F.format_string("Changes %d.", "num").alias("one_line"))
    return digest.payload_rows(ad.history(spark, d), b, _areas(spark, d), lines, "2024-01-05", "2024-01-06")


@query(with_("history", "statute_ref", "bill", more=AREA_CTE + ", " + PAYLOAD) + "SELECT session, num, label, title, area, area_slug, one_line FROM rows_")
def digest_payload(spark: SparkSession, d: str) -> DataFrame:
    return _payload(spark, d)


@query(with_("subscriber") + "SELECT id, email FROM subscriber WHERE confirmed_at <> '' AND NOT unsubscribed AND bounces < 5 AND weekly")
def digest_recipients(spark: SparkSession, d: str) -> DataFrame:
    return digest.eligible(ad.subscribers(spark, d), "weekly").select("id", "email")


@query(with_("history", "statute_ref", "bill", "subscriber", more=AREA_CTE + ", " + PAYLOAD) + """SELECT id, email, 'p1' AS payload, string_agg(r.num::VARCHAR, ',' ORDER BY r.num) AS nums FROM (SELECT DISTINCT id, email, unnest(areas) AS area_slug FROM subscriber WHERE confirmed_at <> '' AND NOT unsubscribed AND bounces < 5 AND daily) s JOIN rows_ r USING (area_slug)
    WHERE area_slug <> '' AND id % 5 <> 0 GROUP BY ALL""")
def digest_deliveries(spark: SparkSession, d: str) -> DataFrame:
    sent = ad.subscribers(spark, d).where("id % 5 = 0").select(F.col("id").alias("subscriber_id"), F.lit("p1").alias("payload"))
    out = digest.deliveries(_payload(spark, d), ad.subscribers(spark, d), sent, "p1", "daily")
    return out.select("id", "email", "payload", F.array_join(F.transform("bills", lambda b: b["num"].cast("string")), ",").alias("nums"))


@query(with_("history", "statute_ref", "bill", "subscriber", more=AREA_CTE + ", " + PAYLOAD) + "SELECT id, 'The week in the 2024 session' AS subject, (SELECT count(*) FROM rows_) AS n FROM subscriber WHERE confirmed_at <> '' AND NOT unsubscribed AND bounces < 5 AND weekly")
def digest_messages(spark: SparkSession, d: str) -> DataFrame:
    none = ad.subscribers(spark, d).where(F.lit(False)).select(F.col("id").alias("subscriber_id"), F.lit("p2").alias("payload"))
    out = digest.messages(digest.deliveries(_payload(spark, d), ad.subscribers(spark, d), none, "p2", "weekly"), "weekly", "2024", "https://example.org")
    return out.select("id", "subject", F.size("bills").cast("long").alias("n"))


@query(with_("subscriber") + "SELECT id, bounces + coalesce(f, 0) AS bounces FROM subscriber LEFT JOIN (SELECT o_custkey AS id, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY ALL) USING (id)")
def delivery_bounces(spark: SparkSession, d: str) -> DataFrame:
    o = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("subscriber_id"), (F.col("o_orderstatus") != "F").alias("ok"))
    return digest.bounced(ad.subscribers(spark, d), o).select("id", "bounces")


@query("SELECT DISTINCT ON (l_orderkey) 'o' AS session, l_orderkey AS num, l_suppkey::VARCHAR AS email, l_shipdate AS created_at FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') ORDER BY l_orderkey, l_shipdate, l_suppkey::VARCHAR")
def request_queue(spark: SparkSession, d: str) -> DataFrame:
    li = ad.table(spark, d, "lineitem").select(F.lit("o").alias("session"), F.col("l_orderkey").alias("num"), F.col("l_suppkey").cast("string").alias("email"), F.col("l_shipdate").alias("created_at"))
    open_ = ad.table(spark, d, "orders").select(F.lit("o").alias("session"), F.col("o_orderkey").alias("num"), F.when(F.col("o_orderstatus") != "O", "yes").otherwise("").alias("fulfilled"))
    return digest.queued(li, open_)


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'subscribe' WHEN 'purchase' THEN 'preferences' WHEN 'error' THEN 'unsubscribe' WHEN 'click' THEN 'confirm' ELSE 'view' END AS event, event_id % 2 = 0 AS daily, event_id % 3 = 0 AS weekly, ts - to_days((event_id % 14)::INT) AS token_at FROM events)
    SELECT user_id AS email, arg_max(daily, (ts, event_id)) FILTER (event IN ('subscribe', 'preferences')) AS daily, arg_max(weekly OR (event = 'subscribe' AND NOT daily), (ts, event_id)) FILTER (event IN ('subscribe', 'preferences')) AS weekly,
    coalesce(arg_max(event = 'unsubscribe' OR (event = 'preferences' AND NOT daily AND NOT weekly), (ts, event_id)) FILTER (event IN ('subscribe', 'preferences', 'unsubscribe')), false) AS unsubscribed,
    min(ts) FILTER (event = 'confirm' AND event_id % 14 <= 7) AS confirmed_at FROM e GROUP BY ALL""")
def subscription_state(spark: SparkSession, d: str) -> DataFrame:
    e = ad.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "subscribe").when(F.col("event_type") == "purchase", "preferences").when(F.col("event_type") == "error", "unsubscribe").when(F.col("event_type") == "click", "confirm").otherwise("view")
    log = e.select(F.col("user_id").alias("email"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("event"), (F.col("event_id") % 2 == 0).alias("daily"), (F.col("event_id") % 3 == 0).alias("weekly"), F.array().cast("array<string>").alias("areas"), F.expr("ts - make_dt_interval(cast(event_id % 14 as int))").alias("token_at"))
    return digest.subscriptions(log).drop("areas")


# --- segments ----------------------------------------------------------------------------

WORD = tx.WORD.replace("'", "''")


@query(with_("segment") + f""", t AS (SELECT session, num, kind, seg_ix, unnest(regexp_extract_all(text, '{WORD}')) AS w, generate_subscripts(regexp_extract_all(text, '{WORD}'), 1) AS k FROM (SELECT * REPLACE (translate(text, '{tx.PUNCTUATION}', '{tx.PLAIN.replace("'", "''")}') AS text) FROM segment)),
    j AS (SELECT *, lag(w) OVER (PARTITION BY session, num, kind ORDER BY seg_ix, k) AS before FROM t),
    c AS (SELECT session, num, count(*) FILTER (kind = 'insert' AND NOT coalesce(before LIKE '%-', false)) AS wi, count(*) FILTER (kind = 'delete' AND NOT coalesce(before LIKE '%-', false)) AS wd FROM j GROUP BY ALL)
    SELECT s.session, s.num, count(*) AS segments, count(*) FILTER (kind = 'insert') AS insertions, count(*) FILTER (kind = 'delete') AS deletions, coalesce(max(wi), 0) AS words_inserted, coalesce(max(wd), 0) AS words_deleted,
    coalesce(sum(len(regexp_extract_all(text, '\\S+'))) FILTER (kind = 'insert'), 0)::BIGINT AS space_words_added, coalesce(sum(len(regexp_extract_all(text, '\\S+'))) FILTER (kind = 'delete'), 0)::BIGINT AS space_words_deleted FROM segment s LEFT JOIN c USING (session, num) GROUP BY ALL""")
def segment_stats(spark: SparkSession, d: str) -> DataFrame:
    return segments.stats(ad.segments(spark, d), DOC)


@query(with_("segment") + "SELECT session, num, seg_ix, (sum(length(text) + 1) OVER (PARTITION BY num ORDER BY seg_ix) - 1 - length(text))::BIGINT AS start, (sum(length(text) + 1) OVER (PARTITION BY num ORDER BY seg_ix) - 1)::BIGINT AS \"end\" FROM segment")
def segment_offsets(spark: SparkSession, d: str) -> DataFrame:
    return segments.placed(ad.segments(spark, d), DOC).select(*DOC, "seg_ix", "start", "end")


@query(with_("segment") + """, f AS (SELECT *, row_number() OVER (PARTITION BY num ORDER BY seg_ix) = 1 OR (line IS NOT NULL AND line IS DISTINCT FROM last_value(line IGNORE NULLS) OVER (PARTITION BY num ORDER BY seg_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS opens FROM segment),
    g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY num ORDER BY seg_ix) - 1 AS line_ix FROM f)
    SELECT session, num, line_ix::BIGINT AS line_ix, first(line ORDER BY seg_ix) AS line, first(page ORDER BY seg_ix) AS page, count(*) AS parts, bool_or(kind <> 'plain') AS changed, string_agg(text, ' ' ORDER BY seg_ix) AS text FROM g GROUP BY ALL""")
def segment_lines(spark: SparkSession, d: str) -> DataFrame:
    return segments.numbered_lines(ad.segments(spark, d), DOC)


@query(with_("segment") + ", f AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY num ORDER BY seg_ix) THEN 0 ELSE 1 END AS new FROM segment), g AS (SELECT *, sum(new) OVER (PARTITION BY num ORDER BY seg_ix) AS run FROM f) SELECT session, num, run::BIGINT AS run, kind, string_agg(text, ' ' ORDER BY seg_ix) AS text, min(seg_ix) AS first, max(seg_ix) AS last FROM g GROUP BY ALL")
def segment_runs(spark: SparkSession, d: str) -> DataFrame:
    return segments.runs(ad.segments(spark, d), DOC, "kind", "seg_ix")


BLOCKS_SQL = """r AS (SELECT *, row_number() OVER (PARTITION BY num ORDER BY seg_ix) - 1 AS i, sum(length(text)) OVER (PARTITION BY num ORDER BY seg_ix) AS e FROM segment), q AS (SELECT *, e - length(text) AS c FROM r),
    sp AS (SELECT a.session, a.num, a.i, greatest(a.i, max(b.i) FILTER (b.i > a.i AND b.c - a.e < 220)) AS hi, least(a.i, min(b.i) FILTER (b.i < a.i AND a.c - b.e < 220)) AS lo FROM q a JOIN q b USING (num) WHERE a.kind <> 'plain' GROUP BY a.session, a.num, a.i),
    sp2 AS (SELECT session, num, i, coalesce(hi, i) AS hi, coalesce(lo, i) AS lo FROM sp), is_ AS (SELECT *, max(hi) OVER (PARTITION BY num ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM sp2),
    ib AS (SELECT *, sum(CASE WHEN past IS NULL OR lo > past + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY num ORDER BY i) - 1 AS block_ix FROM is_), bl AS (SELECT session, num, block_ix, min(lo) AS lo, max(hi) AS hi FROM ib GROUP BY ALL),
    ins AS (SELECT bl.session, bl.num, block_ix, lo, hi, i, kind, text, line, page FROM bl JOIN q ON bl.num = q.num AND i BETWEEN lo AND hi),
    rn AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY num, block_ix ORDER BY i) THEN 0 ELSE 1 END AS new FROM ins), rg AS (SELECT *, sum(new) OVER (PARTITION BY num, block_ix ORDER BY i) AS run FROM rn),
    rt AS (SELECT num, block_ix, run, kind, string_agg(text, ' ' ORDER BY i) AS t FROM rg GROUP BY ALL),
    pas AS (SELECT num, block_ix, string_agg(CASE kind WHEN 'insert' THEN '[[+' || t || '+]]' WHEN 'delete' THEN '[[-' || t || '-]]' ELSE t END, ' ' ORDER BY run) AS passage FROM rt GROUP BY ALL),
    blocks AS (SELECT session, num, block_ix::BIGINT AS block_ix, lo::BIGINT AS lo, hi::BIGINT AS hi, arg_min(line, i) FILTER (line IS NOT NULL) AS line, arg_min(page, i) FILTER (page IS NOT NULL) AS page, count(*) FILTER (kind <> 'plain') AS changed, any_value(passage) AS passage FROM ins JOIN pas USING (num, block_ix) GROUP BY session, num, block_ix, lo, hi)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return segments.context_blocks(ad.segments(spark, d), DOC)


@query(with_("segment", more=BLOCKS_SQL) + "SELECT session, num, block_ix, lo, hi, line, page, changed, passage FROM blocks")
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select(*DOC, "block_ix", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "line", "page", "changed", "passage")


READ_SQL = "rd AS (SELECT session, num, coalesce(string_agg(text, ' ' ORDER BY seg_ix) FILTER (kind <> 'delete'), '') AS amended, coalesce(string_agg(text, ' ' ORDER BY seg_ix) FILTER (kind <> 'insert'), '') AS standing, string_agg(text, ' ' ORDER BY seg_ix) AS printed, coalesce(string_agg(text, ' ' ORDER BY seg_ix) FILTER (kind = 'delete'), '') AS deleted FROM segment GROUP BY ALL)"


@query(with_("segment", more=READ_SQL) + "SELECT session, num, md5(amended) AS amended, md5(standing) AS standing, md5(printed) AS printed, md5(deleted) AS deleted FROM rd")
def document_readings(spark: SparkSession, d: str) -> DataFrame:
    r = segments.readings(ad.segments(spark, d), DOC)
    return r.select(*DOC, *[F.md5(F.col(c).cast("binary")).alias(c) for c in ("amended", "standing", "printed", "deleted")])


@query(with_("segment", more=BLOCKS_SQL) + "SELECT session, num, sum(changed)::BIGINT AS changed, count(*) AS kept FROM blocks WHERE changed >= 0 GROUP BY ALL")
def brief_blocks(spark: SparkSession, d: str) -> DataFrame:
    kept = verify.within_budget(_blocks(spark, d), DOC, 1 << 30)
    return kept.groupBy(*DOC).agg(F.sum("changed").alias("changed"), F.count("*").alias("kept"))


def _kept_sql(budget: int) -> str:
    """Blocks walked from the most changed on, each kept while it fits."""
    return f"""wo AS (SELECT *, length(passage) AS n, row_number() OVER (PARTITION BY num ORDER BY changed DESC, block_ix) AS k FROM blocks),
    walk AS (SELECT *, n AS used, true AS kept FROM wo WHERE k = 1 UNION ALL SELECT wo.*, used + CASE WHEN used + wo.n <= {budget} THEN wo.n ELSE 0 END, used + wo.n <= {budget} FROM walk JOIN wo ON wo.num = walk.num AND wo.k = walk.k + 1)"""


#: Blocks walked in order, a new part wherever the next one would not fit.
PARTS_SQL = """po AS (SELECT *, length(passage) AS n, row_number() OVER (PARTITION BY num ORDER BY block_ix) AS k FROM blocks),
    pw AS (SELECT *, n AS used, 1 AS part FROM po WHERE k = 1 UNION ALL SELECT po.*, CASE WHEN used > 0 AND used + po.n > 2000 THEN 0 ELSE used END + po.n, part + CASE WHEN used > 0 AND used + po.n > 2000 THEN 1 ELSE 0 END FROM pw JOIN po ON po.num = pw.num AND po.k = pw.k + 1),
    dealt AS (SELECT *, max(part) OVER (PARTITION BY num) AS parts FROM pw)"""
PASSAGE_SQL = "string_agg(chr(10) || '[' || coalesce('line ' || line, '—') || '] ' || passage, chr(10) ORDER BY block_ix)"


def _walked(*more: str) -> str:
    return with_("segment", more=", ".join((BLOCKS_SQL, *more))).replace("WITH ", "WITH RECURSIVE ", 1)


@query(_walked(_kept_sql(4000)) + "SELECT session, num, block_ix, changed, n FROM walk WHERE kept")
def brief_within_budget(spark: SparkSession, d: str) -> DataFrame:
    return verify.within_budget(_blocks(spark, d), DOC, 4000).select(*DOC, "block_ix", "changed", F.length("passage").cast("long").alias("n"))


@query(_walked(PARTS_SQL) + "SELECT session, num, block_ix, part, parts FROM dealt")
def brief_parts(spark: SparkSession, d: str) -> DataFrame:
    return verify.parted(_blocks(spark, d), DOC, 2000).select(*DOC, "block_ix", "part", "parts")


#: No document of the tables cites a statute in a bill's form, so headers hold no references here.
@query(_walked(_kept_sql(8000)) + f""", body AS (SELECT num, count(*) AS passages, {PASSAGE_SQL} AS body FROM walk WHERE kept GROUP BY num), total AS (SELECT num, count(*) AS total FROM blocks GROUP BY num),
    words AS (SELECT num, coalesce(sum(len(regexp_extract_all(text, '\\S+'))) FILTER (kind = 'insert'), 0) AS a, coalesce(sum(len(regexp_extract_all(text, '\\S+'))) FILTER (kind = 'delete'), 0) AS x FROM segment GROUP BY num)
    SELECT 'd' AS session, doc_id AS num, concat_ws(chr(10), 'BILL: HB ' || doc_id || ' — ' || coalesce(source, ''), 'CHAMBER: House', 'SPONSOR: ' || nullif(lang, ''),
        CASE WHEN passages > 0 THEN format('\n\nCHANGED LANGUAGE ({{}} of {{}} passages). In total this bill adds {{:,}} words and deletes {{:,}}.', passages, total, a::BIGINT, x::BIGINT)[2:] ELSE chr(10) || 'CHANGED LANGUAGE: none marked' END, body) AS text,
        coalesce(passages, 0) AS passages, coalesce(total, 0) AS total_passages, coalesce(passages, 0) < coalesce(total, 0) AS truncated
    FROM documents LEFT JOIN body ON body.num = doc_id LEFT JOIN total ON total.num = doc_id LEFT JOIN words ON words.num = doc_id""".replace("'\n\nCHANGED", "chr(10) || chr(10) || 'CHANGED"))
def brief_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = ad.table(spark, d, "documents").select(F.lit("d").alias("session"), F.col("doc_id").alias("num"), F.concat(F.lit("HB "), F.col("doc_id").cast("string")).alias("label"), F.col("source").alias("title"), F.lit("House").alias("chamber"), F.col("lang").alias("sponsor"), F.lit("").alias("effective_date"))
    refs = statutes.cross_reference(ad.segments(spark, d), DOC)
    return verify.briefs(verify.headers(docs, refs), _blocks(spark, d), segments.stats(ad.segments(spark, d), DOC), 8000)


# --- statutes of bill texts --------------------------------------------------------------

ACT_SQL = f"""li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ad.LINE_ORDER)}) AS n FROM lineitem),
    a AS (SELECT l_orderkey AS num, n AS bill_section, (l_partkey % 900 + 1) || '.' || lpad((l_suppkey % 50)::VARCHAR, 2, '0') AS statute, ['amend', 'create', 'repeal', 'reenact'][l_partkey % 4 + 1] AS action, ['amended', 'created', 'repealed', 'reenacted'][l_partkey % 4 + 1] AS verb,
        2 * (l_quantity::BIGINT % 5) AS words_added, round(l_discount * 100)::BIGINT % 4 AS words_deleted FROM li),
    pr AS (SELECT num, 'amend' AS action, statute FROM a WHERE bill_section = 1 UNION ALL SELECT DISTINCT num, 'repeal', unnest(['998.01', '999.02']) FROM a)"""


@query(with_(more=ACT_SQL) + """SELECT 'o' AS session, num, statute, action, bill_section::BIGINT AS bill_section, 'Subsection (2) of' AS scope, verb, 3 * bill_section AS line_start, 3 * bill_section + CASE WHEN words_deleted > 0 THEN 2 WHEN words_added > 0 THEN 1 ELSE 0 END AS line_end,
    words_added, words_deleted, pa.num IS NOT NULL AS in_title, true AS in_body FROM a LEFT JOIN (SELECT DISTINCT num, action, statute FROM pr) pa USING (num, action, statute)
    UNION ALL SELECT 'o', num, statute, action, NULL, '', '', NULL, NULL, 0, 0, true, aa.num IS NOT NULL FROM pr LEFT JOIN (SELECT DISTINCT num, statute FROM a) aa USING (num, statute) ANTI JOIN (SELECT DISTINCT num, action, statute FROM a) ab USING (num, action, statute)""")
def cross_reference(spark: SparkSession, d: str) -> DataFrame:
    out = statutes.cross_reference(ad.acts(spark, d), DOC)
    return out.drop("action_label").withColumn("bill_section", F.col("bill_section").cast("long"))


#: All references of acts, as cross_reference's SQL gives them.
REF_SQL = """rf AS (SELECT num, statute, action, bill_section, verb, 3 * bill_section AS line_start, words_added, words_deleted FROM a
    UNION ALL SELECT num, statute, action, NULL, '', NULL, 0, 0 FROM pr ANTI JOIN (SELECT DISTINCT num, action, statute FROM a) ab USING (num, action, statute)),
    rl AS (SELECT *, coalesce(bill_section::VARCHAR, '-') AS sec, CASE WHEN words_added <> 0 OR words_deleted <> 0 THEN words_added || '|' || words_deleted END AS churn FROM rf)"""


@query(with_(more=ACT_SQL + ", " + REF_SQL) + "SELECT num, statute, bill_section::BIGINT AS bill_section, CASE action WHEN 'amend' THEN 'amends' WHEN 'create' THEN 'creates' WHEN 'repeal' THEN 'repeals' ELSE 'reenacts' END || ' s. ' || statute || coalesce(' at line ' || line_start, '') || coalesce(' (+' || replace(churn, '|', ' / -') || ' words)', '') AS summary FROM rl")
def reference_summaries(spark: SparkSession, d: str) -> DataFrame:
    out = statutes.summary(statutes.cross_reference(ad.acts(spark, d), DOC))
    return out.select("num", "statute", F.col("bill_section").cast("long").alias("bill_section"), "summary")


@query(with_(more=ACT_SQL + ", " + REF_SQL) + """, ls AS (SELECT num, count(*) AS n, string_agg('  section ' || sec || ': ' || action || 's s. ' || statute || ' at ' || coalesce('line ' || line_start, 'title only') || coalesce(', +' || replace(churn, '|', '/-') || ' words', '') || CASE WHEN bill_section IS NULL THEN '' ELSE ' [Subsection (2) of]' END, chr(10) ORDER BY bill_section NULLS LAST, statute, action) AS list FROM rl GROUP BY num)
    SELECT 'o' AS session, o_orderkey AS num, concat_ws(chr(10), 'BILL: HB ' || o_orderkey || ' — ' || coalesce(o_orderpriority, ''), 'CHAMBER: House', 'SPONSOR: ' || o_custkey, chr(10) || 'STATUTES THIS BILL OPERATES ON (' || n || '):', list) AS header FROM orders LEFT JOIN ls ON num = o_orderkey""")
def act_headers(spark: SparkSession, d: str) -> DataFrame:
    o = ad.table(spark, d, "orders").select(F.lit("o").alias("session"), F.col("o_orderkey").alias("num"), F.concat(F.lit("HB "), F.col("o_orderkey").cast("string")).alias("label"), F.col("o_orderpriority").alias("title"), F.lit("House").alias("chamber"), F.col("o_custkey").cast("string").alias("sponsor"), F.lit("").alias("effective_date"))
    return verify.headers(o, statutes.cross_reference(ad.acts(spark, d), DOC))


@query(with_(more=ACT_SQL) + """SELECT 'o' AS session, num, ch || '.' || unnest(['013', '022', '023']) AS statute, 'repeal' AS action, n + 1 AS bill_section, 'chapter ' || ch AS scope, 'repealed' AS verb, 3 * (n + 1) AS line_start, NULL::BIGINT AS line_end, 0 AS words_added, 0 AS words_deleted, false AS in_title, true AS in_body
    FROM (SELECT l_orderkey AS num, count(*) AS n, (min(l_partkey) % 800 + 1)::VARCHAR AS ch FROM lineitem GROUP BY l_orderkey)""")
def chapter_operations(spark: SparkSession, d: str) -> DataFrame:
    """Acts that end by repealing three sections of a chapter at once."""
    li = ad.table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.count("*") + 1).alias("n"), (F.min("l_partkey") % 800 + 1).cast("string").alias("ch"))
    text = F.concat(F.lit("Section "), F.col("n").cast("string"), F.lit(". Chapter "), "ch", F.lit(", Florida Statutes, consisting of ss. "), F.concat_ws(", ", *[F.concat("ch", F.lit(x)) for x in (".013", ".022", ".023")]), F.lit(", is repealed."))
    last = li.select(F.lit("o").alias("session"), F.col("l_orderkey").alias("num"), (F.col("n") * 3).alias("seg_ix"), F.lit("plain").alias("kind"), text.alias("text"), (F.col("n") * 3).alias("line"), F.lit(1).cast("long").alias("page"))
    out = statutes.cross_reference(ad.acts(spark, d).unionByName(last), DOC).where(F.startswith("scope", F.lit("chapter ")))
    return out.drop("action_label").withColumns({c: F.col(c).cast("long") for c in ("bill_section", "line_start", "line_end")})


@query(with_(more=ACT_SQL) + "SELECT statute, count(DISTINCT num) AS bills, sum(words_added)::BIGINT AS added, sum(words_deleted)::BIGINT AS deleted FROM (SELECT num, statute, words_added, words_deleted FROM a UNION ALL SELECT num, statute, 0, 0 FROM pr) GROUP BY statute")
def cross_reference_index(spark: SparkSession, d: str) -> DataFrame:
    return statutes.statute_index(statutes.cross_reference(ad.acts(spark, d), DOC))


@query(with_("statute_ref") + """, f AS (SELECT DISTINCT session, num, statute FROM statute_ref WHERE words_deleted <> 3), o AS (SELECT DISTINCT session, num, statute FROM statute_ref WHERE action <> 'repeal'),
    j AS (SELECT coalesce(f.session, o.session) AS session, coalesce(f.num, o.num) AS num, f.statute AS fs, o.statute AS os FROM f FULL JOIN o ON f.num = o.num AND f.statute = o.statute), g AS (SELECT session, num, count(fs) AS found, count(os) AS official, count(*) FILTER (fs IS NOT NULL AND os IS NOT NULL) AS agreed FROM j GROUP BY ALL)
    SELECT *, found - agreed AS false_positives, CASE WHEN official > 0 THEN agreed / official END AS recall, coalesce(official > 0 AND agreed / official < 0.9, false) AS weak FROM g""")
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    r = ad.refs(spark, d)
    return statutes.reconciled(r.where("words_deleted != 3"), r.where("action != 'repeal'"))


# --- claims ------------------------------------------------------------------------------

CANON = lambda c: f"trim(regexp_replace(translate(regexp_replace({c}, '\\[\\[[+-]|[+-]\\]\\]', '', 'g'), '{tx.PUNCTUATION}', '{tx.PLAIN.replace(chr(39), chr(39) * 2)}'), '\\s+', ' ', 'g'))"
LOOSE = lambda c: f"regexp_replace(lower({CANON(c)}), '[^a-z0-9]+', '', 'g')"


@query(with_("segment", "claim", more=READ_SQL) + f""", x AS (SELECT c.*, {CANON('quote')} AS q, {LOOSE('quote')} AS l, {CANON('amended')} AS a1, {CANON('standing')} AS a2, {CANON('printed')} AS a3, {LOOSE('amended')} AS l1, {LOOSE('standing')} AS l2, {LOOSE('printed')} AS l3 FROM claim c LEFT JOIN rd USING (session, num)),
    y AS (SELECT *, contains(a1, q) OR contains(a2, q) OR contains(a3, q) AS ex, l <> '' AND (contains(l1, l) OR contains(l2, l) OR contains(l3, l)) AS lo, len(string_split(q, ' ')) < 3 AS short FROM x)
    SELECT session, num, ord, CASE WHEN q = '' OR short OR NOT coalesce(ex OR lo, false) THEN 'failed' WHEN ex THEN 'exact' ELSE 'loose' END AS quote_status,
    CASE WHEN q = '' THEN 'empty quote' WHEN short THEN 'too short to identify a passage' WHEN NOT coalesce(ex OR lo, false) THEN 'not found in the bill text' END AS drop_reason FROM y""")
def claims_checked(spark: SparkSession, d: str) -> DataFrame:
    r = segments.readings(ad.segments(spark, d), DOC)
    return verify.checked(ad.claims(spark, d), r, DOC).select(*DOC, "ord", "quote_status", "drop_reason")


@query(f"SELECT item_id, doc_id FROM benchmark b, documents d WHERE contains({CANON('d.text')}, {CANON('b.text')})")
def quotes_contained(spark: SparkSession, d: str) -> DataFrame:
    return verify.contained(ad.table(spark, d, "benchmark"), ad.table(spark, d, "documents"), "item_id", "doc_id")


@query(with_("segment", "claim") + f""", s AS (SELECT *, lower({CANON('text')}) AS low FROM segment), p AS (SELECT *, sum(length(low) + 1) OVER (PARTITION BY num ORDER BY seg_ix) - 1 - length(low) AS start FROM s),
    w AS (SELECT num, string_agg(low, ' ' ORDER BY seg_ix) AS whole FROM p GROUP BY num), t AS (SELECT c.session, c.num, c.ord, lower({CANON('quote')}) AS q, whole FROM claim c LEFT JOIN w USING (num)),
    spot AS (SELECT *, CASE WHEN length(q) >= 12 THEN instr(whole, left(q, 60)) - 1 END AS pos FROM t)
    SELECT session, num, ord, CASE WHEN pos >= 0 THEN (SELECT arg_max(line, (start, seg_ix)) FROM p WHERE p.num = spot.num AND line IS NOT NULL AND start <= pos) END AS line FROM spot""")
def claims_located(spark: SparkSession, d: str) -> DataFrame:
    return segments.located(ad.segments(spark, d), ad.claims(spark, d), DOC).select(*DOC, "ord", "line")


@query(with_("segment", "claim", "statute_ref") + f""", s AS (SELECT *, lower({CANON('text')}) AS low FROM segment), p AS (SELECT *, sum(length(low) + 1) OVER (PARTITION BY num ORDER BY seg_ix) - 1 - length(low) AS start FROM s),
    w AS (SELECT num, string_agg(low, ' ' ORDER BY seg_ix) AS whole FROM p GROUP BY num), t AS (SELECT c.session, c.num, c.ord, lower({CANON('quote')}) AS q, whole FROM claim c LEFT JOIN w USING (num)),
    spot AS (SELECT *, CASE WHEN length(q) >= 12 THEN instr(whole, left(q, 60)) - 1 END AS pos FROM t)
    SELECT session, num, ord, CASE WHEN pos >= 0 THEN (SELECT arg_max(line, (start, seg_ix)) FROM p WHERE p.num = spot.num AND line IS NOT NULL AND start <= pos) END AS line, '1.02(3)' AS statute, CASE WHEN EXISTS (SELECT 1 FROM statute_ref WHERE statute = '1.02') THEN '1.02' ELSE '' END AS link FROM spot""")
def claims_anchored(spark: SparkSession, d: str) -> DataFrame:
    rows = segments.located(ad.segments(spark, d), ad.claims(spark, d), DOC)
    return lookup.statute_links(rows, ad.refs(spark, d)).select(*DOC, "ord", "line", "statute", "link")


@query("""WITH c AS (SELECT o_custkey AS num, o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'major' WHEN 'O' THEN 'moderate' ELSE 'technical' END AS significance, 'q' || (o_orderkey % 7) AS quote, o_orderkey % 3 AS part FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0),
    d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY num, quote ORDER BY part, ord) = 1)
    SELECT num, ord, significance, quote, part, row_number() OVER (PARTITION BY num ORDER BY CASE significance WHEN 'major' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, part, ord) AS place FROM d QUALIFY place <= 6""")
def claims_merged(spark: SparkSession, d: str) -> DataFrame:
    o = ad.table(spark, d, "orders")
    k = F.col("o_orderkey")
    significance = F.when(F.col("o_orderstatus") == "F", "major").when(F.col("o_orderstatus") == "O", "moderate").otherwise("technical")
    c = o.select(F.col("o_custkey").alias("num"), k.alias("ord"), significance.alias("significance"), F.concat(F.lit("q"), (k % 7).cast("string")).alias("quote"), (k % 3).alias("part"), F.lit("provisions").alias("pass"), F.when(k % 11 == 0, "failed").otherwise("exact").alias("quote_status"), F.when(k % 13 == 0, "x").alias("flagged_for"))
    return verify.merged_parts(c, ["num"], {"provisions": 6}).select("num", "ord", "significance", "quote", "part", F.col("place").cast("long").alias("place"))


@query(with_("statute_ref", "obill") + """SELECT b.session, b.num, label, statute, action, bill_section, words_added, words_deleted, CASE WHEN statute IS NOT NULL THEN 'ok' WHEN b.num % 2 = 0 THEN 'no references found' ELSE 'text not fetched' END AS status
    FROM obill b LEFT JOIN (SELECT * FROM statute_ref WHERE num % 5 <> 0) r ON b.num = r.num""")
def bill_statutes(spark: SparkSession, d: str) -> DataFrame:
    bills = ad.orders_as_bills(spark, d)
    return statutes.of_bill(ad.refs(spark, d).where("num % 5 != 0"), bills, bills.where("num % 2 = 0"))


@query(with_("history", "bill", more=FOLD) + "SELECT session, num, label FROM bill WHERE num IN (SELECT num FROM track WHERE outcome = 'vetoed')")
def vetoed_bills(spark: SparkSession, d: str) -> DataFrame:
    return lookup.restricted(ad.bills(spark, d), _track(spark, d).where("outcome = 'vetoed'"), DOC).select(*DOC, "label")


GUARD_TEXTS = ["The sponsor intends to help", "Claimants' representatives must file", "Representative Smith said so", "A landlord can levy a fee", "Removes the requirement to file", "motivated by a pretext", "The agency is able to act", "It may not be levied"]
GUARD_QUOTES = ["may not be levied", "Compensation may not exceed 125 percent", "shall not apply", "is permitted"]


def _flag(pattern: str, c: str) -> str:
    return f"regexp_matches({c}, '{_q(pattern)}')"


@query(f"""WITH g AS (SELECT conv_id, turn, {ad._list(GUARD_TEXTS)}[(conv_id * 3 + turn) % 8 + 1] || ' ' || left(text, 20) AS consequence, {ad._list(GUARD_QUOTES)}[conv_id % 4 + 1] AS quote FROM conversations)
    SELECT conv_id, turn, {_flag(verify.INTENT, 'consequence')} AS intent, {_flag(verify.PROHIBITION, 'quote')} AND NOT {_flag(verify.CEILING, 'quote')} AND NOT {_flag(verify.NEGATED, 'consequence')} AND {_flag(verify.PERMISSION, 'consequence')} AS inverted, {_flag(verify.REPEAL.replace('?<what>', '?:'), 'consequence')} AND conv_id % 2 = 0 AS repeal FROM g""")
def claim_guards(spark: SparkSession, d: str) -> DataFrame:
    c = ad.table(spark, d, "conversations")
    g = c.select("conv_id", "turn", F.concat(ad.pick(GUARD_TEXTS, (F.col("conv_id") * 3 + F.col("turn")) % 8), F.lit(" "), F.left("text", F.lit(20))).alias("consequence"), ad.pick(GUARD_QUOTES, F.col("conv_id") % 4).alias("quote"), F.when(F.col("conv_id") % 2 == 1, "old words").otherwise(" , ").alias("deleted"))
    return g.select("conv_id", "turn", verify.flags_intent(F.col("consequence")).isNotNull().alias("intent"), verify.flags_inverted(F.col("consequence"), F.col("quote")).isNotNull().alias("inverted"), verify.flags_false_repeal(F.col("consequence"), F.col("deleted")).isNotNull().alias("repeal"))


@query("SELECT conv_id, turn, length(rtrim(text)) >= 108 AND (NOT regexp_matches(rtrim(text), '[.!?]$') OR regexp_matches(rtrim(text), '[-‐-―]\\s*[.!?]?$')) AS cut FROM conversations")
def headline_cuts(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "conversations").select("conv_id", "turn", verify.flags_cut_headline(F.col("text")).isNotNull().alias("cut"))


@query(r"""WITH r AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN text || repeat(chr(10), 30) WHEN conv_id % 7 = 1 THEN '{' || text ELSE text END AS t FROM conversations),
    b AS (SELECT *, regexp_replace(t, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS bare, (list_sort(list_transform(list_filter(list_distinct(string_split(t, '')), lambda c: contains(t, repeat(c, 25))), lambda c: {'p': strpos(t, repeat(c, 25)), 'c': c})))[1].c AS run FROM r)
    SELECT conv_id, turn, CASE WHEN t IS NULL OR bare = '' THEN 'empty response' WHEN run IS NOT NULL THEN 'padded with repeated ''' || replace(run, chr(10), '\n') || '''' WHEN bare LIKE '{%' AND bare NOT LIKE '%}' THEN 'truncated before the object closed' END AS why FROM b""")
def degenerate_replies(spark: SparkSession, d: str) -> DataFrame:
    c = ad.table(spark, d, "conversations")
    odd = F.when(F.col("conv_id") % 7 == 0, F.concat("text", F.repeat(F.lit("\n"), 30))).when(F.col("conv_id") % 7 == 1, F.concat(F.lit("{"), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", tx.degenerate(odd).alias("why"))


@query(with_("segment", "claim", more=READ_SQL) + f""", x AS (SELECT c.*, {CANON('quote')} AS q, {LOOSE('quote')} AS l, {CANON('printed')} AS a3, {LOOSE('printed')} AS l3, {CANON('amended')} AS a1, {CANON('standing')} AS a2, {LOOSE('amended')} AS l1, {LOOSE('standing')} AS l2 FROM claim c LEFT JOIN rd USING (session, num)),
    y AS (SELECT session, num % 10 AS num, NOT (len(string_split(q, ' ')) >= 3 AND coalesce(contains(a1, q) OR contains(a2, q) OR contains(a3, q) OR (l <> '' AND (contains(l1, l) OR contains(l2, l) OR contains(l3, l))), false)) AS bad, ord % 3 = 0 AS fl FROM x)
    SELECT session, num, count(*) FILTER (NOT bad AND NOT fl) AS kept, count(*) FILTER (bad) AS dropped, count(*) FILTER (NOT bad AND fl) AS flagged, round_even(1 - count(*) FILTER (bad) / (count(*) FILTER (NOT bad AND NOT fl) + count(*) FILTER (bad)), 3) AS verify_rate FROM y GROUP BY ALL""")
def claim_stats(spark: SparkSession, d: str) -> DataFrame:
    r = segments.readings(ad.segments(spark, d), DOC)
    c = verify.checked(ad.claims(spark, d), r, DOC).withColumn("num", F.col("num") % 10).withColumn("flagged_for", F.when(F.col("ord") % 3 == 0, "x"))
    return verify.claim_stats(c, DOC)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, ship FROM (SELECT *, CASE WHEN l_shipmode_ = 0 THEN '' ELSE 'Part ' || l_shipmode_ END AS ship FROM (SELECT *, l_partkey % 5 AS l_shipmode_ FROM lineitem))) QUALIFY ship = '' OR row_number() OVER (PARTITION BY l_orderkey, ship ORDER BY l_linenumber, l_partkey) = 1")
def claims_deduped(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey") % 5
    li = ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(k == 0, "").otherwise(F.concat(F.lit("part-"), k.cast("string"))).alias("quote")).distinct()
    return verify.deduped(li, ["l_orderkey"], ["l_linenumber", "l_partkey"]).drop("quote")


@query("SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END, o_orderkey) AS place FROM orders) WHERE place <= 8")
def claims_most_significant(spark: SparkSession, d: str) -> DataFrame:
    o = ad.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "major").when(F.col("o_orderstatus") == "O", "moderate").when(F.col("o_orderstatus") == "P", "technical").alias("significance"))
    return verify.most_significant(o, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("""SELECT conv_id, turn, concat_ws('; ', CASE WHEN text IS NULL THEN 'effect: missing' END, CASE WHEN length(text) < 60 THEN 'effect: shorter than 60' END, CASE WHEN length(text) > 500 THEN 'effect: longer than 500' END,
    CASE WHEN role IS NULL THEN 'significance: missing' END, CASE WHEN role NOT IN ('major', 'moderate', 'technical') THEN 'significance: not among its values' END) AS broken FROM conversations""")
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    c = ad.table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("effect"), F.col("role").alias("significance"))
    return verify.violations(c, ["effect", "significance"]).select("conv_id", "turn", F.array_join("violations", "; ").alias("broken"))


@query("SELECT role AS pass, count(*) AS calls, count(*) FILTER (turn * 10 > 0.5 * length(text)) AS cache_hits, sum(length(text))::BIGINT AS prompt_tokens, sum(turn)::BIGINT AS completion_tokens, sum(conv_id)::BIGINT AS seconds FROM conversations GROUP BY role")
def call_stats(spark: SparkSession, d: str) -> DataFrame:
    c = ad.table(spark, d, "conversations").select(F.col("role").alias("pass"), F.length("text").alias("prompt_tokens"), (F.col("turn") * 10).alias("cached_tokens"), F.col("turn").alias("completion_tokens"), F.col("conv_id").alias("seconds"))
    return verify.call_stats(c)


# --- text functions ----------------------------------------------------------------------


@query(f"SELECT doc_id, md5({CANON('text')}) AS canonical, md5({LOOSE('text')}) AS loose, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS raw_words FROM documents")
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return ad.table(spark, d, "documents").select("doc_id", F.md5(tx.canonical(t).cast("binary")).alias("canonical"), F.md5(tx.loose_key(t).cast("binary")).alias("loose"), tx.raw_words(t).cast("long").alias("raw_words"))


@query("SELECT p_partkey, (p_partkey % 99) || '.' || lpad((p_size)::VARCHAR, 2, '0') AS base, (p_partkey % 99) || '.' || lpad((p_size)::VARCHAR, 2, '0') || '(' || p_size || ')' AS tidy, (p_partkey % 99)::BIGINT AS chapter, lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g')) AS slug FROM part")
def citation_forms(spark: SparkSession, d: str) -> DataFrame:
    n = F.concat_ws(".", (F.col("p_partkey") % 99).cast("string"), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    cite = F.concat(F.lit("s. "), n, F.lit("("), F.col("p_size").cast("string"), F.lit(") (new) - 28 words added"))
    p = ad.table(spark, d, "part").select("p_partkey", cite.alias("c"), "p_brand")
    return p.select("p_partkey", tx.base_cite(tx.tidy_statute(F.col("c"))).alias("base"), tx.tidy_statute(F.col("c")).alias("tidy"), tx.chapter_of(tx.base_cite(F.col("c"))).cast("long").alias("chapter"), tx.slug(F.col("p_brand")).alias("slug"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day, NULL::DATE AS short, o_orderdate::DATE AS loose, o_orderkey AS num FROM orders")
def date_and_number_forms(spark: SparkSession, d: str) -> DataFrame:
    o = ad.table(spark, d, "orders")
    return o.select("o_orderkey", tx.parse_date(F.date_format("o_orderdate", "M/d/yyyy")).alias("day"), tx.parse_date(F.date_format("o_orderdate", "M/d/yy")).alias("short"), tx.parse_date_loose(F.date_format("o_orderdate", "M/d/yyyy")).alias("loose"), tx.bill_number(F.concat(F.lit("HB "), F.col("o_orderkey").cast("string"))).alias("num"))


@query("SELECT id, list_aggregate(list_filter(['automobile', 'education', 'housing', 'insurance'], lambda x: list_contains(areas, x)), 'string_agg', ',') AS areas FROM subscriber".replace("SELECT id", with_("subscriber") + "SELECT id", 1))
def areas_cleaned(spark: SparkSession, d: str) -> DataFrame:
    s = ad.subscribers(spark, d)
    cleaned = tx.clean_areas(F.col("areas"), ["automobile", "education", "housing", "insurance"])
    return s.select("id", F.when(F.size(cleaned) > 0, F.array_join(cleaned, ",")).alias("areas"))


# --- companions --------------------------------------------------------------------------


@query("""WITH pairs AS (SELECT DISTINCT o_custkey AS num, o_custkey + 1 AS other FROM orders), w AS (SELECT o_custkey AS num, o_orderpriority AS word, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT num, sum(n) AS total FROM w GROUP BY num),
    s AS (SELECT p.num, p.other, sum(least(a.n, b.n)) AS shared FROM pairs p JOIN w a ON a.num = p.num JOIN w b ON b.num = p.other AND a.word = b.word GROUP BY ALL)
    SELECT 'c' AS session, p.num, p.other, shared::BIGINT AS shared, t.total::BIGINT AS total, u.total::BIGINT AS other_total, round(2 * coalesce(shared, 0) / (t.total + u.total), 9) AS ratio FROM pairs p JOIN t ON t.num = p.num JOIN t u ON u.num = p.other LEFT JOIN s ON s.num = p.num AND s.other = p.other""")
def companion_overlap(spark: SparkSession, d: str) -> DataFrame:
    o = ad.table(spark, d, "orders")
    words = o.select(F.lit("c").alias("session"), F.col("o_custkey").alias("num"), F.col("o_orderpriority").alias("word"))
    related = words.select("session", "num", (F.col("num") + 1).alias("other")).distinct()
    return lookup.companions(related, words).withColumn("ratio", F.round("ratio", 9)).select("session", "num", "other", "shared", "total", "other_total", "ratio")


# --- pages and geometry ------------------------------------------------------------------


@query()
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_blocks(ad.table(spark, d, "pages"))


@query("SELECT page_id AS page, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"')) AS links FROM pages")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    b = pages.page_blocks(ad.table(spark, d, "pages"))
    return b.groupBy("page").agg(F.count_if((F.col("tag") == "a") & F.col("href").isNotNull()).alias("links"))


@query()
def page_marked_segments(spark: SparkSession, d: str) -> DataFrame:
    p = ad.table(spark, d, "pages")
    marked = p.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<li>", "<ins>"), "</li>", "</ins>"))
    return pages.marked_segments(marked)


PAGE_SQL = """w AS (SELECT l_orderkey // 40 AS page, row_number() OVER () AS word_ix, (l_partkey % 500)::DOUBLE AS x0, (l_partkey % 500 + l_quantity)::DOUBLE AS x1, (l_suppkey % 60 * 10 + 100)::DOUBLE AS top, (l_suppkey % 60 * 10 + 110)::DOUBLE AS bottom FROM lineitem),
    r AS (SELECT o_orderkey // 40 AS page, o_orderkey AS rule_ix, (o_custkey % 450)::DOUBLE AS r0, (o_custkey % 450 + 80)::DOUBLE AS r1, (o_orderkey % 600 + 100)::DOUBLE AS r_top FROM orders)"""


@query(f"""WITH {PAGE_SQL}, c AS (SELECT page, word_ix, rule_ix, (least(x1, r1) - greatest(x0, r0)) / greatest(x1 - x0, 0.01) AS cov, (r_top - top) / greatest(bottom - top, 0.01) AS frac FROM w JOIN r USING (page) WHERE top BETWEEN 120 AND 650 AND r_top BETWEEN top - 3 AND bottom + 4),
    b AS (SELECT page, word_ix, CASE WHEN frac < 0.78 THEN 'delete' ELSE 'insert' END AS mark FROM c WHERE cov >= 0.45 QUALIFY row_number() OVER (PARTITION BY page, word_ix ORDER BY cov DESC, rule_ix) = 1)
    SELECT coalesce(mark, 'plain') AS kind, page, count(*) AS n FROM w LEFT JOIN b USING (page, word_ix) WHERE top BETWEEN 120 AND 650 GROUP BY ALL""")
def geometry_marks(spark: SparkSession, d: str) -> DataFrame:
    """All words and rules, forty orders to a page, so there are more pages in larger tables and none grows."""
    page = lambda key: F.floor(F.col(key) / 40)
    words = ad.table(spark, d, "lineitem").select(page("l_orderkey").alias("page"), F.monotonically_increasing_id().alias("word_ix"), (F.col("l_partkey") % 500).cast("double").alias("x0"), (F.col("l_partkey") % 500 + F.col("l_quantity")).cast("double").alias("x1"), (F.col("l_suppkey") % 60 * 10 + 100).cast("double").alias("top"), (F.col("l_suppkey") % 60 * 10 + 110).cast("double").alias("bottom"))
    return segments.marked_words(words, _rules(spark, d)).groupBy("kind", "page").agg(F.count("*").alias("n"))


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 40).alias("page"), F.col("o_orderkey").alias("rule_ix"), (F.col("o_custkey") % 450).cast("double").alias("x0"), (F.col("o_custkey") % 450 + 80).cast("double").alias("x1"), (F.col("o_orderkey") % 600 + 100).cast("double").alias("top"), F.lit(0.5).alias("height"), F.lit(80.0).alias("width"))


GEOMETRY_SQL = PAGE_SQL.replace("row_number() OVER () AS word_ix", "l_orderkey * 100 + n AS word_ix, CASE WHEN n = 1 THEN l_partkey::VARCHAR ELSE l_returnflag || l_partkey END AS text").replace("FROM lineitem", "FROM li")


@query(f"""WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ad.LINE_ORDER)}) AS n FROM lineitem), {GEOMETRY_SQL}, c AS (SELECT page, word_ix, rule_ix, (least(x1, r1) - greatest(x0, r0)) / greatest(x1 - x0, 0.01) AS cov, (r_top - top) / greatest(bottom - top, 0.01) AS frac FROM w JOIN r USING (page) WHERE top BETWEEN 120 AND 650 AND r_top BETWEEN top - 3 AND bottom + 4),
    b AS (SELECT page, word_ix, CASE WHEN frac < 0.78 THEN 'delete' ELSE 'insert' END AS mark FROM c WHERE cov >= 0.45 QUALIFY row_number() OVER (PARTITION BY page, word_ix ORDER BY cov DESC, rule_ix) = 1),
    m AS (SELECT w.*, coalesce(mark, 'plain') AS kind, (round_even(top / 4, 0) * 4)::BIGINT AS row_at FROM w LEFT JOIN b USING (page, word_ix) WHERE top BETWEEN 120 AND 650), o AS (SELECT *, row_number() OVER (PARTITION BY page, row_at ORDER BY x0, word_ix) AS i FROM m),
    l AS (SELECT *, i = 1 AND x0 < 60 AND regexp_full_match(text, '[0-9]+') AS lead FROM o), t AS (SELECT *, max(CASE WHEN lead THEN try_cast(text AS BIGINT) END) OVER (PARTITION BY page, row_at) AS line FROM l),
    f AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY page, row_at ORDER BY i) THEN 0 ELSE 1 END AS new FROM t WHERE NOT lead), g AS (SELECT *, sum(new) OVER (PARTITION BY page, row_at ORDER BY i) AS run FROM f)
    SELECT page, row_at, line, kind, string_agg(text, ' ' ORDER BY i) AS text, row_number() OVER (PARTITION BY page ORDER BY row_at, run) AS seg_ix FROM g GROUP BY page, row_at, run, line, kind""")
def geometry_lines(spark: SparkSession, d: str) -> DataFrame:
    """Printed pages as segments: rows by height, numbers in the margin as lines, runs of one mark joined."""
    li = ad.table(spark, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ad.LINE_ORDER)))
    part = F.col("l_partkey").cast("string")
    words = li.select(F.floor(F.col("l_orderkey") / 40).alias("page"), (F.col("l_orderkey") * 100 + F.col("n")).alias("word_ix"), F.when(F.col("n") == 1, part).otherwise(F.concat("l_returnflag", part)).alias("text"), (F.col("l_partkey") % 500).cast("double").alias("x0"), (F.col("l_partkey") % 500 + F.col("l_quantity")).cast("double").alias("x1"), (F.col("l_suppkey") % 60 * 10 + 100).cast("double").alias("top"), (F.col("l_suppkey") % 60 * 10 + 110).cast("double").alias("bottom"))
    return segments.geometry_segments(words, _rules(spark, d)).select("page", F.col("row").cast("long").alias("row_at"), F.col("line").cast("long").alias("line"), "kind", "text", F.col("seg_ix").cast("long").alias("seg_ix"))


# --- writes ------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    li = ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("ingest_seq"))
    return writes.upserted(li.where("l_partkey % 2 = 0"), li.where("l_partkey % 2 = 1"), ["l_orderkey", "l_linenumber"]).drop("ingest_seq")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE CASE WHEN l_orderkey % 4 = 0 THEN l_returnflag = 'N' ELSE l_returnflag <> 'N' END")
def children_replaced(spark: SparkSession, d: str) -> DataFrame:
    li = ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    parents = ad.table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    old, new = li.where("l_returnflag != 'N'"), li.where("l_returnflag = 'N' and l_orderkey % 4 = 0")
    return writes.replaced_children({"x": old}, {"x": new}, parents, ["l_orderkey"])["x"].drop("l_returnflag")


@query(with_("segment") + "SELECT session, num, seg_ix AS seq, kind, line, page, left(text, 600) AS text FROM segment WHERE kind <> 'plain'")
def change_rows(spark: SparkSession, d: str) -> DataFrame:
    return writes.changes(ad.segments(spark, d), DOC)


@query("SELECT 'o' AS session, l_orderkey AS num, min(l_partkey) AS row_ix, 15000::BIGINT AS reported, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS scraped, (SELECT count(DISTINCT l_orderkey) FROM lineitem) <> 15000 AS mismatch FROM lineitem GROUP BY l_orderkey")
def enumeration_index(spark: SparkSession, d: str) -> DataFrame:
    li = ad.table(spark, d, "lineitem").select(F.lit("o").alias("session"), F.col("l_orderkey").alias("num"), F.lit(1).alias("page"), F.col("l_partkey").alias("row_ix"), F.lit(15000).cast("long").alias("total"))
    return writes.enumeration(li).drop("page")


@query(f"WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ad.LINE_ORDER)}) AS n FROM lineitem) " + """, it AS (SELECT *, chr(10) || n || '. [' || ['major', 'moderate', 'technical'][n % 3 + 1] || '] Part ' || l_partkey || CASE WHEN n % 2 = 0 THEN ' (s. ' || l_suppkey || '.01)' ELSE '' END || chr(10) || '   ' || l_returnflag || chr(10) || '   "' || l_linestatus || '"' AS item FROM li)
    SELECT 'o' AS session, o_orderkey AS num, 'BILL: ' || o_orderkey || chr(10) || chr(10) || 'WHAT THIS BILL DOES — ' || count(*) || ' provisions' || chr(10) || string_agg(item, chr(10) ORDER BY n) AS text FROM orders JOIN it ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def provision_digests(spark: SparkSession, d: str) -> DataFrame:
    li = ad.table(spark, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ad.LINE_ORDER)))
    cite = F.when(F.col("n") % 2 == 0, F.concat(F.col("l_suppkey").cast("string"), F.lit(".01")))
    provisions = li.select(F.lit("o").alias("session"), F.col("l_orderkey").alias("num"), F.col("n").alias("ord"), cite.alias("statute"), ad.pick(["major", "moderate", "technical"], F.col("n") % 3).alias("significance"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("heading"), F.col("l_returnflag").alias("effect"), F.col("l_linestatus").alias("quote"))
    header = ad.table(spark, d, "orders").select(F.lit("o").alias("session"), F.col("o_orderkey").alias("num"), F.concat(F.lit("BILL: "), F.col("o_orderkey").cast("string")).alias("header"))
    return verify.provision_digest(header, provisions)


@query("SELECT doc_id, sha256(text) AS digest, strlen(text) AS bytes FROM documents")
def document_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text").cast("binary")
    return ad.table(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("digest"), F.length(text).cast("long").alias("bytes"))


@query()
def bill_pages(spark: SparkSession, d: str) -> DataFrame:
    b = ad.bills(spark, d)
    refs = ad.refs(spark, d).select(F.lit("2024").alias("session"), (F.col("num") % 1500).alias("num"), "statute", "action", "bill_section", "words_added", "words_deleted")
    stats = segments.stats(ad.segments(spark, d), DOC).withColumn("session", F.lit("2024"))
    committees = b.where("num < 2").select(pick_name(F.col("num")).alias("name"))
    claims = ad.claims(spark, d).withColumn("session", F.lit("2024"))
    return writes.bill_pages(_track(spark, d), b, refs, stats, _areas(spark, d), areas.split_sponsors(b, committees), claims)


# --- replies, briefs, records ------------------------------------------------------------

REASONS = ["headline cut at the 110-character limit", "claims a repeal ('x')", "unparseable JSON", "reads a prohibition as permission"]
NOTES = [("cut at the", "write a shorter one"), ("claims a repeal", "check what is struck"), ("reads a prohibition", "may not forbids")]


@query(f"SELECT conv_id, turn, ['write a shorter one', 'check what is struck', 'return valid JSON', 'may not forbids'][(conv_id + turn) % 4 + 1] AS note, {ad._list(REASONS)}[(conv_id + turn) % 4 + 1] AS reason FROM conversations")
def retry_notes(spark: SparkSession, d: str) -> DataFrame:
    c = ad.table(spark, d, "conversations").select("conv_id", "turn", ad.pick(REASONS, (F.col("conv_id") + F.col("turn")) % 4).alias("reason"))
    return c.withColumn("note", verify.retry_note(F.col("reason"), NOTES, "return valid JSON"))


@query(with_("segment", "claim", more=READ_SQL) + f""", x AS (SELECT c.*, {CANON('quote')} AS q, {LOOSE('quote')} AS l, {CANON('printed')} AS a3, {LOOSE('printed')} AS l3, {CANON('amended')} AS a1, {CANON('standing')} AS a2, {LOOSE('amended')} AS l1, {LOOSE('standing')} AS l2 FROM claim c LEFT JOIN rd USING (session, num) WHERE ord % 2 = 0)
    SELECT session, num, ord, NOT (num % 3 = 0) AND len(string_split(q, ' ')) >= 3 AND coalesce(contains(a1, q) OR contains(a2, q) OR contains(a3, q) OR (l <> '' AND (contains(l1, l) OR contains(l2, l) OR contains(l3, l))), false) AS restored FROM x""")
def claims_reverified(spark: SparkSession, d: str) -> DataFrame:
    c = ad.claims(spark, d).withColumn("quote_status", F.when(F.col("ord") % 2 == 0, "failed").otherwise("exact")).withColumn("drop_reason", F.lit(None).cast("string")).withColumn("flagged_for", F.lit(None).cast("string")).withColumn("consequence", F.when(F.col("num") % 3 == 0, "The sponsor wants it").otherwise("It applies"))
    return verify.reverified(c, segments.readings(ad.segments(spark, d), DOC), DOC).select(*DOC, "ord", "restored")


@query(with_("segment", "claim", more=READ_SQL) + f""", x AS (SELECT c.*, {CANON('quote')} AS q, {LOOSE('quote')} AS l, {CANON('printed')} AS a3, {LOOSE('printed')} AS l3, {CANON('amended')} AS a1, {CANON('standing')} AS a2, {LOOSE('amended')} AS l1, {LOOSE('standing')} AS l2 FROM claim c LEFT JOIN rd USING (session, num)),
    y AS (SELECT session, num % 10 AS num, ord % 2 = 1 AS was, len(string_split(q, ' ')) >= 3 AND coalesce(contains(a1, q) OR contains(a2, q) OR contains(a3, q) OR (l <> '' AND (contains(l1, l) OR contains(l2, l) OR contains(l3, l))), false) AS holds, num % 3 = 0 AS fl FROM x)
    SELECT session, num, count(*) FILTER (was OR (holds AND NOT fl)) AS kept, count(*) FILTER (NOT was AND NOT holds) AS dropped, count(*) FILTER (NOT was AND holds AND fl) AS flagged, count(*) FILTER (NOT was AND holds AND NOT fl) AS restored,
        round_even(1 - count(*) FILTER (NOT was AND NOT holds) / (count(*) FILTER (was OR (holds AND NOT fl)) + count(*) FILTER (NOT was AND NOT holds)), 3) AS verify_rate FROM y GROUP BY ALL""")
def claims_reinstated(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of all claims, over ten groups of documents, after what was dropped is verified again: restored claims count as kept."""
    c = ad.claims(spark, d).withColumn("quote_status", F.when(F.col("ord") % 2 == 0, "failed").otherwise("exact")).withColumn("drop_reason", F.lit(None).cast("string")).withColumn("flagged_for", F.lit(None).cast("string")).withColumn("consequence", F.when(F.col("num") % 3 == 0, "The sponsor wants it").otherwise("It applies"))
    whole = verify.reinstated(c, segments.readings(ad.segments(spark, d), DOC), DOC).withColumn("num", F.col("num") % 10)
    back = whole.groupBy(*DOC).agg(F.count_if("restored").alias("restored"))
    return verify.claim_stats(whole, DOC).join(back.hint("merge"), DOC)


DEGENERATE_SQL = r"""b AS (SELECT *, regexp_replace(t, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS bare, (list_sort(list_transform(list_filter(list_distinct(string_split(t, '')), lambda c: contains(t, repeat(c, 25))), lambda c: {'p': strpos(t, repeat(c, 25)), 'c': c})))[1].c AS run FROM r)"""


@query(
    "WITH r AS (SELECT conv_id AS num, role AS pass, turn AS attempt, turn % 3 = 0 AS ok, CASE WHEN turn % 3 = 0 THEN '' ELSE '{' || text END AS t FROM conversations), "
    + DEGENERATE_SQL
    + r""", y AS (SELECT num, pass, attempt, ok, CASE WHEN ok THEN NULL WHEN t IS NULL OR bare = '' THEN 'empty response' WHEN run IS NOT NULL THEN 'padded with repeated ''' || replace(run, chr(10), '\n') || '''' WHEN bare NOT LIKE '%}' THEN 'truncated before the object closed' ELSE 'unparseable JSON' END AS why FROM b),
    f AS (SELECT num, pass, min(attempt) FILTER (ok) AS attempt FROM y GROUP BY ALL)
    SELECT f.num, f.pass, f.attempt, coalesce(string_agg(y.attempt || ': ' || why, '; ' ORDER BY y.attempt) FILTER (why IS NOT NULL AND (f.attempt IS NULL OR y.attempt < f.attempt)), '') AS failures FROM f JOIN y USING (num, pass) GROUP BY f.num, f.pass, f.attempt"""
)
def replies_accepted(spark: SparkSession, d: str) -> DataFrame:
    c = ad.table(spark, d, "conversations")
    text = F.when(F.col("turn") % 3 == 0, '{"one_line": "Adds a fee.", "summary": ["x"]}').otherwise(F.concat(F.lit("{"), "text"))
    replies = c.select(F.col("conv_id").alias("num"), F.col("role").alias("pass"), F.col("turn").alias("attempt"), text.alias("text"))
    out = verify.accepted(replies, replies.select("num", F.lit("").alias("deleted")).distinct(), ["num"])
    return out.select("num", "pass", "attempt", F.array_join(F.transform("failures", lambda f: F.concat(f["attempt"].cast("string"), F.lit(": "), f["why"])), "; ").alias("failures"))


@query("SELECT doc_id, n_chars, unnest([0, 1, 2]) AS ord, unnest(['summary', 'provisions', 'implications']) AS pass, unnest([900, 2000, 2000]) AS budget FROM documents")
def model_requests(spark: SparkSession, d: str) -> DataFrame:
    docs = ad.table(spark, d, "documents").select("doc_id", "n_chars")
    return verify.requests(docs, {"summary": 900, "provisions": 2000, "implications": 2000})


@query(with_("segment") + "SELECT session, num, row_number() OVER (PARTITION BY num ORDER BY seg_ix) - 1 AS seg_ix, kind, text, line, page FROM segment")
def packed_segments(spark: SparkSession, d: str) -> DataFrame:
    s = ad.segments(spark, d)
    code = F.array_position(F.array(F.lit("plain"), F.lit("insert"), F.lit("delete")), F.col("kind")) - 1
    part = F.array(code.cast("string"), F.col("line").cast("string"), F.col("page").cast("string"), F.col("text"))
    packed = s.groupBy(*DOC).agg(F.to_json(segments.ordered(part)).alias("segments"))
    out = pages.packed_segments(packed, DOC)
    return out.select(*DOC, F.col("seg_ix").cast("long").alias("seg_ix"), "kind", "text", F.col("line").cast("long").alias("line"), F.col("page").cast("long").alias("page"))


@query(with_("bill") + "SELECT session, num, 'GENERAL BILL' AS subject, array_to_string(list_filter(list_transform(string_split(sponsor, ';'), lambda x: trim(x)), lambda x: x <> ''), '; ') AS sponsor, cosponsors, CASE WHEN regexp_matches(label, '^(CS/)*S') THEN 'Senate' ELSE 'House' END AS chamber FROM bill")
def bylines(spark: SparkSession, d: str) -> DataFrame:
    b = ad.bills(spark, d)
    line = tx.byline(F.concat(F.lit("GENERAL BILL by "), "sponsor", F.lit(" ; (CO-INTRODUCERS) "), "cosponsors"))
    return b.select(*DOC, line.alias("b"), tx.chamber_of(F.col("label")).alias("chamber")).select(*DOC, "b.subject", "b.sponsor", "b.cosponsors", "chamber")


def _map_sql(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{_q(v)}'" for k, v in table.items()) + "}"


@query(with_("history", "bill", more=FOLD) + f"SELECT session, num, {_map_sql(rules.KIND_LABEL)}[kind] AS kind_label, {_map_sql(rules.OUTCOME_LABEL)}[outcome] AS outcome_label, CASE WHEN kind = 'bill' THEN {ad._list(rules.STAGE_LABEL)} ELSE {ad._list(rules.RESOLUTION_LABEL)} END[rank + 1] AS stage_label, CASE WHEN chapter_law IS NOT NULL THEN 'LAW · ch ' || chapter_law ELSE upper({_map_sql(rules.OUTCOME_LABEL)}[outcome]) END AS status FROM track")
def progress_labels(spark: SparkSession, d: str) -> DataFrame:
    return _track(spark, d).select(*DOC, "kind_label", "outcome_label", "stage_label", tx.status_text(F.col("chapter_law"), F.col("outcome_label")).alias("status"))


@query(with_("history", "statute_ref", "bill", more=AREA_CTE + ", " + PAYLOAD) + "SELECT 'daily' AS product, session, '2024-01-06' AS generated, string_agg(num || ' ' || area || ' ' || one_line, '|' ORDER BY num) AS bills FROM rows_ GROUP BY session")
def digest_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = digest.documents(_payload(spark, d), "daily", "2024-01-06")
    return docs.withColumn("bills", F.array_join(F.transform("bills", lambda b: F.concat_ws(" ", b["num"].cast("string"), b["area"], b["one_line"])), "|"))


@query(_walked(PARTS_SQL) + f"SELECT d.session, d.num, part, parts, count(*) AS passages, concat_ws(chr(10), 'BILL: ' || any_value(source), chr(10) || 'CHANGED LANGUAGE — PART ' || part || ' OF ' || parts, {PASSAGE_SQL}) AS text FROM dealt d JOIN documents ON doc_id = d.num GROUP BY d.session, d.num, part, parts")
def brief_part_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = ad.table(spark, d, "documents").select(F.lit("d").alias("session"), F.col("doc_id").alias("num"), F.concat(F.lit("BILL: "), "source").alias("header"))
    return verify.brief_parts(docs, _blocks(spark, d), 2000)


# --- record pages made of orders and line items -------------------------------------------

LI_SQL = f"WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ad.LINE_ORDER)}) AS n, l_orderkey AS page FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) "


def _rows(spark: SparkSession, d: str, *sections: str) -> DataFrame:
    return pages.page_rows(ad.record_pages(spark, d), list(sections))


@query(LI_SQL + "SELECT page, 2 * (n - 1) + k AS seq, strftime(l_shipdate, '%-m/%-d/%Y') AS date, 'House' AS chamber, CASE k WHEN 0 THEN 'Filed ' || l_partkey ELSE 'Read ' || l_suppkey END AS action FROM (SELECT *, unnest([0, 1]) AS k FROM li)")
def page_history(spark: SparkSession, d: str) -> DataFrame:
    return pages.history(_rows(spark, d, "tabBodyBillHistory")).withColumn("seq", F.col("seq").cast("long"))


@query(LI_SQL + "SELECT page, 'v' || n AS version, '1/1/2024' AS posted, fmt, '/t/' || l_partkey || '/' || fmt AS url, 2 * (n - 1) + CASE fmt WHEN 'HTML' THEN 1 ELSE 2 END AS text_seq FROM (SELECT *, unnest(['HTML', 'PDF']) AS fmt FROM li)")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    return pages.texts(_rows(spark, d, "tabBodyBillText")).withColumn("text_seq", F.col("text_seq").cast("long"))


@query(LI_SQL + "SELECT page, 'Committee' AS scope, 'v' || n AS version, 'Committee ' || l_suppkey AS committee, '1/2/2024' AS date, l_returnflag AS result, '' AS url FROM li")
def page_votes(spark: SparkSession, d: str) -> DataFrame:
    return pages.votes(_rows(spark, d, "tabBodyVoteHistory"))


@query(LI_SQL + "SELECT page, 'Floor' AS scope, '' AS version, l_partkey::VARCHAR AS number, 'Delete All' AS kind, 'Delete all' AS description, 'S' || l_suppkey AS filed_by, '1/3' AS posted, 'Adopted' AS action, '/m/' || n AS url FROM li")
def page_amendments(spark: SparkSession, d: str) -> DataFrame:
    return pages.amendments(_rows(spark, d, "CommitteeAmendmentASC", "FloorAmendmentASC"))


@query(LI_SQL + "SELECT page, 'Statutes' AS kind, 'x ' || l_partkey || '.01' AS cite, '/s/' || l_partkey AS url FROM li")
def page_citations(spark: SparkSession, d: str) -> DataFrame:
    return pages.citations(_rows(spark, d, "tabBodyCitations"))


@query(LI_SQL + "SELECT page, 'x HB ' || l_partkey AS label, 'Subject' AS subject, 'S' || l_suppkey AS filed_by, 'Identical' AS relationship, 'Died' AS status, '/b/' || l_partkey AS url FROM li")
def page_related(spark: SparkSession, d: str) -> DataFrame:
    return pages.related(_rows(spark, d, "tabBodyRelatedBills"))


@query(LI_SQL + "SELECT page, 'Analysis' AS kind, l_partkey::VARCHAR AS analysis, 'Rules' AS author, '1/4/2024' AS posted, '/a/' || l_suppkey AS url FROM li")
def page_analyses(spark: SparkSession, d: str) -> DataFrame:
    return pages.analyses(_rows(spark, d, "tabBodyAnalyses"))


@query(LI_SQL + "SELECT o_orderkey AS page, 'CS/HB ' || o_orderkey AS label, 'Order & ' || o_orderpriority AS title, 'House' AS chamber, 'GENERAL BILL' AS subject, 'Roth' AS sponsor, 'Pizzo' AS cosponsors, 'An act.' AS long_title, '/Senators/S3' AS sponsor_url FROM orders WHERE o_orderkey IN (SELECT page FROM li)")
def page_heads(spark: SparkSession, d: str) -> DataFrame:
    return pages.bill_heads(pages.page_parts(ad.record_pages(spark, d), [], ["h2", "p", "a"], pages.MEMBER))


@query(LI_SQL + "SELECT o_orderkey AS page, '7/1/2024' AS effective_date, 'Chapter No. 2024-' || o_orderkey AS last_action, '2024-' || o_orderkey AS chapter_law, '' AS chapter_law_url FROM orders WHERE o_orderkey IN (SELECT page FROM li)")
def page_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return pages.snapshots(pages.page_blocks(ad.record_pages(spark, d), tags=["div", "a"], sections=["snapshot"]))


@query(LI_SQL + "SELECT o_orderkey AS page, 'House' AS chamber, k AS seq, CASE k WHEN 0 THEN 'Rules' ELSE 'Taxes ' || o_custkey END AS name, CASE k WHEN 0 THEN 'RUL' ELSE 'TAX' END AS code FROM (SELECT *, unnest([0, 1]) AS k FROM orders WHERE o_orderkey IN (SELECT page FROM li))")
def page_committees(spark: SparkSession, d: str) -> DataFrame:
    return pages.committee_refs(pages.page_blocks(ad.record_pages(spark, d), tags=["span", "li"], sections=["snapshot"]))


@query("SELECT o_orderkey // 40 AS page, row_number() OVER (PARTITION BY o_orderkey // 40 ORDER BY o_orderkey) AS row_ix, 'HB ' || o_orderkey AS label, o_orderkey AS num, '/Session/Bill/2024/' || o_orderkey AS url, o_orderpriority AS title, 'S' || o_custkey AS filed_by, strftime(o_orderdate, '%-m/%-d/%Y') || ' House - Filed' AS last_action, count(*) OVER (PARTITION BY o_orderkey // 40) AS total FROM orders")
def page_bill_list(spark: SparkSession, d: str) -> DataFrame:
    p = ad.list_pages(spark, d)
    return pages.bill_list(pages.page_rows(p), pages.page_blocks(p)).withColumn("row_ix", F.col("row_ix").cast("long"))


@query("SELECT s_suppkey AS page, '/Senators/S' || (s_suppkey % 40 + 1) AS url, (s_suppkey % 40 + 1)::INTEGER AS district, 'Ana ' || s_name AS name, ['Democrat', 'Republican', ''][s_nationkey % 3 + 1] AS party FROM supplier")
def page_members(spark: SparkSession, d: str) -> DataFrame:
    p = ad.member_pages(spark, d)
    return pages.members(pages.page_blocks(p), p.select(F.col("page_id").alias("page"), "url"))
