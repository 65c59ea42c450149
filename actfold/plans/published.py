"""Registered queries over tables that are published together, kept up to date by streams, and read from files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actfold.operators import events, writes
from actfold.operators.snapshots import Snapshots
from actfold.plans import adapters as ad
from actfold.plans import catalog
from actfold.scratch import folder, saved
from actfold.sources import pages
from actfold.streaming import live

CHILDREN = {"history": "page_history", "committee_ref": "page_committees", "bill_text": "page_texts", "analysis": "page_analyses", "vote": "page_votes", "amendment": "page_amendments", "citation": "page_citations", "related": "page_related"}
TABLES = {"bill": "page_heads"} | CHILDREN


SECTIONS = {
    "history": ["tabBodyBillHistory"], "bill_text": ["tabBodyBillText"], "analysis": ["tabBodyAnalyses"], "vote": ["tabBodyVoteHistory"], "amendment": ["CommitteeAmendmentASC", "FloorAmendmentASC"],
    "citation": ["tabBodyCitations"], "related": ["tabBodyRelatedBills"],
}
RECORDS = {"history": pages.history, "bill_text": pages.texts, "analysis": pages.analyses, "vote": pages.votes, "amendment": pages.amendments, "citation": pages.citations, "related": pages.related}


def page_tables(rows: DataFrame, tables: list[str], keep: Callable[[DataFrame, str], DataFrame] = saved) -> dict[str, DataFrame]:
    """Some of a bill and its eight children from rows (page_id, html), which are parsed once, for the sections and tags that these are made of."""
    out, sections = {}, [s for t in tables for s in SECTIONS.get(t, [])]
    tags = [g for t in tables for g in {"bill": ["h2", "p", "a"], "committee_ref": ["span", "li"]}.get(t, [])]
    if sections:
        parts = keep(pages.page_parts(rows, sections, tags, pages.MEMBER), "rows")
        out = {t: RECORDS[t](pages.rows_in(parts, SECTIONS[t])) for t in tables if t in RECORDS}
    if tags:
        # Blocks are a small table of their own, which is cut out of the pages that were read, if they were.
        blocks = keep(parts.select("page", "blocks") if sections else pages.page_parts(rows, [], tags, pages.MEMBER), "blocks")
        if "bill" in tables:
            out["bill"] = pages.bill_heads(blocks)
        if "committee_ref" in tables:
            out["committee_ref"] = pages.committee_refs(blocks.select("page", F.inline("blocks")))
    return out


def page_site(spark: SparkSession, tables: list[str], parts: int = 16) -> Snapshots:
    empty = page_tables(spark.createDataFrame([], "page_id long, html string"), tables, lambda df, name: df)
    return Snapshots(spark, folder(spark, "site"), {t: empty[t].schema for t in tables}, ["page"], parts)


def children_published(spark: SparkSession, d: str) -> DataFrame:
    """Bills with their eight child tables: first with outdated pages of urgent orders, then those replaced in one commit; all rows as text."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    rows = saved(ad.record_pages(spark, d).join(ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), urgent.alias("urgent")).hint("merge"), "page_id"), "pages")
    outdated = F.when(F.col("urgent"), "<html><h2>HB 1: Outdated</h2><div id='tabBodyCitations'><h4>Citations - Statutes (1)</h4><table><tr><td><a href='/s/0'>0</a></td></tr></table></div></html>").otherwise(F.col("html"))
    site = page_site(spark, list(TABLES))
    site.replace(rows.select(F.col("page_id").alias("page")), page_tables(rows.select("page_id", outdated.alias("html")), list(TABLES)))
    again = rows.where("urgent")
    site.replace(again.select(F.col("page_id").alias("page")), page_tables(again, list(TABLES)))
    out = [site.read(t) for t in TABLES]
    shown = [x.select(F.lit(t).alias("tbl"), "page", F.concat_ws("|", *[F.col(c).cast("string") for c in sorted(x.columns) if c != "page"]).alias("row")) for t, x in zip(TABLES, out, strict=True)]
    whole = shown[0]
    for x in shown[1:]:
        whole = whole.union(x)
    return whole


HISTORY = "session string, num long, seq long, action string"


def _history(spark: SparkSession, d: str) -> DataFrame:
    """Actions of bills with the time that they happened at."""
    num = F.col("user_id") * 10 + F.floor(F.dayofmonth("ts") / 3)
    action = ad.pick(ad.ACTIONS, (F.col("event_id") * 31 + F.col("user_id") * 17) % len(ad.ACTIONS))
    seq = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    return ad.table(spark, d, "events").select(F.lit("2024").alias("session"), num.alias("num"), seq.alias("seq"), action.alias("action"))


def arrivals(rows: DataFrame, by: str, n: int) -> list[DataFrame]:
    """All rows in n shares of about the same size, in the order of a number; nulls are in the first."""
    cuts = rows.approxQuantile(by, [k / n for k in range(1, n)], 0.001)
    place = sum([F.coalesce((F.col(by) > c).cast("int"), F.lit(0)) for c in cuts], F.lit(0))
    return [rows.where(place == k) for k in range(n)]


def stream_refresh(spark: SparkSession, d: str) -> DataFrame:
    """A complete site of every bill's progress, made of the first half of the actions, and three runs of a stream that refresh the bills whose actions arrive."""
    base, *later = arrivals(saved(_history(spark, d), "actions"), "seq", 4)
    bills, inbox, state = ad.bills(spark, d), folder(spark, "inbox"), folder(spark, "state")

    def make(history: DataFrame, keys: DataFrame) -> dict[str, DataFrame]:
        return {"progress": events.progress(history, live.touched(keys, bills, events.BILL))}

    schema = make(base, bills)["progress"].schema
    site = Snapshots(spark, folder(spark, "site"), {"history": HISTORY, "progress": schema}, events.BILL)
    site.replace(bills.select(*events.BILL).union(base.select(*events.BILL)), {"history": base} | make(base, bills))
    for rows in later:
        rows.write.mode("append").parquet(inbox)
        live.run_available(live.read_new(spark, inbox, HISTORY), state, live.refresher(site, "history", make)).awaitTermination()
    out = site.read("progress")
    return out.select(*events.BILL, "label", "kind", "stage", F.col("rank").cast("long").alias("rank"), F.col("percent").cast("long").alias("percent"), "outcome", "died_in", "companion", "chapter_law", "events")


class Stopped(RuntimeError):
    """A stop between two steps, as a lost driver makes it."""


def stopping(sink: live.Sink, before: bool) -> live.Sink:
    """The sink of a run that ends at its first batch, before it is committed or after that, but before the stream knows."""

    def run(batch: DataFrame, n: int) -> None:
        if not before:
            sink(batch, n)
        raise Stopped(f"batch {n}")

    return run


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Record pages that arrive in three shares, the later ones with other pages of bills that are known: five runs of one stream, two of them cut off.

    What is known stays as it was read first, and nothing comes twice.
    """
    first, *more = arrivals(saved(ad.record_pages(spark, d), "pages"), "page_id", 3)
    other = first.select("page_id", F.lit("<html><h2>HB 1: Another page of a bill that is known</h2></html>").alias("html"))
    inbox, state = folder(spark, "inbox"), folder(spark, "state")
    site = page_site(spark, ["bill", "bill_text"])
    sink = live.ingester(site, "bill", lambda rows: page_tables(rows.withColumnRenamed("page", "page_id"), list(site.tables)))

    def run(sink: live.Sink) -> None:
        rows = live.read_new(spark, inbox, "page_id long, html string").withColumnRenamed("page_id", "page")
        live.run_available(rows, state, sink).awaitTermination()

    first.write.parquet(inbox)
    run(sink)
    for rows, before in zip(more, (True, False), strict=True):
        rows.unionByName(other).write.mode("append").parquet(inbox)
        try:
            run(stopping(sink, before))
        except StreamingQueryException:
            run(sink)
    return site.read("bill").join(site.read("bill_text").groupBy("page").agg(F.count("*").alias("texts")).hint("merge"), "page")


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Digest deliveries of the events table: a subscriber gets a day's digest of a kind once; every tenth comes five days after its time."""
    e = ad.table(spark, d, "events").select(F.col("user_id").alias("subscriber_id"), F.concat_ws(" ", "event_type", F.to_date("ts").cast("string")).alias("payload"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    late = F.when(F.col("event_id") % 10 == 0, 86400 * 5).otherwise(0)
    return e.withColumn("arrives", F.unix_seconds("ts") + late)


DELIVERY = "subscriber_id long, payload string, ts timestamp"


def stream_once_daily(spark: SparkSession, d: str, shares: int = 6, progress: list | None = None) -> DataFrame:
    """Each digest once, over runs of one stream whose state is dropped six days after a delivery, though repeats come up to five days late."""
    inbox, state, out = folder(spark, "inbox"), folder(spark, "state"), folder(spark, "once")
    for rows in arrivals(saved(deliveries(spark, d), "deliveries"), "arrives", shares):
        rows.select("subscriber_id", "payload", "ts").write.mode("append").parquet(inbox)
        run = live.run_available(live.once(live.read_new(spark, inbox, DELIVERY), "6 days"), state, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/part={n}"))
        run.awaitTermination()
        if progress is not None:
            progress += run.recentProgress
    return spark.read.option("basePath", out).parquet(out).select("subscriber_id", "payload")


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """Fields of JSON texts, with broken, empty, missing and other values mixed in."""
    i, p = F.col("event_id") % 7, F.col("props")
    mixed = F.when(i == 0, F.substring(p, F.lit(1), F.length(p) - 1)).when(i == 1, " ").when(i == 2, F.lit(None)).when(i == 3, F.replace(p, F.lit(":"), F.lit(': "x" , "m":'))).when(i == 4, F.concat(F.lit('{"in": '), p, F.lit("}"))).when(i == 5, F.concat(F.lit("["), p, F.lit("]"))).otherwise(p)
    rows = ad.table(spark, d, "events").select("event_id", mixed.alias("text"))
    return pages.tolerant(rows, "text", {"k": ("$.k", "bigint"), "m": ("$.m", "bigint"), "inner": ("$.in.k", "bigint"), "first": ("$[0].k", "bigint")}).drop("text")


#: Hadoop's setting by which a task's files go to the folder when the task ends.
COMMIT = "mapreduce.fileoutputcommitter.algorithm.version"

#: Tasks that files are made in.
FILE_TASKS = 192


def page_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as a file each, and read as files: size, digest, and the digest of the text."""
    rows = ad.table(spark, d, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), F.lit("\n")).cast("binary").alias("value"))
    # Making a file takes longer than filling it, so the pages are spread over all tasks, however few files hold the table.
    rows = rows.withColumn("name", F.concat(F.lit("page_id="), F.col("page_id").cast("string"))).repartition(FILE_TASKS, "page_id")
    made = saved(writes.file_each(rows, folder(spark, "files"), "name", "value", ".txt"), "made")
    files = pages.documents(spark, *[r[0] for r in made.select("folder").distinct().collect()])
    return files.select(F.regexp_extract("path", r"page_id=(-?\d+)", 1).try_cast("long").alias("page_id"), F.col("nbytes").cast("long").alias("nbytes"), "sha256", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def index_files(spark: SparkSession, d: str) -> DataFrame:
    """Index files of 400 orders, each a JSON object of a session's bills with their number, written and read as files."""
    at, o = folder(spark, "index"), ad.table(spark, d, "orders")
    bill = F.struct(F.col("o_orderkey").alias("num"), F.concat(F.lit("HB "), F.col("o_orderkey").cast("string")).alias("label"), F.col("o_orderpriority").alias("title"))
    listed = o.groupBy(F.floor(F.col("o_orderkey") / 400).alias("page")).agg(F.lit("2024").alias("session"), F.count("*").alias("reported_total"), F.array_sort(F.collect_list(bill)).alias("bills"))
    # One record a file, without a folder for each; tasks put their own files in place, since the driver would move them one by one.
    listed.drop("page").write.option("maxRecordsPerFile", 1).option(COMMIT, 2).json(at)
    return pages.index_file(spark, at, "session string, reported_total long, bills array<struct<num: long, label: string, title: string>>").select("session", "reported_total", F.explode("bills").alias("b")).select("session", "reported_total", "b.*")


def bill_page_rows(spark: SparkSession, d: str) -> DataFrame:
    """All that a bill's page shows as one row of plain columns: its lists joined, in order."""
    rows = catalog.bill_pages(spark, d)
    ref = lambda r: F.concat_ws(" ", F.coalesce(r["bill_section"].cast("string"), F.lit("-")), r["statute"], r["action"], r["words_added"].cast("string"), r["words_deleted"].cast("string"))
    claim = lambda c: F.concat_ws(" ", c["ord"].cast("string"), F.md5(c["quote"].cast("binary")), c["statute"])
    joined = lambda c, f: F.coalesce(F.array_join(F.array_sort(F.transform(c, f)), "; "), F.lit(""))
    people = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return rows.select("session", "num", "label", "title", "sponsor", "kind", "stage", "outcome", "events", "area", joined("refs", ref).alias("refs"), joined("claims", claim).alias("claims"), "segments", "words_inserted", "words_deleted", people("panels").alias("panels"), people("people").alias("people"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (children_published, stream_refresh, stream_ingest, stream_once_daily, event_props, page_files, index_files, bill_page_rows)}


def _row_sql(table: str, columns: list[str]) -> str:
    return f"SELECT '{table}' AS tbl, page, concat_ws('|', {', '.join(sorted(columns))}) AS row FROM ({catalog.SQL[TABLES[table]]})"


SQL = {
    "children_published": " UNION ALL ".join(
        _row_sql(t, c.split())
        for t, c in {
            "bill": "label title chamber subject sponsor cosponsors long_title sponsor_url", "history": "seq date chamber action", "committee_ref": "chamber seq name code", "bill_text": "version posted fmt url text_seq",
            "analysis": "kind analysis author posted url", "vote": "scope version committee date result url", "amendment": "scope version number kind description filed_by posted action url",
            "citation": "kind cite url", "related": "label subject filed_by relationship status url",
        }.items()
    ),
    "stream_once_daily": "SELECT DISTINCT user_id AS subscriber_id, event_type || ' ' || ts::DATE AS payload FROM events",
    "event_props": """WITH t AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN left(props, length(props) - 1) WHEN 1 THEN ' ' WHEN 2 THEN NULL WHEN 3 THEN replace(props, ':', ': "x" , "m":') WHEN 4 THEN '{"in": ' || props || '}' WHEN 5 THEN '[' || props || ']' ELSE props END AS p FROM events),
        v AS (SELECT event_id, p, CASE WHEN json_valid(p) THEN p::JSON END AS j FROM t)
        SELECT event_id, TRY_CAST(j->>'$.k' AS BIGINT) AS k, TRY_CAST(j->>'$.m' AS BIGINT) AS m, TRY_CAST(j->>'$.in.k' AS BIGINT) AS "inner", TRY_CAST(j->>'$[0].k' AS BIGINT) AS first, coalesce(trim(p) <> '' AND NOT json_valid(p), false) AS bad FROM v""",
    "page_files": "SELECT page_id, octet_length(encode(h)) AS nbytes, sha256(h) AS sha256, md5(h) AS text_md5 FROM (SELECT page_id, coalesce(html, '') || chr(10) AS h FROM pages)",
    "index_files": "SELECT '2024' AS session, count(*) OVER (PARTITION BY o_orderkey // 400) AS reported_total, o_orderkey AS num, 'HB ' || o_orderkey AS label, o_orderpriority AS title FROM orders",
    "bill_page_rows": f"""WITH ref AS (SELECT num % 1500 AS num, string_agg(t, '; ' ORDER BY t) AS refs FROM (SELECT num, concat_ws(' ', coalesce(bill_section::VARCHAR, '-'), statute, action, words_added, words_deleted) AS t FROM ({ad.with_('statute_ref')} SELECT * FROM statute_ref)) GROUP BY num % 1500),
        cl AS (SELECT num, string_agg(t, '; ' ORDER BY t) AS claims FROM (SELECT num, concat_ws(' ', ord, md5(quote), statute) AS t FROM ({ad.with_('claim')} SELECT * FROM claim)) GROUP BY num)
        SELECT b.session, b.num, b.label, b.title, b.sponsor, t.kind, t.stage, t.outcome, t.events, a.area, coalesce(ref.refs, '') AS refs, coalesce(cl.claims, '') AS claims, s.segments, s.words_inserted, s.words_deleted, coalesce(p.panels, '') AS panels, coalesce(p.people, '') AS people
        FROM ({ad.with_('bill')} SELECT * FROM bill) b LEFT JOIN ({catalog.SQL['progress']}) t ON t.num = b.num LEFT JOIN ({catalog.SQL['bill_areas']}) a ON a.num = b.num LEFT JOIN ref ON ref.num = b.num LEFT JOIN cl ON cl.num = b.num
        LEFT JOIN ({catalog.SQL['segment_stats']}) s ON s.num = b.num LEFT JOIN ({catalog.SQL['sponsor_split']}) p ON p.num = b.num""",
    "stream_refresh": catalog.SQL["progress"],
    "stream_ingest": f"SELECT h.*, texts FROM ({catalog.SQL['page_heads']}) h JOIN (SELECT page, count(*) AS texts FROM ({catalog.SQL['page_texts']}) GROUP BY page) t USING (page)",
}
