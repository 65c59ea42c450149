"""The driver's tables in the shapes that the operators take, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACTIONS = [
    "Filed", "Referred to Rules", "On Committee agenda-- Rules, 3/01/24", "Favorable by Rules; YEAS 7 NAYS 2", "Placed on Calendar, on 2nd reading",
    "Read 2nd time", "Read 3rd time", "CS passed; YEAS 38 NAYS 0", "In Messages", "Introduced",
    "Withdrawn from Rules", "Pending reference review", "Laid on Table under Rule 7.18(a)", "CS Filed", "Now in Ways & Means",
    "Reported out of Judiciary", "Received from House", "1st Reading", "Added to Special Order Calendar", "Unfavorable by Rules",
    "Died in Ways & Means Committee, companion none", "Died on Calendar", "Withdrawn prior to introduction", "Laid on Table, companion bill(s) passed, see CS/CS/HB 123 (Ch. 2024-45)", "Died in Rules, companion bill(s) passed, see SB 77",
    "Indefinitely postponed and withdrawn", "Ordered enrolled", "Signed by Officers and presented to Governor", "Vetoed by Governor", "Approved by Governor",
    "Chapter No. 2024-174", "Adopted", "Signed by Officers and filed with Secretary of State", "", "Immediately certified",
    "Referred to Judiciary", "Filed", "Introduced", "Referred to Appropriations", "Laid on Table",
]
PREFIXES = ["CS/HB", "SB", "HJR", "CS/CS/SB", "HR", "SCR", "HM", "HB"]
TITLES = [
    "An act relating to public schools", "Elections", "Motor Vehicle Insurance", "Water Resources", "Artificial Intelligence in Housing",
    "Health Care Patients", "Land Use and Zoning", "Taxation", "Municipalities", "Citrus Farms", "Landlord Tenant Relations", "Criminal Offenders",
    "Toll Highways", "Condominium Associations", "Digital Assets", "Law Enforcement Officers", "Trust Funds", "Special Districts", "Voter Registration",
    "Nursing Homes", "Reinsurance", "Seaport Security", "Memorial of a Veteran", "Coastal Pollution", "Naming of a Bridge",
]
SPONSORS = ["Rules; Judiciary; {}", "{}", "Ways & Means Committee; {}; Rules", ""]
DATES = ["7/1/2024", "10/1/2024", "", "1/1/2025", "upon becoming a law"]
VERBS = ["amended", "created", "repealed", "reenacted"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    num = F.col("user_id") * 10 + F.floor(F.dayofmonth("ts") / 3)
    rows = e.select(F.lit("2024").alias("session"), num.alias("num"), "ts", "event_id", "user_id")
    w = Window.partitionBy("num").orderBy("ts", "event_id")
    return rows.select("session", "num", F.row_number().over(w).cast("long").alias("seq"), F.date_format("ts", "M/d/yyyy").alias("date"), F.when(F.col("event_id") % 2 == 0, "House").otherwise("Senate").alias("chamber"), pick(ACTIONS, (F.col("event_id") * 31 + F.col("user_id") * 17) % len(ACTIONS)).alias("action"))


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    sponsor = pick(SPONSORS, k % 4)
    return c.select(
        F.lit("2024").alias("session"), k.alias("num"), F.concat(pick(PREFIXES, k % 8), F.lit(" "), k.cast("string")).alias("label"),
        pick(TITLES, F.col("c_nationkey") % 25).alias("title"), F.replace(sponsor, F.lit("{}"), F.col("c_name")).alias("sponsor"), F.when(k % 3 == 0, "Jones").otherwise("").alias("cosponsors"),
        F.concat(F.lit("/Senators/S"), (k % 40).cast("string")).alias("sponsor_url"), F.when(k % 9 == 0, F.concat(F.lit("2024-"), k.cast("string"))).otherwise("").alias("chapter_law"),
        pick(DATES, k % 5).alias("effective_date"), F.concat(F.lit("6/13/2024 House - "), pick(ACTIONS, k % len(ACTIONS))).alias("last_action"),
    )


def orders_as_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit("o").alias("session"), F.col("o_orderkey").alias("num"), F.concat(F.lit("HB "), F.col("o_orderkey").cast("string")).alias("label"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("2024-"), F.col("o_orderkey").cast("string"))).otherwise("").alias("chapter_law"))


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("text_seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("long"))
    fmt = F.when(F.col("l_returnflag") == "R", "HTML").otherwise("PDF")
    url = F.concat_ws("/", F.lit("/Session/Bill/o"), F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), fmt)
    return li.select(F.lit("o").alias("session"), F.col("l_orderkey").alias("num"), F.concat(F.lit("v"), (F.col("l_linenumber") % 3).cast("string")).alias("version"), fmt.alias("fmt"), url.alias("url"), "text_seq")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    statute = F.concat_ws(".", (F.col("l_partkey") % 1200 + 1).cast("string"), F.lpad((F.col("l_suppkey") % 4).cast("string"), 2, "0"))
    action = pick(["amend", "create", "repeal", "reenact"], F.col("l_linenumber") % 4)
    return li.select(F.lit("o").alias("session"), F.col("l_orderkey").alias("num"), statute.alias("statute"), action.alias("action"), F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")).alias("bill_section"), F.col("l_quantity").cast("long").alias("words_added"), F.round(F.col("l_discount") * 100).cast("long").alias("words_deleted"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.lit("d").alias("session"), F.col("doc_id").alias("num"), F.posexplode(F.split("text", "\n")).alias("seg_ix", "text")).where("text != ''")
    i = F.col("seg_ix")
    return rows.select("session", "num", i.cast("long").alias("seg_ix"), F.when(i % 5 == 1, "insert").when(i % 5 == 3, "delete").otherwise("plain").alias("kind"), "text", F.when(i % 4 != 3, i + 1).cast("long").alias("line"), (F.floor(i / 20) + 1).cast("long").alias("page"))


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of bills written from orders: a title, then for each line item an opener, an addition and a deletion."""
    li = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))
    cite = F.concat_ws(".", (F.col("l_partkey") % 900 + 1).cast("string"), F.lpad((F.col("l_suppkey") % 50).cast("string"), 2, "0"))
    verb = pick(VERBS, F.col("l_partkey") % 4)
    opener = F.concat(F.lit("Section "), F.col("n").cast("string"), F.lit(". Subsection (2) of section "), cite, F.lit(", Florida Statutes, is "), verb, F.lit(" to read:"))
    added = F.repeat(F.lit("shall apply "), (F.col("l_quantity") % 5).cast("int"))
    struck = F.repeat(F.lit("must "), (F.round(F.col("l_discount") * 100) % 4).cast("int"))
    base = F.col("n") * 3
    part = lambda k, kind, text: F.struct((base + k).cast("long").alias("seg_ix"), F.lit(kind).alias("kind"), F.trim(text).alias("text"), (base + k).cast("long").alias("line"))
    title = F.concat(F.lit("An act relating to trade; amending s. "), cite, F.lit(", F.S.; repealing ss. 998.01 and 999.02(3), F.S.;"))
    first = F.struct(F.lit(0).cast("long").alias("seg_ix"), F.lit("plain").alias("kind"), title.alias("text"), F.lit(None).cast("long").alias("line"))
    body = [part(0, "plain", opener), part(1, "insert", added), part(2, "delete", struck)]
    rows = li.select(F.lit("o").alias("session"), F.col("l_orderkey").alias("num"), F.explode(F.when(F.col("n") == 1, F.array(first, *body)).otherwise(F.array(*body))).alias("s"))
    return rows.select("session", "num", "s.*").withColumn("page", F.lit(1).cast("long")).where("text != ''")


def joined(*parts: str | Column | list) -> Column:
    """Texts and columns, also in lists, in a row; texts that meet are one literal, since each costs time in every row."""
    flat = lambda xs: [y for x in xs for y in (flat(x) if isinstance(x, list) else [x])]
    runs = groupby(flat(parts), key=lambda x: isinstance(x, str))
    return F.concat(*[c for texts, run in runs for c in ([F.lit("".join(run))] if texts else run)])


def record_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html): a record page of every order, its line items as history, texts, votes, amendments, citations and related bills."""
    li = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))
    cell = lambda *c: ["<td>", *c, "</td>"]
    row = lambda *cells: joined("<tr>", *cells, "</tr>")
    link = lambda *c: ['<a href="', *c, '">x</a>']
    n, part, supp = (lambda x: x["n"]), (lambda x: x["part"]), (lambda x: x["supp"])
    parts = {
        "history": lambda x: row(cell(x["shipped"]), cell("House"), cell("&bull; Filed ", part(x), "<br>&bull; Read ", supp(x))),
        "texts": lambda x: row(cell("v", n(x)), cell("1/1/2024"), cell(link("/t/", part(x), "/HTML"), " ", link("/t/", part(x), "/PDF"))),
        "votes": lambda x: row(cell("v", n(x)), cell("Committee ", supp(x)), cell("1/2/2024"), cell(x["flag"])),
        "amendments": lambda x: row(cell(part(x), " - Delete all"), cell("S", supp(x)), cell("1/3"), cell("Adopted"), cell(link("/m/", n(x)))),
        "cites": lambda x: row(cell(link("/s/", part(x)), part(x), ".01")),
        "related": lambda x: row(cell(link("/b/", part(x)), "HB ", part(x)), cell("Subject"), cell("S", supp(x)), cell("Identical"), cell("Died")),
        "analyses": lambda x: row(cell("Analysis"), cell(part(x)), cell("Rules"), cell("1/4/2024"), cell(link("/a/", supp(x)))),
    }
    # The items' values are grouped and joined, a few bytes each; their rows are written out in the page alone.
    item = F.struct("n", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.date_format("l_shipdate", "M/d/yyyy").alias("shipped"), F.col("l_returnflag").alias("flag"))
    texts = lambda x: F.struct(*[x[c].cast("string").alias(c) for c in ("n", "part", "supp", "shipped", "flag")])
    items = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("a")).withColumn("a", F.transform("a", texts))
    rows = lambda k: F.concat(F.lit("<table><tbody>"), F.array_join(F.transform("a", parts[k]), ""), F.lit("</tbody></table>"))
    block = lambda at, head, k: F.concat(F.lit(f'<div id="{at}">{head}'), rows(k), F.lit("</div>"))
    o = table(spark, sf_dir, "orders").join(items.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    key = F.col("o_orderkey").cast("string")
    html = F.concat(
        F.lit("<html><body><h2>CS/HB "), key, F.lit(": Order &amp; "), F.col("o_orderpriority"), F.lit('</h2><p>GENERAL BILL by <a href="/Senators/S3">Roth</a>; (CO-INTRODUCERS) Pizzo</p><p class="width80">An act.</p>'),
        F.lit('<div id="snapshot"><span class="bold">Effective Date:</span> 7/1/2024 <span class="bold">Last Action:</span> Chapter No. 2024-'), key, F.lit(' Bill Text: x<span class="bold">House Committee References</span><ol><li>Rules (RUL)<li>Taxes '), F.col("o_custkey").cast("string"), F.lit(" (TAX)</ol></div>"),
        block("tabBodyBillHistory", "", "history"), block("tabBodyBillText", "", "texts"), block("tabBodyVoteHistory", "<h5>Committee votes</h5>", "votes"), block("FloorAmendmentASC", "", "amendments"),
        block("tabBodyCitations", "<h4>Citations - Statutes (2)</h4>", "cites"), block("tabBodyRelatedBills", "", "related"), block("tabBodyAnalyses", "", "analyses"), F.lit("</body></html>"),
    )
    return o.select(F.col("o_orderkey").alias("page_id"), html.alias("html"))


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html): listing pages of forty orders, with a heading row and the count of bills found."""
    o = table(spark, sf_dir, "orders").withColumn("page_id", F.floor(F.col("o_orderkey") / 40))
    key = F.col("o_orderkey").cast("string")
    row = F.concat(
        F.lit('<tr><th scope="row"><a href="/Session/Bill/2024/'), key, F.lit('">HB '), key, F.lit("</a></th><td>"), F.col("o_orderpriority"), F.lit("</td><td>S"), F.col("o_custkey").cast("string"),
        F.lit("</td><td>Last Action: "), F.date_format("o_orderdate", "M/d/yyyy"), F.lit(" House - Filed</td></tr>"),
    )
    listed = o.groupBy("page_id").agg(F.count("*").cast("string").alias("n"), F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))).alias("a"))
    html = F.concat(F.lit("<p>"), F.col("n"), F.lit(" Bills Found</p><table><thead><tr><th>Number</th><th>Title</th><th>Filed By</th><th>Last Action</th></tr></thead><tbody>"), F.array_join(F.transform("a", lambda x: x["row"]), ""), F.lit("</tbody></table>"))
    return listed.select("page_id", html.alias("html"))


def member_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html): a member's page of every supplier; a third name no party."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    party = pick(["<p>Party: Democrat </p>", "<p>Party: Republican</p>", "<p>Party:</p>"], F.col("s_nationkey") % 3)
    html = F.concat(F.lit('<h1>The Senate</h1><h2>Senator Ana "Nick" '), F.col("s_name"), F.lit("</h2><p>Office</p>"), party)
    return s.select(k.alias("page_id"), F.concat(F.lit("/Senators/S"), (k % 40 + 1).cast("string")).alias("url"), html.alias("html"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as quotes of documents: each is asked of documents by number, in part altered."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id")
    n = b.count()  # ids from 0
    quote = F.when(F.col("doc_id") % 5 == 0, F.upper("text")).when(F.col("doc_id") % 7 == 0, F.lit("no such")).otherwise(F.col("text"))
    rows = d.withColumn("item_id", F.col("doc_id") % n).join(b, "item_id")
    return rows.select(F.lit("d").alias("session"), F.col("doc_id").alias("num"), F.col("item_id").alias("ord"), quote.alias("quote"), F.lit("s. 1.02(3) (new)").alias("statute"))


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    areas = F.array(F.lower("c_mktsegment"), pick(["education", "elections", "insurance", "housing"], k % 4))
    return c.select(k.alias("id"), F.concat("c_name", F.lit("@example.org")).alias("email"), areas.alias("areas"), (k % 2 == 0).alias("daily"), (k % 3 != 0).alias("weekly"), F.when(k % 11 != 0, "2024-01-01").otherwise("").alias("confirmed_at"), (k % 13 == 0).alias("unsubscribed"), (k % 7).alias("bounces"))


# The same shapes for the oracle.
_list = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
CTE = {
    "history": f"""history AS (
        SELECT '2024' AS session, num, row_number() OVER (PARTITION BY num ORDER BY ts, event_id) AS seq, strftime(ts, '%-m/%-d/%Y') AS date,
               CASE WHEN event_id % 2 = 0 THEN 'House' ELSE 'Senate' END AS chamber, {_list(ACTIONS)}[(event_id * 31 + user_id * 17) % {len(ACTIONS)} + 1] AS action
        FROM (SELECT *, user_id * 10 + day(ts) // 3 AS num FROM events))""",
    "bill": f"""bill AS (
        SELECT '2024' AS session, c_custkey AS num, {_list(PREFIXES)}[c_custkey % 8 + 1] || ' ' || c_custkey AS label, {_list(TITLES)}[c_nationkey % 25 + 1] AS title,
               replace({_list(SPONSORS)}[c_custkey % 4 + 1], '{{}}', c_name) AS sponsor, CASE WHEN c_custkey % 3 = 0 THEN 'Jones' ELSE '' END AS cosponsors,
               '/Senators/S' || (c_custkey % 40) AS sponsor_url, CASE WHEN c_custkey % 9 = 0 THEN '2024-' || c_custkey ELSE '' END AS chapter_law,
               {_list(DATES)}[c_custkey % 5 + 1] AS effective_date, '6/13/2024 House - ' || {_list(ACTIONS)}[c_custkey % {len(ACTIONS)} + 1] AS last_action
        FROM customer)""",
    "obill": "obill AS (SELECT 'o' AS session, o_orderkey AS num, 'HB ' || o_orderkey AS label, o_orderpriority AS title, CASE WHEN o_orderstatus = 'F' THEN '2024-' || o_orderkey ELSE '' END AS chapter_law FROM orders)",
    "bill_text": f"""bill_text AS (
        SELECT 'o' AS session, l_orderkey AS num, 'v' || (l_linenumber % 3) AS version, CASE WHEN l_returnflag = 'R' THEN 'HTML' ELSE 'PDF' END AS fmt,
               '/Session/Bill/o/' || l_orderkey || '/' || l_partkey || '/' || CASE WHEN l_returnflag = 'R' THEN 'HTML' ELSE 'PDF' END AS url,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS text_seq FROM lineitem)""",
    "statute_ref": """statute_ref AS (
        SELECT 'o' AS session, l_orderkey AS num, (l_partkey % 1200 + 1) || '.' || lpad((l_suppkey % 4)::VARCHAR, 2, '0') AS statute, ['amend', 'create', 'repeal', 'reenact'][l_linenumber % 4 + 1] AS action,
               CASE WHEN l_returnflag <> 'R' THEN l_linenumber END AS bill_section, l_quantity::BIGINT AS words_added, round(l_discount * 100)::BIGINT AS words_deleted FROM lineitem)""",
    "segment": """segment AS (
        SELECT 'd' AS session, num, i AS seg_ix, CASE i % 5 WHEN 1 THEN 'insert' WHEN 3 THEN 'delete' ELSE 'plain' END AS kind, text, CASE WHEN i % 4 <> 3 THEN i + 1 END AS line, i // 20 + 1 AS page
        FROM (SELECT doc_id AS num, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10)))))::BIGINT AS i FROM documents) WHERE text <> '')""",
    "claim": """claim AS (
        SELECT 'd' AS session, doc_id AS num, item_id AS ord, CASE WHEN doc_id % 5 = 0 THEN upper(text) WHEN doc_id % 7 = 0 THEN 'no such' ELSE text END AS quote, 's. 1.02(3) (new)' AS statute
        FROM (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents) JOIN benchmark USING (item_id))""",
    "subscriber": """subscriber AS (
        SELECT c_custkey AS id, c_name || '@example.org' AS email, [lower(c_mktsegment), ['education', 'elections', 'insurance', 'housing'][c_custkey % 4 + 1]] AS areas, c_custkey % 2 = 0 AS daily, c_custkey % 3 <> 0 AS weekly,
               CASE WHEN c_custkey % 11 <> 0 THEN '2024-01-01' ELSE '' END AS confirmed_at, c_custkey % 13 = 0 AS unsubscribed, c_custkey % 7 AS bounces FROM customer)""",
}


def with_(*names: str, more: str = "") -> str:
    return "WITH " + ", ".join([CTE[n] for n in names] + ([more] if more else [])) + " "
