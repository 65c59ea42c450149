"""Digests and their delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from actfold.operators.events import recent
from actfold.operators.lookup import keep_first

BILL = ["session", "num"]


def payload_rows(history: DataFrame, bills: DataFrame, areas: DataFrame, one_lines: DataFrame, since: str, until: str, cap: int = 40) -> DataFrame:
    """(session, num, label, title, area, area_slug, one_line) of a window's new bills: by number, the first ``cap`` of a session."""
    new = recent(history, since, until).join(bills.select(*BILL, "label", "title"), BILL, "left")
    new = new.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("num"))).where(F.col("place") <= cap).where("label is not null")
    rows = new.join(areas.select(*BILL, "area", "area_slug"), BILL, "left").join(one_lines.select(*BILL, "one_line"), BILL, "left")
    empty = F.lit("")
    return rows.select(*BILL, "label", F.coalesce("title", empty).alias("title"), F.coalesce("area", F.lit("General")).alias("area"), F.coalesce("area_slug", empty).alias("area_slug"), F.coalesce("one_line", empty).alias("one_line"))


def documents(rows: DataFrame, product: str, generated: str) -> DataFrame:
    """One document a session with bills; none where there are no bills."""
    bills = F.array_sort(F.collect_list(F.struct("num", "label", "title", "area", "area_slug", "one_line")))
    return rows.groupBy("session").agg(bills.alias("bills")).select(F.lit(product).alias("product"), "session", F.lit(generated).alias("generated"), "bills")


def eligible(subscribers: DataFrame, product: str) -> DataFrame:
    return subscribers.where(F.col("confirmed_at").isNotNull() & (F.col("confirmed_at") != "") & ~F.col("unsubscribed") & (F.col("bounces") < 5) & F.col(product))


def deliveries(rows: DataFrame, subscribers: DataFrame, sent: DataFrame, payload: str, product: str) -> DataFrame:
    """(id, email, payload, bills): who gets which bills of a payload now.

    A daily payload goes by area, joined on its slug; a weekly one is the same
    for all, so its bills are put together once and joined as one small row.
    Whoever has it already is left out, so running again sends nothing twice.
    """
    who = eligible(subscribers, product).dropDuplicates(["id"])
    item = F.struct("num", "label", "title", "area", "one_line")
    if product == "daily":
        wants = who.select("id", "email", F.explode(F.array_distinct("areas")).alias("area_slug"))
        mine = wants.join(F.broadcast(rows.where("area_slug != ''")), "area_slug").groupBy("id", "email").agg(F.array_sort(F.collect_list(item)).alias("bills"))  # the payload's cap
    else:
        everything = rows.groupBy(F.lit(1).alias("k")).agg(F.array_sort(F.collect_list(item)).alias("bills"))  # the payload's cap
        mine = who.select("id", "email", F.lit(1).alias("k")).join(F.broadcast(everything), "k").drop("k")
    done = sent.where(F.col("payload") == payload).select(F.col("subscriber_id").alias("id")).distinct()
    return mine.join(done.hint("merge"), "id", "left_anti").withColumn("payload", F.lit(payload))


def messages(out: DataFrame, product: str, session: str, base_url: str) -> DataFrame:
    """deliveries with subject and body."""
    n = F.size("bills")
    subject = F.format_string("%d new bill%s in your areas of interest", n, F.when(n == 1, "").otherwise("s")) if product == "daily" else F.lit(f"The week in the {session} session")
    item = lambda b: F.concat_ws("\n", F.concat(F.upper(b["area"]), F.lit(" — "), b["label"]), b["title"], F.when(b["one_line"] != "", F.concat(F.lit("  "), b["one_line"])), F.concat(F.lit(f"  {base_url}/bills/"), b["num"].cast("string"), F.lit(".html")), F.lit(""))
    opening = "New bills in the areas you follow." if product == "daily" else "What moved in the Legislature this week."
    return out.withColumn("subject", subject).withColumn("body", F.concat_ws("\n", F.lit(opening), F.lit(""), F.array_join(F.transform("bills", item), "\n")))


def bounced(subscribers: DataFrame, attempts: DataFrame) -> DataFrame:
    """subscribers with the failures among attempts(subscriber_id, ok) added to their bounces."""
    failed = attempts.groupBy(F.col("subscriber_id").alias("id")).agg(F.count_if(~F.col("ok")).alias("_failed"))
    return subscribers.join(failed, "id", "left").withColumn("bounces", F.col("bounces") + F.coalesce("_failed", F.lit(0))).drop("_failed")


def queued(requests: DataFrame, open_requests: DataFrame) -> DataFrame:
    """New requests, one a bill, for bills without an open one."""
    first = keep_first(requests, BILL, ["created_at", "email"])
    return first.join(open_requests.where("fulfilled is null or fulfilled = ''").select(*BILL).distinct(), BILL, "left_anti")


def subscriptions(log: DataFrame) -> DataFrame:
    """State of each address from its log (email, at, seq, event, daily, weekly, areas, token_at).

    The last choice counts: subscribing without a product means weekly, saving
    preferences without one means leaving. A confirmation counts within seven
    days of its token; subscribing again takes back having left.
    """
    at = F.struct("at", "seq")
    event, none = F.col("event"), ~F.col("daily") & ~F.col("weekly")
    in_time = (event == "confirm") & (F.datediff("at", "token_at") <= 7)
    choice = event.isin("subscribe", "preferences")
    left = F.when(event == "unsubscribe", True).when((event == "preferences") & none, True).when(choice, False)
    last = lambda c, when: F.max_by(c, F.when(when, at))
    out = log.groupBy("email").agg(
        last(F.col("daily"), choice).alias("daily"),
        last(F.when((event == "subscribe") & none, True).otherwise(F.col("weekly")), choice).alias("weekly"),
        last(F.col("areas"), choice).alias("areas"),
        last(left, left.isNotNull()).alias("unsubscribed"),
        F.min(F.when(in_time, F.col("at"))).alias("confirmed_at"),
    )
    return out.withColumn("unsubscribed", F.coalesce("unsubscribed", F.lit(False)))


