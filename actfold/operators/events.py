"""Folding action logs: stages, outcomes, milestones, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from actfold.functions import rules
from actfold.functions.text import parse_date, parse_date_loose

BILL = ["session", "num"]


def classified(history: DataFrame, bills: DataFrame) -> DataFrame:
    """history with kind, stage, rank and what each action does to the outcome; blank actions are left out."""
    kinds = bills.select(*BILL, rules.kind_of(F.col("label")).alias("kind"))
    rows = history.withColumn("action", F.trim("action")).where("action != ''").join(kinds, BILL, "left").withColumn("kind", F.coalesce("kind", F.lit("bill")))
    a, kind = F.col("action"), F.col("kind")
    adopted, to_state = a.rlike("(?i)^Adopted") & (kind != "bill"), a.rlike("(?i)filed with Secretary of State")
    settled = (
        F.when(a.rlike("(?i)^Vetoed by Governor"), "vetoed")
        .when(a.rlike(r"(?i)^(Approved by Governor|Became Law without|Chapter No\.)"), "became_law")
        .when(adopted, "adopted")
        .when(to_state, F.when(kind == "joint_resolution", "to_ballot").otherwise("adopted"))
    )
    ends = settled.isNull() & rules.is_terminal(a)
    companion = F.when(ends | (settled.isNotNull() & adopted & ~a.rlike("(?i)^(Vetoed by Governor|Approved by Governor|Became Law without|Chapter No)")), rules.companion_of(a))
    return (
        rows.withColumn("stage", rules.stage_of(a))
        .withColumn("rank", rules.rank_of(F.col("stage")))
        .withColumn("settled", settled)
        .withColumn("companion", companion)
        .withColumn("ending", F.when(ends, F.when(F.col("companion").isNotNull(), "superseded").otherwise("died")))
    )


def progress(history: DataFrame, bills: DataFrame) -> DataFrame:
    """One row a bill: kind, stage, rank, percent, outcome, died_in, companion, chapter_law, events, labels.

    The order-dependent fold is grouped: the last settled outcome wins over
    the last ending; where a bill died counts only before anything is settled;
    a chapter number overrides both.
    """
    w = Window.partitionBy(*BILL)
    rows = classified(history, bills).withColumn("first_settled", F.min(F.when(F.col("settled").isNotNull(), F.col("seq"))).over(w))
    died = (F.col("ending") == "died") & (F.col("first_settled").isNull() | (F.col("seq") < F.col("first_settled"))) & rules.died_in(F.col("action")).isNotNull()
    last = lambda c, when: F.max_by(c, F.when(when, F.col("seq")))
    folded = rows.groupBy(*BILL).agg(
        F.max("rank").alias("top"),
        last(F.col("settled"), F.col("settled").isNotNull()).alias("settled"),
        last(F.col("ending"), F.col("ending").isNotNull()).alias("ending"),
        last(F.col("companion"), F.col("companion").isNotNull()).alias("companion"),
        last(rules.died_in(F.col("action")), died).alias("died_in"),
    )
    counts = history.groupBy(*BILL).agg(F.count("*").alias("events"))
    out = bills.select(*BILL, "label", "chapter_law", rules.kind_of(F.col("label")).alias("kind")).join(folded, BILL, "left").join(counts, BILL, "left")
    law = F.col("chapter_law").isNotNull() & (F.col("chapter_law") != "")
    rank = F.when(law, F.lit(len(rules.STAGES) - 1)).otherwise(F.coalesce("top", F.lit(0)))
    out = out.withColumn("rank", rank).withColumn("stage", F.element_at(F.array(*map(F.lit, rules.STAGES)), F.col("rank") + 1))
    out = out.withColumn("outcome", F.when(law, "became_law").otherwise(F.coalesce("settled", "ending", F.lit("pending"))))
    return out.select(
        *BILL, "label", "kind", "stage", "rank", rules.percent(F.col("rank")).alias("percent"), "outcome", "died_in", "companion",
        F.when(law, F.col("chapter_law")).alias("chapter_law"), F.coalesce("events", F.lit(0)).alias("events"),
        rules.stage_label(F.col("stage"), F.col("kind")).alias("stage_label"), rules.lookup(rules.OUTCOME_LABEL, F.col("outcome")).alias("outcome_label"), rules.lookup(rules.KIND_LABEL, F.col("kind")).alias("kind_label"),
    )


def milestones(history: DataFrame, bills: DataFrame) -> DataFrame:
    """The actions that reach a rung no earlier action of the bill had reached."""
    before = Window.partitionBy(*BILL).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = classified(history, bills).where("rank is not null").withColumn("best", F.coalesce(F.max("rank").over(before), F.lit(-1))).where("rank > best")
    return rows.select(*BILL, "seq", "stage", "rank", rules.stage_label(F.col("stage"), F.col("kind")).alias("label"), "date", "chamber", "action")


def pathway(track: DataFrame, miles: DataFrame) -> DataFrame:
    """Every rung for every bill: reached, current, and the date of its milestone."""
    rungs = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(k).alias("rung")) for k, s in enumerate(rules.STAGES)])
    ladder = track.select(*BILL, "kind", F.col("stage").alias("now"), F.col("rank").alias("top"), F.explode(rungs).alias("r")).select(*BILL, "kind", "now", "top", "r.*")
    dated = miles.select(*BILL, "stage", "date")
    out = ladder.join(dated.hint("merge"), [*BILL, "stage"], "left")
    return out.select(*BILL, "rung", "stage", rules.stage_label(F.col("stage"), F.col("kind")).alias("label"), (F.col("rung") <= F.col("top")).alias("reached"), "date", (F.col("stage") == F.col("now")).alias("current"))


def timeline(history: DataFrame, shown: int = 6) -> DataFrame:
    """History newest first, the first few visible."""
    place = F.row_number().over(Window.partitionBy(*BILL).orderBy(F.desc("seq")))
    return history.withColumn("place", place).withColumn("folded", F.col("place") > shown)


def distribution(track: DataFrame) -> DataFrame:
    """How many bills have each outcome and each stage, with shares."""
    n = track.count()
    both = track.select(F.lit("outcome").alias("what"), F.col("outcome").alias("value")).union(track.select(F.lit("stage"), F.col("stage")))
    return both.groupBy("what", "value").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.lit(max(n, 1)))


def outcome_tiles(track: DataFrame) -> DataFrame:
    """Outcome counts in fixed order, and which tile opens: law if any, else the first with rows."""
    order = ["became_law", "vetoed", "died", "superseded", "adopted", "to_ballot", "pending"]
    counts = track.groupBy("outcome").agg(F.count("*").alias("n")).withColumn("ord", F.array_position(F.array(*map(F.lit, order)), F.col("outcome")))
    return counts.withColumn("opens", F.col("ord") == F.min("ord").over(Window.partitionBy()))


def calendar(history: DataFrame) -> DataFrame:
    """First date, last date and number of the actions of each kind of milestone, in one pass."""
    d, a = F.col("day"), F.col("action")
    patterns = {"filed": r"^\s*Filed", "introduced": "Introduced", "governor": "Approved by Governor", "vetoed": "Vetoed"}
    rows = history.select("session", parse_date(F.col("date")).alias("day"), "action").where("day is not null")
    hits = lambda k: a.rlike(f"(?i){patterns[k]}")
    aggs = []
    for k in patterns:
        aggs += [F.min(F.when(hits(k), d)).alias(f"{k}_first"), F.max(F.when(hits(k), d)).alias(f"{k}_last"), F.count_if(hits(k)).alias(f"{k}_n")]
    wide = rows.groupBy("session").agg(*aggs)
    return wide.select("session", F.explode(F.array(*[F.struct(F.lit(k).alias("what"), F.col(f"{k}_first").alias("first"), F.col(f"{k}_last").alias("last"), F.col(f"{k}_n").alias("n")) for k in patterns])).alias("m")).select("session", "m.*").where("n > 0")


def calendar_events(spans: DataFrame) -> DataFrame:
    """(session, day, text) of a session's calendar, by day and text."""
    n = F.format_number("n", 0)
    text = {
        "filed": [("first", F.concat(F.lit("Filing opens — first of "), n, F.lit(" bills filed")))],
        "introduced": [("first", F.lit("Session convenes — bills introduced")), ("last", F.lit("Last bill introduced"))],
        "governor": [("first", F.lit("Governor begins acting on bills")), ("last", F.concat(F.lit("Governor's last action — "), F.col("n").cast("string"), F.lit(" signed")))],
        "vetoed": [("last", F.concat(F.col("n").cast("string"), F.lit(" vetoed")))],
    }
    parts = [spans.where(F.col("what") == k).select("session", F.col(at).alias("day"), t.alias("text")) for k, items in text.items() for at, t in items]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.orderBy("session", "day", "text")


def effective_dates(bills: DataFrame, least: int = 3, big: int = 10) -> DataFrame:
    """Dates on which at least three enacted bills take effect."""
    rows = bills.where("chapter_law is not null and chapter_law != ''").select("session", parse_date(F.col("effective_date")).alias("day")).where("day is not null")
    return rows.groupBy("session", "day").agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("big", F.col("n") >= big)


def phase(spans: DataFrame, today: Column) -> DataFrame:
    """What each session is doing on a day."""
    date = lambda what, at: F.max(F.when(F.col("what") == what, F.col(at)))
    wide = spans.groupBy("session").agg(date("introduced", "first").alias("a"), date("introduced", "last").alias("b"), date("governor", "last").alias("c"))
    state = F.when(today.between(F.col("a"), F.col("b")), "IN SESSION").when((today > F.col("b")) & (today <= F.col("c")), "GOVERNOR ACTION").otherwise("IN RECESS")
    return wide.select("session", state.alias("phase"))


def first_actions(history: DataFrame) -> DataFrame:
    """The first date of each bill; dates that do not parse are skipped."""
    return history.groupBy(*BILL).agg(F.min(parse_date_loose(F.col("date"))).alias("first")).where("first is not null")


def recent(history: DataFrame, since: str, until: str) -> DataFrame:
    """Bills whose first action lies in the window, both ends included."""
    return first_actions(history).where(F.col("first").between(F.lit(since).cast("date"), F.lit(until).cast("date")))
