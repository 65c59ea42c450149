"""Statute references of bill texts: title promises, section openers, chapter-wide operations, and the index over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actfold.functions import rules
from actfold.functions import text as tx

# How bills name sections, statutes, chapters and verbs.
SECTION = r"\bSection\s+(\d+)\.\s"
STATUTE = r"(?i)\bsection\s+(\d+[0-9A-Za-z.]*)\s*,\s*Florida\s+Statutes"
STATUTE_SHORT = r"(?i)\bs{1,2}\.\s*(\d+[0-9A-Za-z.]*)\s*,\s*F\.S\."
CHAPTER = r"(?is)\bChapter\s+(\d+[0-9A-Za-z.-]*)\s*,\s*Florida\s+Statutes\s*,(?:\s*consisting\s+of\s+ss?\.\s*(.{0,4000}?))?\s*,?\s*(?:is|are)\s+(repealed|amended|created|transferred|renumbered)"
VERB = r"(?i)\b(?:is|are)\s+(amended|created|added|repealed|reenacted|redesignated|renumbered|reordered|transferred|revived|readopted|directed)\b"
ADDED_TO = r"(?i)\bis\s+added\s+to\s+section\b"
TITLE = r"(?i)\b(?=[acrt])(amending|creating|repealing|reenacting|renumbering|transferring|redesignating|revising|abrogating)\s+s{1,2}\.\s*([\d][0-9A-Za-z.()\s,]*?)\s*(?:,?\s*F\.S\.|,\s*relating\s+to\b|;)"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression of a value that is found once a row: a column that only a function of an array's elements names may be found anew for each."""
    return F.transform(F.array(value), then)[0]


def running(lengths: Column, block: int = 128) -> Column:
    """For each number of an array, the sum of those before it. Sums are appended within blocks, so that a long array isn't copied once an element."""
    init = F.struct(F.lit(0).cast("long").alias("to"), F.array().cast("array<bigint>").alias("sums"))
    step = lambda acc, n: F.struct((acc["to"] + n).alias("to"), F.concat(acc["sums"], F.array(acc["to"])).alias("sums"))
    before = lambda values: F.aggregate(values, init, step)["sums"]
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda acc, n: acc + n)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, F.lit(block)))
    long = F.flatten(F.zip_with(blocks, before(F.transform(blocks, total)), lambda values, at: F.transform(before(values), lambda x: x + at)))
    return F.when(F.size(lengths) <= block, before(lengths)).otherwise(long)


def below(points: Column, starts: Column) -> Column:
    """For each of rising points, how many starts are less: in one sorted array of both, a point's place without the points before it."""
    line = F.sort_array(F.concat(F.transform(points, lambda x: x * 2), F.transform(starts, lambda x: x * 2 + 1)))  # numbers sort without a comparing function
    asked = F.filter(F.transform(line, lambda x, i: F.when(x % 2 == 0, i)), lambda i: i.isNotNull())
    return F.transform(asked, lambda at, i: at - i)


def title_refs(full: Column) -> Column:
    """What the first 20,000 characters promise, each once, as ``action statute``."""
    found = F.regexp_extract_all(F.substring(full, 1, 20000), F.lit(f"({TITLE})"), 1)
    verb = lambda m: F.lower(F.regexp_extract(m, TITLE, 1))
    said = F.transform(found, lambda m: F.struct(verb(m).alias("verb"), tx.cites_in(F.regexp_extract(m, TITLE, 2)).alias("cites")))
    action = lambda m: F.coalesce(rules.lookup(rules.ACTION_CATEGORY, m["verb"]), m["verb"])
    return F.array_distinct(F.flatten(F.transform(said, lambda m: F.transform(m["cites"], lambda c: F.concat(action(m), F.lit(" "), c)))))


def operations(full: str, pieces: str, starts: str) -> list[Column]:
    """The numbered sections of a text, each with its place and what it operates on, from the columns' names: steps, each of which reads the one before as ``sections``.

    A section's head is its first 320 characters, with those of the next ones,
    its body up to 4,600 of its own.
    """
    # A section has ten characters at least, so 33 pieces hold the 320 of a head.
    head = lambda p, i: F.left(F.when(F.length(p) >= 320, p).otherwise(F.array_join(F.slice(pieces, i + 1, F.lit(33)), "")), F.lit(320))
    end = lambda i: F.coalesce(F.get(starts, i + 1), F.length(full).cast("long"))
    piece = lambda p, i: F.struct(F.regexp_extract(p, f"^{SECTION}", 1).alias("number"), F.get(starts, i).alias("start"), end(i).alias("end"), head(p, i).alias("head"), F.left(p, F.lit(4600)).alias("body"))

    def read(s: Column) -> Column:
        found = {"full": F.regexp_extract(s["head"], STATUTE, 1), "where": F.regexp_instr(s["body"], F.lit(CHAPTER)), "said": F.lower(F.regexp_extract(s["head"], VERB, 1))}
        for name, value in found.items():
            s = s.withField(name, value)
        return s.withField("bill_section", s["number"].cast("int"))

    def chapter(s: Column) -> Column:
        s = s.withField("short", F.when(s["full"] == "", F.regexp_extract(s["head"], STATUTE_SHORT, 1)).otherwise(""))
        s = s.withField("wide", (s["where"] > 0) & ((s["full"] == "") | (s["where"] - 1 < 120)))
        return s.withField("chapter", F.when(s["wide"], F.regexp_extract(s["body"], CHAPTER, 1))).withField("listed", F.when(s["wide"], tx.cites_in(F.regexp_extract(s["body"], CHAPTER, 2))))

    def operation(s: Column) -> Column:
        at = F.when(s["full"] != "", F.regexp_instr(s["head"], F.lit(STATUTE))).otherwise(F.regexp_instr(s["head"], F.lit(STATUTE_SHORT)))
        opener = F.length(F.concat(F.lit("Section "), s["bill_section"].cast("string"), F.lit(". ")))
        between = F.substring(s["head"], opener + 1, F.greatest(at - 1 - opener, F.lit(0)))
        members = F.when(~s["wide"], F.array(F.when(s["full"] != "", s["full"]).otherwise(s["short"]))).when(F.size(s["listed"]) > 0, s["listed"]).otherwise(F.array(s["chapter"]))
        verb = F.when(s["wide"], F.lower(F.regexp_extract(s["body"], CHAPTER, 3))).when(s["said"] != "", s["said"]).when(s["head"].rlike(ADDED_TO), "added").otherwise("amended")
        scope = F.when(s["wide"], F.concat(F.lit("chapter "), s["chapter"])).otherwise(F.left(F.regexp_replace(F.regexp_replace(between, r"(?U)\s+", " "), "^[ ,]+|[ ,]+$", ""), F.lit(160)))
        return F.struct(*[s[c].alias(c) for c in ("bill_section", "start", "end", "wide")], members.alias("members"), verb.alias("verb"), scope.alias("scope"))

    steps = [F.filter(F.transform(pieces, piece), lambda s: s["number"] != ""), F.transform("sections", read), F.transform("sections", chapter)]
    return [*steps, F.transform(F.filter("sections", lambda s: s["wide"] | (s["full"] != "") | (s["short"] != "")), operation)]


def cross_reference(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Every statute that each document operates on, from sections and from the title.

    One row a reference: statute, action, action_label, bill_section, scope,
    verb, line_start, line_end, words_added, words_deleted, in_title, in_body.
    A chapter-wide operation gives each section it lists; a section opener
    gives one statute with the lines and words of the segments it overlaps;
    what only the title promises comes last, without a section.

    A document's segments come together once, as for its joined text, and all
    else is done within that row. The segments that a section overlaps are
    neighbours: where they begin and end is counted on sorted arrays, and a
    segment is read again only for sections that it reaches into.
    """
    raw, line = tx.raw_words(F.col("text")), segments.schema["line"].dataType
    of = lambda kind: F.when(F.col("kind") == kind, raw).otherwise(0).cast("long")
    segment = F.struct("seg_ix", tx.normalize(F.col("text")).alias("text"), F.when(F.col("line") != 0, F.col("line")).alias("line"), of("insert").alias("added"), of("delete").alias("deleted"))
    docs = segments.where("text is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(segment)).alias("segs"))
    docs = docs.withColumn("full", F.array_join(F.transform("segs", lambda s: s["text"]), " ")).withColumn("titles", title_refs(F.col("full")))
    docs = docs.withColumn("pieces", F.split("full", rf"(?={SECTION})")).withColumn("lengths", F.transform("pieces", F.length)).withColumn("starts", running(F.col("lengths")))
    for step in operations("full", "pieces", "starts"):
        docs = docs.withColumn("sections", step)
    docs = docs.select(*keys, "titles", "sections", F.transform("segs", lambda s: s.dropFields("seg_ix", "text")).alias("segs"), F.transform("segs", lambda s: F.length(s["text"]) + 1).alias("lengths"))
    docs = docs.withColumn("seg_starts", running(F.col("lengths"))).drop("lengths")

    # A segment is met if it ends after a section's start and starts before its end; it ends one before the next one starts.
    numbered = F.filter(F.zip_with("segs", "seg_starts", lambda s, at: F.struct(at.alias("at"), s["line"].alias("line"))), lambda s: s["line"].isNotNull())
    def nexts(lines: Column) -> Column:
        at = below(F.transform("sections", lambda s: s["start"]), F.transform(lines, lambda s: s["at"]))
        return F.transform(at, lambda i: F.get(lines, i)["line"])

    next_ = F.when(F.exists("sections", lambda s: s["wide"]), let(numbered, nexts))
    low, high = below(F.transform("sections", lambda s: s["start"] + 2), F.col("seg_starts")), below(F.transform("sections", lambda s: s["end"]), F.col("seg_starts"))
    docs = docs.withColumn("places", F.zip_with(F.zip_with(low, high, lambda a, b: F.struct(a.alias("low"), F.greatest(b - a + 1, F.lit(0)).alias("n"))), F.coalesce(next_, F.array()), lambda p, line: p.withField("next", line)))

    def refs(s: Column) -> Column:
        total = lambda c: F.coalesce(F.aggregate(s["met"], F.lit(0).cast("long"), lambda acc, x: acc + x[c]), F.lit(0).cast("long"))
        lines = F.transform(s["met"], lambda x: x["line"])
        action = F.coalesce(rules.lookup(rules.ACTION_CATEGORY, s["verb"]), F.lit("amend"))
        return F.transform(s["members"], lambda m: F.struct(
            F.regexp_replace(m, r"\.+$", "").alias("statute"), action.alias("action"), s["bill_section"].alias("bill_section"), s["scope"].alias("scope"), s["verb"].alias("verb"),
            F.when(s["wide"], s["next"]).otherwise(F.array_min(lines)).alias("line_start"), F.array_max(lines).alias("line_end"), total("added").alias("words_added"), total("deleted").alias("words_deleted"),
        ))

    met = let(F.col("segs"), lambda segs: F.zip_with("sections", "places", lambda s, p: s.withField("met", F.when(~s["wide"], F.slice(segs, p["low"], p["n"]))).withField("next", p["next"])))
    docs = docs.select(*keys, "titles", F.flatten(F.transform(met, refs)).alias("found"))

    # A title promise stays only where no section has the same action on the statute.
    pair, statute = (lambda r: F.concat(r["action"], F.lit(" "), r["statute"])), (lambda t: F.substring_index(t, " ", -1))
    docs = docs.withColumn("pairs", F.transform("found", pair))
    none = lambda type_: F.lit(None).cast(type_)
    promised = lambda alike: F.transform(F.array_except("titles", "pairs"), lambda t: F.struct(
        statute(t).alias("statute"), F.substring_index(t, " ", 1).alias("action"), none("int").alias("bill_section"), F.lit("").alias("scope"), F.lit("").alias("verb"), none(line).alias("line_start"), none(line).alias("line_end"),
        F.lit(0).cast("long").alias("words_added"), F.lit(0).cast("long").alias("words_deleted"), F.array_contains(alike, statute(t)).alias("in_body"), F.lit(True).alias("in_title"),
    ))
    said = let(F.array_intersect("titles", "pairs"), lambda both: F.transform("found", lambda r: r.withField("in_body", F.lit(True)).withField("in_title", F.array_contains(both, pair(r)))))
    only = let(F.array_intersect(F.transform("titles", statute), F.transform("found", lambda r: r["statute"])), promised)
    rows = docs.select(*keys, F.explode(F.concat(said, only)).alias("r")).select(*keys, "r.*")
    return rows.withColumn("action_label", F.coalesce(rules.lookup(rules.ACTION_LABEL, F.col("action")), F.col("action")))


def in_order(refs: DataFrame, keys: list[str]) -> DataFrame:
    """By document, sections first and by number, title-only references last, then by statute."""
    return refs.orderBy(*keys, F.col("bill_section").asc_nulls_last(), "statute")


def summary(refs: DataFrame) -> DataFrame:
    """refs with summary, such as ``amends s. 1.01 at line 3 (+2 / -1 words)``."""
    where = F.when(F.coalesce("line_start", F.lit(0)) != 0, F.concat(F.lit(" at line "), F.col("line_start").cast("string"))).otherwise("")
    churn = F.when((F.col("words_added") != 0) | (F.col("words_deleted") != 0), F.format_string(" (+%d / -%d words)", "words_added", "words_deleted")).otherwise("")
    return refs.withColumn("summary", F.concat("action_label", F.lit(" s. "), "statute", where, churn))


def statute_index(refs: DataFrame) -> DataFrame:
    """Who touches what: distinct bills and words added and deleted for each statute."""
    return refs.groupBy("statute").agg(F.countDistinct("session", "num").alias("bills"), F.sum(F.coalesce("words_added", F.lit(0))).cast("long").alias("added"), F.sum(F.coalesce("words_deleted", F.lit(0))).cast("long").alias("deleted"))


def touching(refs: DataFrame, bills: DataFrame, statute: str) -> DataFrame:
    """The references of one statute with their bills, enacted first, then by number."""
    rows = refs.where(F.col("statute") == statute).join(bills.select("session", "num", "label", "title", "chapter_law"), ["session", "num"])
    return rows.orderBy(F.col("chapter_law").isNull() | (F.col("chapter_law") == ""), "num")


def statute_pages(refs: DataFrame, bills: DataFrame, track: DataFrame) -> DataFrame:
    """For all statutes at once, each distinct use by a bill with the bill's outcome."""
    uses = refs.where(tx.safe_cite(F.col("statute"))).select("session", "num", "statute", "action", "bill_section").distinct()
    rows = uses.join(bills.select("session", "num", "label", "title"), ["session", "num"]).join(track.select("session", "num", "outcome"), ["session", "num"], "left")
    return rows.withColumn("outcome", F.coalesce("outcome", F.lit("pending")))


def reconciled(found: DataFrame, official: DataFrame) -> DataFrame:
    """For each bill: references found and official, those in both, and the recall, from (session, num, statute) on both sides."""
    keys = ["session", "num", "statute"]
    both = found.select(*keys).distinct().withColumn("f", F.lit(1)).join(official.select(*keys).distinct().withColumn("o", F.lit(1)), keys, "full_outer")
    out = both.groupBy("session", "num").agg(F.count("f").alias("found"), F.count("o").alias("official"), F.count_if(F.col("f").isNotNull() & F.col("o").isNotNull()).alias("agreed"))
    return out.withColumn("false_positives", F.col("found") - F.col("agreed")).withColumn("recall", F.when(F.col("official") > 0, F.col("agreed") / F.col("official"))).withColumn("weak", F.coalesce(F.col("recall") < 0.9, F.lit(False)))


def of_bill(refs: DataFrame, bills: DataFrame, fetched: DataFrame) -> DataFrame:
    """Each bill with its references in order, or why it has none: no text fetched, or nothing found in it. fetched(session, num)."""
    keys = ["session", "num"]
    got = fetched.select(*keys).distinct().withColumn("_got", F.lit(True))
    rows = bills.select(*keys, "label").join(refs, keys, "left").join(got, keys, "left")
    status = F.when(F.col("statute").isNotNull(), "ok").when(F.col("_got"), "no references found").otherwise("text not fetched")
    return rows.withColumn("status", status).drop("_got").orderBy(*keys, F.col("bill_section").asc_nulls_last(), "statute")
