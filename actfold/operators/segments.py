"""Marked-up document versions: segments in order, their lines, context and readings.

Segments are rows (keys, seg_ix, kind, text, line, page); kind is plain, insert
or delete. ``keys`` names the columns that tell documents apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from actfold.functions import text as tx


def ordered(value: Column, at: str = "seg_ix") -> Column:
    """The values of a group in order, as an aggregate; a group is one document's segments."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), value.alias("v")))), lambda x: x["v"])


def joined(value: Column, at: str = "seg_ix") -> Column:
    return F.array_join(ordered(value, at), " ")


def flattened(segments: DataFrame, keys: list[str]) -> DataFrame:
    """One row a document: its normalised text, segments joined by a space."""
    return segments.groupBy(*keys).agg(joined(tx.normalize(F.col("text"))).alias("full"))


def placed(segments: DataFrame, keys: list[str], value: Column | None = None) -> DataFrame:
    """segments with start and end, their offsets in the joined text."""
    w = Window.partitionBy(*keys).orderBy("seg_ix")
    n = F.length(value if value is not None else tx.normalize(F.col("text")))
    return segments.withColumn("end", F.sum(n + 1).over(w) - 1).withColumn("start", F.col("end") - n)


def runs(items: DataFrame, keys: list[str], by: str, at: str, text: str = "text", sep: str = " ") -> DataFrame:
    """Run-length encoding: neighbours of one ``by`` joined, with the run's first and last place."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.when(F.lag(by).over(w).eqNullSafe(F.col(by)), 0).otherwise(1)
    marked = items.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return marked.groupBy(*keys, "run", by).agg(F.array_join(ordered(F.col(text), at), sep).alias(text), F.min(at).alias("first"), F.max(at).alias("last"))


def numbered_lines(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments regrouped to printed lines: a new one wherever a line number differs from the last one's; unnumbered segments stay with the line before."""
    w = Window.partitionBy(*keys).orderBy("seg_ix")
    before = F.last("line", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = segments.withColumn("_first", F.row_number().over(w) == 1).withColumn("_before", before)
    opens = F.col("_first") | (F.col("line").isNotNull() & ~F.col("line").eqNullSafe(F.col("_before")))
    rows = rows.withColumn("line_ix", F.sum(opens.cast("int")).over(w) - 1)
    return rows.groupBy(*keys, "line_ix").agg(F.min_by("line", "seg_ix").alias("line"), F.min_by("page", "seg_ix").alias("page"), F.count("*").alias("parts"), F.max(F.col("kind") != "plain").alias("changed"), joined(F.col("text")).alias("text"))


def context_blocks(segments: DataFrame, keys: list[str], pad: int = 220) -> DataFrame:
    """(keys, block_ix, lo, hi, line, page, changed, passage): changes with the text around them, spans that touch merged.

    A change's span ends at the first segment to each side by which ``pad``
    characters are used up. On the running sums that is a range frame: to the
    right, the last segment that starts less than the pad after the change
    ends; to the left, the first that ends less than the pad before it starts.
    """
    w = Window.partitionBy(*keys).orderBy("seg_ix")
    rows = segments.withColumn("i", F.row_number().over(w) - 1).withColumn("e", F.sum(F.length("text")).over(w).cast("long")).withColumn("c", F.col("e") - F.length("text"))
    # A frame is asked at one sum and filled by the other, so both kinds of points are laid on one line. Both frames only grow: the left one is read backwards.
    asked, filled = F.col("ask") == 1, F.when(F.col("ask") == 0, F.col("i"))
    none = F.lit(None).cast("int")
    right = rows.where("kind != 'plain'").select(*keys, F.col("e").alias("at"), "i", "c", F.lit(1).alias("ask")).union(rows.select(*keys, F.col("c").alias("at"), "i", "c", F.lit(0).alias("ask")))
    hi = F.max(filled).over(Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, pad - 1))
    spans = right.withColumn("hi", hi).where(asked)
    left = spans.select(*keys, F.col("c").alias("at"), "i", "hi", "ask").union(rows.select(*keys, F.col("e").alias("at"), "i", none, F.lit(0)))
    lo = F.min(filled).over(Window.partitionBy(*keys).orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, pad - 1))
    spans = left.withColumn("lo", lo).where(asked).select(*keys, "i", F.greatest("hi", "i").alias("hi"), F.least("lo", "i").alias("lo"))
    so = Window.partitionBy(*keys).orderBy("i")
    spans = spans.withColumn("_past", F.max("hi").over(so.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("block_ix", F.sum(F.when(F.col("_past").isNull() | (F.col("lo") > F.col("_past") + 1), 1).otherwise(0)).over(so) - 1)
    blocks = spans.groupBy(*keys, "block_ix").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # Blocks lie apart, so the last one that opens at or before a segment is the only one that can hold it.
    opens = blocks.select(*keys, F.col("lo").alias("i"), F.lit(0).alias("is_row"), F.struct("block_ix", "lo", "hi").alias("b"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("kind", "text", "line", "page")])
    line = opens.union(rows.select(*keys, "i", F.lit(1), F.lit(None).cast(opens.schema["b"].dataType), "kind", "text", "line", "page"))
    held = line.withColumn("b", F.last("b", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("i", "is_row"))).where("is_row = 1 and i <= b.hi")
    inside = held.select(*keys, "b.*", "i", "kind", "text", "line", "page")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != 0), F.col("i")))
    by = [*keys, "block_ix"]
    facts = inside.groupBy(*by, "lo", "hi").agg(first("line").alias("line"), first("page").alias("page"), F.count_if(F.col("kind") != "plain").alias("changed"))
    return facts.join(rendered(inside, by).hint("merge"), by)


def rendered(parts: DataFrame, keys: list[str], at: str = "i") -> DataFrame:
    """(keys, passage): the parts in order, one pair of markers around each run of additions or deletions."""
    r = runs(parts, keys, "kind", at)
    marked = F.when(F.col("kind") == "insert", F.concat(F.lit("[[+"), "text", F.lit("+]]"))).when(F.col("kind") == "delete", F.concat(F.lit("[[-"), "text", F.lit("-]]"))).otherwise(F.col("text"))
    return r.groupBy(*keys).agg(joined(marked, "run").alias("passage"))


def stats(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments, insertions, deletions, and words of each by both counts: stitched tokens and words between spaces.

    A token that follows one ending in a hyphen goes on with it, also from one
    segment of a kind to the next that has tokens: only the last token of each
    segment is carried along for that.
    """
    hyphen = lambda t: F.endswith(t, F.lit("-"))
    tokens = F.when(F.col("kind") != "plain", tx.tokens(F.col("text")))
    inner = F.size(F.filter(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), hyphen))
    rows = segments.select(*keys, "kind", "seg_ix", tokens.alias("t"), tx.space_words(F.col("text")).alias("spaced"))
    rows = rows.select(*keys, "kind", "seg_ix", "spaced", F.size("t").alias("n"), inner.alias("inner"), F.try_element_at("t", F.lit(-1)).alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy(*keys, "kind").orderBy("seg_ix").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("words", F.col("n") - F.col("inner") - F.when((F.col("n") > 0) & hyphen(before), 1).otherwise(0))
    total = lambda k, c: F.coalesce(F.sum(F.when(F.col("kind") == k, c)), F.lit(0)).cast("long")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("segments"),
        F.count_if(F.col("kind") == "insert").alias("insertions"),
        F.count_if(F.col("kind") == "delete").alias("deletions"),
        total("insert", F.col("words")).alias("words_inserted"),
        total("delete", F.col("words")).alias("words_deleted"),
        total("insert", F.col("spaced")).alias("space_words_added"),
        total("delete", F.col("spaced")).alias("space_words_deleted"),
    )


def readings(segments: DataFrame, keys: list[str]) -> DataFrame:
    """The texts that a faithful quote can come from: as amended, as it stands, as printed; and what is struck."""
    kept = lambda keep: F.array_join(F.filter(ordered(F.when(keep, F.col("text"))), lambda x: x.isNotNull()), " ")
    return segments.groupBy(*keys).agg(
        kept(F.col("kind") != "delete").alias("amended"),
        kept(F.col("kind") != "insert").alias("standing"),
        joined(F.col("text")).alias("printed"),
        kept(F.col("kind") == "delete").alias("deleted"),
    )


def located(segments: DataFrame, quotes: DataFrame, keys: list[str], quote: str = "quote") -> DataFrame:
    """quotes with line: that of the last numbered segment that starts at or before the quote's first 60 characters; null under 12 characters or if not found.

    A document's text meets the distinct beginnings of its quotes once. Where
    they stand is then looked up among the starts of its numbered segments as
    an as-of join: both on one line, the last line number carried along.
    """
    low = F.lower(tx.squeeze(tx.normalize(F.col("text"))))
    rows = placed(segments.withColumn("low", low), keys, F.col("low")).select(*keys, "seg_ix", "low", "start", "line")
    target = F.lower(tx.squeeze(tx.normalize(F.coalesce(F.col(quote), F.lit("")))))
    asked = quotes.withColumn("_t", F.when(F.length(target) >= 12, F.left(target, F.lit(60))))
    heads = asked.where("_t is not null").groupBy(*keys).agg(F.collect_set("_t").alias("heads"))
    whole = rows.groupBy(*keys).agg(joined(F.col("low")).alias("whole"))
    met = heads.join(whole.hint("merge"), keys).select(*keys, F.explode(F.transform("heads", lambda t: F.struct(t.alias("_t"), (F.instr(F.col("whole"), t) - 1).cast("long").alias("at")))).alias("h"))
    found = met.select(*keys, "h._t", "h.at").where("at >= 0")
    points = rows.where("line != 0").select(*keys, F.col("start").alias("at"), F.lit(0).alias("asks"), "seg_ix", "line", F.lit(None).cast("string").alias("_t"))
    points = points.union(found.select(*keys, "at", F.lit(1), F.lit(None).cast(rows.schema["seg_ix"].dataType), F.lit(None).cast(rows.schema["line"].dataType), "_t"))
    last = F.last("line", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("at", "asks", "seg_ix"))
    lines = points.withColumn("_line", last).where("asks = 1").select(*keys, "_t", "_line")
    return asked.join(lines.hint("merge"), [*keys, "_t"], "left").select(*[F.col(c) for c in quotes.columns if c != "line"], F.col("_line").alias("line"))


def marked_words(words: DataFrame, rules: DataFrame) -> DataFrame:
    """words(page, word_ix, x0, x1, top, bottom, ...) with the mark of the thin rule that covers each best.

    A rule belongs to a word when it overlaps it by 45 % of its width and lies
    from 3 above its top to 4 below its bottom; at under 78 % of its height it
    strikes, else it underlines. Of equal coverage the first rule counts. Pages
    and bands of 16 points are the join's keys, so no page is compared whole.
    """
    thin = rules.where((F.abs("height") <= 1.5) & (F.abs("width") >= 2.0)).select("page", "rule_ix", F.col("x0").alias("r0"), F.col("x1").alias("r1"), F.col("top").alias("r_top"), F.floor(F.col("top") / 16).alias("band"))
    body = words.where(F.col("top").between(120.0, 650.0))
    bands = F.sequence(F.floor((F.col("top") - 3) / 16), F.floor((F.col("bottom") + 4) / 16))
    near = body.withColumn("band", F.explode(bands)).join(thin.hint("merge"), ["page", "band"]).where((F.col("r_top") >= F.col("top") - 3) & (F.col("r_top") <= F.col("bottom") + 4))
    cov = (F.least("x1", "r1") - F.greatest("x0", "r0")) / F.greatest(F.col("x1") - F.col("x0"), F.lit(0.01))
    frac = (F.col("r_top") - F.col("top")) / F.greatest(F.col("bottom") - F.col("top"), F.lit(0.01))
    near = near.withColumn("cov", cov).where("cov >= 0.45").withColumn("mark", F.when(frac < 0.78, "delete").otherwise("insert"))
    best = near.groupBy("page", "word_ix").agg(F.max_by("mark", F.struct("cov", -F.col("rule_ix"))).alias("mark"))
    return body.join(best.hint("merge"), ["page", "word_ix"], "left").withColumn("kind", F.coalesce("mark", F.lit("plain"))).drop("mark")


def geometry_segments(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Segments of printed pages: rows of words by rounded height, a leading number in the margin as the line, runs of one mark joined."""
    rows = marked_words(words, rules).withColumn("row", F.bround(F.col("top") / 4) * 4)
    w = Window.partitionBy("page", "row").orderBy("x0", "word_ix")
    rows = rows.withColumn("_n", F.row_number().over(w))
    lead = (F.col("_n") == 1) & (F.col("x0") < 60.0) & F.col("text").rlike("^[0-9]+$")
    rows = rows.withColumn("line", F.max(F.when(lead, F.col("text").cast("int"))).over(Window.partitionBy("page", "row"))).where(~lead)
    out = runs(rows, ["page", "row", "line"], "kind", "_n")
    out = out.where("kind != 'plain' or trim(text) != ''")
    return out.select("page", "row", "line", "kind", "text", F.row_number().over(Window.partitionBy("page").orderBy("row", "run")).alias("seg_ix"))
