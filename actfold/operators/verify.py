"""Claims: quotes checked against every reading, guards, contracts, replies, briefs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from actfold.functions import text as tx
from actfold.scratch import saved

# The guards' patterns.
ACTORS = r"sponsor|author|lawmaker|legislator|republican|democrat|gop|the bill'?s backers?|proponents?|opponents?"
INTENT = rf"(?i)\b(?:{ACTORS})s?\b|(?-i:\b(?:Senator|Representative|Rep\.|Sen\.)\s+[A-Z])|\b(?:real|true|hidden|underlying)\s+(?:motive|intent|intention|purpose|agenda)\b|\b(?:motivated by|pretext|smokescreen)\b"
PROHIBITION = r"(?i)\b(?:may not|shall not|must not|is prohibited|are prohibited|no \w+ may|may no longer)\b"
PERMISSION = r"(?i)\b(?:can|could|is able to|are able to|is allowed to|are allowed to|is permitted to|are permitted to|may)\s+\w+"
NEGATED = r"(?i)\b(?:cannot|can no longer|can't|may not|is not|are not|no longer|not permitted|not allowed|prohibited|barred|prevented|unable)\b"
CEILING = r"(?i)\b(?:may|shall|must|can)\s+not\s+[^.;]{0,48}?(?:exceed|more than|greater than|less than|longer than)\b|\bnot to exceed\b|\bno more than\b|\bnot (?:more|less) than\b"
REPEAL = r"(?i)\b(?:remov\w+|repeal\w+|eliminat\w+|strip\w+|rescind\w+|revok\w+|delet\w+|abolish\w+|lifts?|lifted|lifting|does away with)\b[^.;]{0,70}?\b(?<what>bans?|prohibitions?|protections?|restrictions?|bar|safeguards?|requirements?|mandates?|duty|duties|obligations?)\b"
HEADLINE = 110
CUT_TAIL = r"[-‐-―]\s*[.!?]?$"
SIGNIFICANCE = {"major": 0, "moderate": 1, "technical": 2}


def flags_intent(c: Column) -> Column:
    found = F.regexp_extract(F.coalesce(c, F.lit("")), INTENT, 0)
    return F.when(found != "", found)


def flags_inverted(consequence: Column, quote: Column) -> Column:
    q, c = F.coalesce(quote, F.lit("")), F.coalesce(consequence, F.lit(""))
    found = F.regexp_extract(c, PERMISSION, 0)
    return F.when(q.rlike(PROHIBITION) & ~q.rlike(CEILING) & ~c.rlike(NEGATED) & (found != ""), F.concat(F.lit("reads a prohibition as permission ('"), found, F.lit("')")))


def flags_false_repeal(text: Column, deleted: Column) -> Column:
    found = tx.squeeze(F.regexp_extract(F.coalesce(text, F.lit("")), REPEAL, 0))
    return F.when(~F.coalesce(deleted, F.lit("")).rlike("[A-Za-z]{2,}") & (found != ""), F.concat(F.lit("claims a repeal ('"), found, F.lit("') but the bill strikes no words at all")))


def flags_cut_headline(line: Column) -> Column:
    text = F.regexp_replace(F.coalesce(line, F.lit("")), r"(?U)\s+$", "")
    ended = text.rlike(r"[.!?]$") & ~text.rlike(CUT_TAIL)
    return F.when((F.length(text) >= HEADLINE - 2) & ~ended, F.concat(F.lit(f"headline cut at the {HEADLINE}-character limit ('"), F.substring(text, -24, 24), F.lit("')")))


def retry_note(reason: Column, notes: list[tuple[str, str]], otherwise: str) -> Column:
    """The note of the first key that the reason contains."""
    out = reduce(lambda acc, kv: acc.when(F.contains(reason, F.lit(kv[0])), kv[1]), notes, F.when(F.lit(False), ""))
    return out.otherwise(otherwise)


def checked(claims: DataFrame, readings: DataFrame, keys: list[str], least_words: int = 3) -> DataFrame:
    """claims with quote_status, drop_reason and the canonical quote where it holds.

    A quote is exact in any reading of its document after canonical spelling,
    loose if only its letters and digits are; too short or empty it fails.
    """
    texts = readings.select(*keys, *[tx.canonical(F.col(c)).alias(f"_{c}") for c in ("amended", "standing", "printed")], *[tx.loose_key(F.col(c)).alias(f"_l{c}") for c in ("amended", "standing", "printed")])
    rows = claims.join(texts.hint("merge"), keys, "left").withColumn("_q", tx.canonical(F.col("quote"))).withColumn("_l", tx.loose_key(F.col("quote")))
    among = lambda q, cols: reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.col(c), F.col(q)), F.lit(False)) for c in cols])
    exact = among("_q", ("_amended", "_standing", "_printed"))
    loose = (F.col("_l") != "") & among("_l", ("_lamended", "_lstanding", "_lprinted"))
    short = F.size(F.split("_q", " ")) < least_words
    reason = F.when(F.col("_q") == "", "empty quote").when(short, "too short to identify a passage").when(~exact & ~loose, "not found in the bill text")
    rows = rows.withColumn("drop_reason", reason).withColumn("quote_status", F.when(F.col("drop_reason").isNotNull(), "failed").when(exact, "exact").otherwise("loose"))
    return rows.withColumn("quote", F.when(F.col("drop_reason").isNull(), F.col("_q")).otherwise(F.col("quote"))).drop(*[c for c in rows.columns if c in ("_q", "_l") or c.startswith(("_amended", "_standing", "_printed", "_lamended", "_lstanding", "_lprinted"))])


def key_bits(keys: DataFrame, n: int) -> Column:
    """A Bloom filter of a table's long ``key``, of which there are about n, as a scalar: an array of longs, at most 8 MB."""
    bits = min(1 << 26, max(1 << 16, 1 << (16 * n).bit_length()))
    at = keys.select(F.explode(_places(F.col("key"), F.lit(bits))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(_bit(F.col("at"))).alias("word"))
    whole = keys.sparkSession.range(bits >> 6).join(words.hint("merge"), "id", "left")
    listed = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("w")))), lambda x: x["w"]).alias("bits"))
    return saved(listed, "bits").scalar()


def _places(key: Column, bits: Column) -> Column:
    """Two places of a key."""
    return F.array(F.pmod(key, bits), F.pmod(F.shiftrightunsigned(key, 31), bits))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))


def may_have(key: Column, filter_: Column) -> Column:
    """Whether a key may be among those of a filter: true for all that are, and for few others while the filter isn't full."""
    places = _places(key, F.size(filter_).cast("long") * 64)
    held = lambda at: F.get(filter_, F.shiftright(at, 6).cast("int")).bitwiseAND(_bit(at)) != 0
    return held(places[0]) & held(places[1])


def contained(quotes: DataFrame, documents: DataFrame, quote_id: str, doc_id: str, shingle: int = 8) -> DataFrame:
    """(quote_id, doc_id) of every document that contains a quote, none named: candidates share the quote's rarest run of words, then are checked in full.

    Both texts are in canonical spelling. A quote inside a document may begin
    or end inside a word, so its runs of words leave out the first and last.
    Quotes with fewer than three words have no run and find nothing. Documents
    are read once for their runs; runs that no quote has are dropped there, by
    a Bloom filter of the quotes' runs, so what is shuffled follows the hits.
    Beyond some millions of runs the filter fills up and drops fewer; the join
    that follows is exact at every size.
    """
    words = lambda c: F.split(F.lower(c), " ")
    grams = lambda w, n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))
    q = quotes.select(F.col(quote_id), tx.canonical(F.col("text")).alias("quote")).where("quote != ''").withColumn("w", words(F.col("quote"))).withColumn("inner", F.slice("w", 2, F.size("w") - 2)).where("size(inner) > 0")
    q = q.withColumn("n", F.least(F.size("inner"), F.lit(shingle)))
    d = documents.select(F.col(doc_id), tx.canonical(F.col("text")).alias("whole"))
    runs = saved(q.select(quote_id, F.explode(F.array_distinct(grams(F.col("inner"), F.col("n")))).alias("key")), "runs")
    sizes = q.agg(F.collect_set("n")).first()[0]  # at most ``shingle`` sizes
    w = F.col("w")
    every = F.flatten(F.array(F.array().cast("array<bigint>"), *[F.when(F.size(w) >= n, grams(w, n)).otherwise(F.array().cast("array<bigint>")) for n in sorted(sizes)]))
    keys = runs.select("key").distinct()
    found = d.select(doc_id, words(F.col("whole")).alias("w")).select(doc_id, F.explode(F.array_distinct(every)).alias("key"))
    found = saved(found.where(may_have(F.col("key"), key_bits(keys, runs.count()))).join(keys.hint("merge"), "key", "left_semi"), "hits")
    rarity = runs.join(found.groupBy("key").agg(F.count("*").alias("docs")).hint("merge"), "key", "left")
    rarest = rarity.groupBy(quote_id).agg(F.min_by("key", F.struct(F.coalesce("docs", F.lit(0)), "key")).alias("key"))
    pairs = found.join(rarest.hint("merge"), "key").select(quote_id, doc_id).distinct()
    full = pairs.join(q.select(quote_id, "quote").hint("merge"), quote_id).join(d.hint("merge"), doc_id)
    return full.where(F.contains("whole", F.col("quote"))).select(quote_id, doc_id)


def guarded(claims: DataFrame) -> DataFrame:
    """claims with flagged_for: why a consequence is withheld although its quote holds."""
    return claims.withColumn("flagged_for", F.coalesce(flags_intent(F.col("consequence")), flags_inverted(F.col("consequence"), F.col("quote"))))


def claim_stats(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Kept, dropped and flagged claims of a document and the rate verified; flagged ones are outside the rate."""
    dropped, flagged = F.col("quote_status") == "failed", F.col("flagged_for").isNotNull()
    out = claims.groupBy(*keys).agg(F.count_if(~dropped & ~flagged).alias("kept"), F.count_if(dropped).alias("dropped"), F.count_if(~dropped & flagged).alias("flagged"))
    total = F.col("kept") + F.col("dropped")
    return out.withColumn("verify_rate", F.when(total > 0, F.bround(1 - F.col("dropped").cast("double") / total, 3)))


def reverified(claims: DataFrame, readings: DataFrame, keys: list[str]) -> DataFrame:
    """Dropped and flagged claims under today's rules, with restored: whether each may come back."""
    again = guarded(checked(claims.where("quote_status = 'failed' or flagged_for is not null").drop("quote_status", "drop_reason", "flagged_for"), readings, keys))
    return again.withColumn("restored", (F.col("quote_status") != "failed") & F.col("flagged_for").isNull())


def reinstated(claims: DataFrame, readings: DataFrame, keys: list[str]) -> DataFrame:
    """All claims after reverified(): those that were kept as they are, and the others under today's rules, with restored.

    A restored claim has its new status and canonical quote and counts as kept
    in claim_stats(); one that fails again keeps the reason it fails for now.
    """
    kept = claims.where("quote_status != 'failed' and flagged_for is null").withColumn("restored", F.lit(False))
    return kept.unionByName(reverified(claims, readings, keys).select(*kept.columns))


def deduped(claims: DataFrame, keys: list[str], order: list[str], field: str = "quote") -> DataFrame:
    """Each first claim of its document by the first 120 letters and digits of a field; claims without any are all kept."""
    key = F.left(F.regexp_replace(F.lower(F.coalesce(field, F.lit(""))), "[^a-z0-9]+", ""), F.lit(120))
    rows = claims.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_key").orderBy(*order)))
    return rows.where("_n = 1 or _key = ''").drop("_key", "_n")


def most_significant(claims: DataFrame, keys: list[str], order: list[str], cap: int = 8) -> DataFrame:
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SIGNIFICANCE.items() for x in kv]), F.col("significance")), F.lit(3))
    w = Window.partitionBy(*keys).orderBy(rank, *order)
    return claims.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def merged_parts(claims: DataFrame, keys: list[str], pass_caps: dict[str, int]) -> DataFrame:
    """Claims of a bill read in parts (keys, pass, part, ord, quote, significance, quote_status, flagged_for) as one list a pass.

    Kept claims only, each passage once, provisions by significance and then in
    the order read, cut to what a single reply could have held.
    """
    kept = claims.where("quote_status != 'failed' and flagged_for is null")
    out = [most_significant(deduped(kept.where(F.col("pass") == name), keys, ["part", "ord"]), keys, ["part", "ord"], cap) for name, cap in pass_caps.items()]
    return reduce(DataFrame.unionByName, out)


# Lengths and enumerations that model replies must keep to.
CONTRACT = {
    "heading": (8, 120, None),
    "effect": (60, 500, None),
    "quote": (25, 180, None),
    "statute": (0, 80, None),
    "significance": (0, None, ["major", "moderate", "technical"]),
    "consequence": (60, 700, None),
    "certainty": (0, None, ["follows_directly", "plausible", "speculative"]),
    "one_line": (20, HEADLINE, None),
    "reading": (150, 2200, None),
}


def violations(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rows with violations: for each field, what of the contract it breaks."""
    found = []
    for f in fields:
        low, high, enum = CONTRACT[f]
        c = F.col(f)
        found.append(F.when(c.isNull(), f"{f}: missing"))
        found.append(F.when(F.length(c) < low, f"{f}: shorter than {low}"))
        if high:
            found.append(F.when(F.length(c) > high, f"{f}: longer than {high}"))
        if enum:
            found.append(F.when(~c.isin(enum), f"{f}: not among its values"))
    return rows.withColumn("violations", F.filter(F.array(*found), lambda x: x.isNotNull()))


def accepted(replies: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pass, attempt, text) of the first reply of each pass that can be used, and (failures) why others could not.

    replies(keys, pass, attempt, text); deleted(keys, deleted) is what each
    document strikes. A reply fails if degenerate, if it is no JSON object, and
    in the summary pass if it claims a repeal that strikes nothing or has a cut
    headline.
    """
    parsed = F.from_json("text", "one_line string, summary array<string>")
    prose = F.concat_ws(" ", "p.one_line", "p.summary")
    rows = replies.join(deleted, keys, "left").withColumn("p", parsed)
    bad_json = F.when(F.get_json_object("text", "$").isNull(), "unparseable JSON")
    summary = F.when(F.col("pass") == "summary", F.coalesce(flags_false_repeal(prose, F.col("deleted")), flags_cut_headline(F.col("p.one_line"))))
    rows = rows.withColumn("why", F.coalesce(tx.degenerate(F.col("text")), bad_json, summary))
    ok = F.col("why").isNull()
    out = rows.groupBy(*keys, "pass").agg(F.min(F.when(ok, F.col("attempt"))).alias("attempt"), F.min_by("text", F.when(ok, F.col("attempt"))).alias("text"), F.array_sort(F.collect_list(F.when(~ok, F.struct("attempt", "why")))).alias("failed"))
    return out.withColumn("failures", F.filter("failed", lambda f: F.col("attempt").isNull() | (f["attempt"] < F.col("attempt")))).drop("failed")


def call_stats(calls: DataFrame) -> DataFrame:
    """Calls, cache hits (over half of the prompt), tokens and seconds by pass."""
    hit = F.col("cached_tokens") > 0.5 * F.col("prompt_tokens")
    return calls.groupBy("pass").agg(F.count("*").alias("calls"), F.count_if(hit).alias("cache_hits"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("seconds").alias("seconds"))


def within_budget(blocks: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Blocks kept under a budget of characters: the most changed first, one that does not fit is skipped unless none is kept yet.

    blocks(keys, block_ix, changed, passage, ...). Skipping has no window form,
    so each document's blocks, without their texts, are folded in one array.
    """
    sizes = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("changed")).alias("c"), "block_ix", F.length("passage").alias("n")))).alias("a"))
    init = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("keep"))

    def step(acc: Column, b: Column) -> Column:
        fits = (acc["used"] + b["n"] <= budget) | (F.size(acc["keep"]) == 0)
        return F.when(fits, F.struct((acc["used"] + b["n"]).alias("used"), F.concat(acc["keep"], F.array(b["block_ix"].cast("long"))).alias("keep"))).otherwise(acc)

    kept = sizes.select(*keys, F.explode(F.aggregate("a", init, step)["keep"]).alias("block_ix"))
    return blocks.join(kept.hint("merge"), [*keys, "block_ix"], "left_semi")


def parted(blocks: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """blocks with part and parts: filled in order up to the budget; a block over it is a part of its own.

    Where a part that begins at a block ends is found on running sums: before
    the first later block that ends over the budget, and not while nothing is
    in it yet. Both are counts in frames that only grow. The parts are what
    these jumps reach from the first block: each round doubles the jump and
    with it the parts that are reached, so it takes as many rounds as the
    number of parts has binary digits. Documents within the budget take none.
    """
    w = Window.partitionBy(*keys).orderBy("block_ix")
    rows = saved(blocks.withColumn("block_ix", F.col("block_ix").cast("long")), "blocks").withColumn("_to", F.sum(F.length("passage")).over(w).cast("long"))
    slim = rows.select(*keys, "block_ix", (F.row_number().over(w) - 1).cast("long").alias("k"), (F.col("_to") - F.length("passage")).alias("c"), F.col("_to").alias("e"))
    every = Window.partitionBy(*keys)
    slim = saved(slim.withColumn("size", F.max("e").over(every)).withColumn("n", F.count("*").over(every)), "sums")
    long = slim.where(F.col("size") > budget)
    line = long.select(*keys, "k", "n", F.col("c").alias("at"), "c", F.lit(1).alias("ask")).union(long.select(*keys, "k", "n", F.col("e").alias("at"), "c", F.lit(0)))
    fits = F.count_if(F.col("ask") == 0).over(Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, budget))
    over = line.withColumn("fits", fits).where("ask = 1")
    begun = F.count("*").over(Window.partitionBy(*keys).orderBy("c").rangeBetween(Window.unboundedPreceding, 0))  # blocks that begin where this one does, or before
    jumps = saved(over.withColumn("to", F.greatest("fits", begun)).where("to < n").select(*keys, "k", "to"), "jumps")
    reached = saved(long.where("k = 0").select(*keys, "k", F.lit(1).cast("long").alias("part")), "reached")
    step = 1
    while not jumps.isEmpty():
        further = reached.join(jumps.hint("merge"), [*keys, "k"]).select(*keys, F.col("to").alias("k"), (F.col("part") + step).alias("part"))
        more = saved(further, "further")
        if more.isEmpty():
            break
        reached, step = saved(reached.union(more), "reached"), 2 * step
        next_ = jumps.select(*keys, F.col("k").alias("to"), F.col("to").alias("end"))
        jumps = saved(jumps.join(next_.hint("merge"), [*keys, "to"]).select(*keys, "k", F.col("end").alias("to")), "jumps")
    starts = slim.join(reached.hint("merge"), [*keys, "k"], "left").select(*keys, "block_ix", F.when(F.col("k") == 0, 1).otherwise(F.col("part")).alias("part"))
    dealt = starts.withColumn("part", F.max("part").over(w).cast("int"))
    return rows.drop("_to").join(dealt.hint("merge"), [*keys, "block_ix"]).withColumn("parts", F.max("part").over(every))


def headers(bills: DataFrame, refs: DataFrame, shown: int = 60) -> DataFrame:
    """(session, num, header): a bill's identity and up to 60 of its references, as text."""
    keys = ["session", "num"]
    w = Window.partitionBy(*keys).orderBy(F.col("bill_section").asc_nulls_last(), "statute", "action")
    r = refs.withColumn("_n", F.row_number().over(w)).withColumn("_of", F.count("*").over(Window.partitionBy(*keys)))
    churn = F.when((F.col("words_added") != 0) | (F.col("words_deleted") != 0), F.format_string(", +%d/-%d words", "words_added", "words_deleted")).otherwise("")
    scope = F.when(tx.truthy(F.col("scope")), F.concat(F.lit(" ["), "scope", F.lit("]"))).otherwise("")
    where = F.when(F.coalesce("line_start", F.lit(0)) != 0, F.concat(F.lit("line "), F.col("line_start").cast("string"))).otherwise("title only")
    text = F.concat(F.lit("  section "), F.coalesce(F.when(F.col("bill_section") != 0, F.col("bill_section").cast("string")), F.lit("-")), F.lit(": "), "action", F.lit("s s. "), "statute", F.lit(" at "), where, churn, scope)
    listed = r.where(F.col("_n") <= shown).withColumn("_text", text).groupBy(*keys).agg(F.max("_of").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_text"))), lambda x: x["_text"]), "\n").alias("list"))
    more = F.when(F.col("n") > shown, F.format_string("  ... and %d more", F.col("n") - shown))
    line = lambda label, c: F.when(tx.truthy(F.col(c)), F.concat(F.lit(label), c))
    refs_text = F.when(F.col("n").isNotNull(), F.concat_ws("\n", F.format_string("\nSTATUTES THIS BILL OPERATES ON (%d):", "n"), "list", more))
    if "long_title" not in bills.columns:
        bills = bills.withColumn("long_title", F.lit(None).cast("string"))
    head = F.concat_ws("\n", F.concat(F.lit("BILL: "), F.coalesce("label", F.lit("")), F.lit(" — "), F.coalesce("title", F.lit(""))), line("CHAMBER: ", "chamber"), line("SPONSOR: ", "sponsor"), line("EFFECTIVE: ", "effective_date"), line("\nOFFICIAL SUMMARY (written by the Legislature):\n", "long_title"), refs_text)
    return bills.join(listed.hint("merge"), keys, "left").select(*keys, head.alias("header"))


def briefs(header: DataFrame, blocks: DataFrame, totals: DataFrame | None = None, budget: int = 24_000) -> DataFrame:
    """(session, num, text, passages, total_passages, truncated): a bill's header and the passages kept under the budget, in order.

    totals(session, num, space_words_added, space_words_deleted), as of
    segments.stats(), lets the text state the balance of the whole bill.
    """
    keys = ["session", "num"]
    blocks = saved(blocks, "blocks")  # read three times
    kept = within_budget(blocks, keys, budget)
    at = F.when(F.coalesce("line", F.lit(0)) != 0, F.concat(F.lit("line "), F.col("line").cast("string"))).otherwise("—")
    body = kept.withColumn("_p", F.concat(F.lit("\n["), at, F.lit("] "), "passage")).groupBy(*keys).agg(F.count("*").alias("passages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "_p"))), lambda x: x["_p"]), "\n").alias("body"))
    total = blocks.groupBy(*keys).agg(F.count("*").alias("total_passages"))
    out = header.join(body.hint("merge"), keys, "left").join(total.hint("merge"), keys, "left").withColumns({"passages": F.coalesce("passages", F.lit(0)), "total_passages": F.coalesce("total_passages", F.lit(0))})
    balance = F.lit("")
    if totals is not None:
        out = out.join(totals.select(*keys, "space_words_added", "space_words_deleted").hint("merge"), keys, "left")
        balance = F.coalesce(F.format_string(" In total this bill adds %s words and deletes %s.", F.format_number("space_words_added", 0), F.format_number("space_words_deleted", 0)), F.lit(""))
    title = F.when(F.col("passages") > 0, F.concat(F.format_string("\nCHANGED LANGUAGE (%d of %d passages).", "passages", "total_passages"), balance)).otherwise("\nCHANGED LANGUAGE: none marked")
    return out.select(*keys, F.concat_ws("\n", "header", title, "body").alias("text"), "passages", "total_passages", (F.col("passages") < F.col("total_passages")).alias("truncated"))


def brief_parts(header: DataFrame, blocks: DataFrame, budget: int = 24_000) -> DataFrame:
    """One row a part of a bill too long for one brief, each with the bill's header."""
    keys = ["session", "num"]
    rows = parted(blocks, keys, budget)
    at = F.when(F.coalesce("line", F.lit(0)) != 0, F.concat(F.lit("line "), F.col("line").cast("string"))).otherwise("—")
    body = rows.withColumn("_p", F.concat(F.lit("\n["), at, F.lit("] "), "passage")).groupBy(*keys, "part", "parts").agg(F.count("*").alias("passages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "_p"))), lambda x: x["_p"]), "\n").alias("body"))
    return body.join(header.hint("merge"), keys).select(*keys, "part", "parts", "passages", F.concat_ws("\n", "header", F.format_string("\nCHANGED LANGUAGE — PART %d OF %d", "part", "parts"), "body").alias("text"))


def provision_digest(header: DataFrame, provisions: DataFrame) -> DataFrame:
    """(session, num, text): a bill's header and its verified provisions in order, to summarise from."""
    keys = ["session", "num"]
    w = Window.partitionBy(*keys).orderBy("ord")
    cite = F.when(tx.truthy(F.col("statute")), F.concat(F.lit(" (s. "), "statute", F.lit(")"))).otherwise("")
    item = F.concat_ws("\n", F.concat(F.lit("\n"), F.col("_n").cast("string"), F.lit(". ["), F.coalesce("significance", F.lit("")), F.lit("] "), F.coalesce("heading", F.lit("")), cite), F.concat(F.lit("   "), F.coalesce("effect", F.lit(""))), F.when(tx.truthy(F.col("quote")), F.concat(F.lit('   "'), "quote", F.lit('"'))))
    rows = provisions.withColumn("_n", F.row_number().over(w)).withColumn("_item", item).groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_item"))), lambda x: x["_item"]), "\n").alias("body"))
    return header.join(rows.hint("merge"), keys).select(*keys, F.concat_ws("\n", "header", F.format_string("\nWHAT THIS BILL DOES — %d provisions", "n"), "body").alias("text"))


def requests(briefs_: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """One row for each brief and pass of a batch: pass, order, text and token budget."""
    passes = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(p).alias("pass"), F.lit(b).alias("budget")) for k, (p, b) in enumerate(budgets.items())])
    return briefs_.withColumn("p", F.explode(passes)).select("*", "p.*").drop("p")


