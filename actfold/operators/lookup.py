"""Lookups, work lists and preferences over the relational record."""

from __future__ import annotations

import sys
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from actfold.functions import rules
from actfold.functions import text as tx

BILL = ["session", "num"]


def activity(bills: DataFrame, texts: DataFrame, analyses: DataFrame, votes: DataFrame) -> DataFrame:
    """(session, num, activity): versions, analyses and votes of each bill, each table counted before it is joined."""
    count = lambda df, name: df.groupBy(*BILL).agg(F.count("*").alias(name))
    out = reduce(lambda a, b: a.join(b, BILL, "left"), [bills.select(*BILL), count(texts, "t"), count(analyses, "a"), count(votes, "v")])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*BILL, (zero("t") + zero("a") + zero("v")).alias("activity"))


def ranked(activities: DataFrame) -> DataFrame:
    """By session, the busiest bills first, then by number.

    Rows are numbered within an activity and a range of 65,536 numbers, from
    the count of all rows before it, so no task sorts a whole session. Null numbers come first.
    """
    rows, by = activities.withColumn("_range", F.coalesce(F.floor(F.col("num") / 65536), F.lit(-(1 << 48)))), ["session", "activity", "_range"]
    before = Window.partitionBy("session").orderBy(F.desc("activity"), "_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n")).select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("num"))).join(counts.hint("merge"), by)
    return placed.select(*activities.columns, (F.col("_before") + F.col("_at")).cast("int").alias("place"))


def live_first(bills: DataFrame) -> DataFrame:
    return bills.withColumn("dead", rules.is_dead(F.col("last_action"))).orderBy("dead", "num")


def html_preferred(texts: DataFrame) -> DataFrame:
    """HTML texts, and others only where their version has none in HTML: whether it has is counted by version, not asked row by row."""
    has = F.max(F.col("fmt") == "HTML").over(Window.partitionBy(*BILL, "version"))
    return texts.withColumn("_html", has).where((F.col("fmt") == "HTML") | ~F.col("_html")).drop("_html")


def one_per_version(texts: DataFrame) -> DataFrame:
    """One row a version, HTML if there is one, else the first."""
    best = Window.partitionBy(*BILL, "version").orderBy(F.desc(F.col("fmt") == "HTML"), "text_seq")
    return texts.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def latest_version(texts: DataFrame) -> DataFrame:
    """The version read last of each bill, HTML if it has one."""
    rows = texts.withColumn("_last", F.max_by("version", "text_seq").over(Window.partitionBy(*BILL))).where(F.col("version").eqNullSafe(F.col("_last")))
    best = Window.partitionBy(*BILL).orderBy(F.desc(F.col("fmt") == "HTML"), F.desc("text_seq"))
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_last")


def undone(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def enacted(bills: DataFrame) -> DataFrame:
    return bills.where(tx.truthy(F.col("chapter_law")))


def enacted_in_order(bills: DataFrame) -> DataFrame:
    """Enacted bills by number; a range sort, so no task holds them all."""
    return enacted(bills).orderBy("session", "num")


def distinct_lists(columns: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(list, value): the distinct values, neither null nor empty, of a column of each named table."""
    parts = [df.select(F.lit(name).alias("list"), F.col(c).cast("string").alias("value")) for name, (df, c) in columns.items()]
    return reduce(DataFrame.union, parts).where(tx.truthy(F.col("value"))).distinct()


def restricted(rows: DataFrame, to: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(to.select(*keys).distinct(), keys, "left_semi")


def with_member(bills: DataFrame, members: DataFrame) -> DataFrame:
    """bills with the name and party of the member at their sponsor's address."""
    who = members.select(F.col("url").alias("sponsor_url"), F.col("name").alias("member"), "party")
    return bills.join(who, "sponsor_url", "left")


def statute_links(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """claims with statute tidied and link: its base citation if that statute has a page, else empty."""
    pages = refs.select(F.col("statute").alias("_base")).distinct().withColumn("_page", F.lit(True))
    rows = claims.withColumn("statute", tx.tidy_statute(F.col("statute"))).withColumn("_base", tx.base_cite(F.col("statute")))
    return rows.join(pages.hint("merge"), "_base", "left").withColumn("link", F.when(F.col("_page"), F.col("_base")).otherwise("")).drop("_base", "_page")


def keep_first(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def work_list(texts: DataFrame, analyses: DataFrame, votes: DataFrame, amendments: DataFrame) -> DataFrame:
    """(kind, url, session, num): every document to fetch, each address once, with the first kind that names it."""
    parts = [(0, "text", html_preferred(texts)), (1, "analysis", analyses), (2, "vote", votes), (3, "amendment", amendments)]
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("kind_ord"), F.lit(name).alias("kind"), "url", *BILL) for k, name, df in parts])
    return keep_first(rows.where(tx.truthy(F.col("url"))), ["url"], ["kind_ord", *BILL]).drop("kind_ord")


def ordered_work(work: DataFrame, places: DataFrame) -> DataFrame:
    """The work list with each document's place: that of its bill's activity, those without one last."""
    rows = work.withColumn("num", tx.bill_number_of_url(F.col("url"))).join(places.select(*BILL, "place"), BILL, "left")
    return rows.withColumn("place", F.coalesce("place", F.lit(1 << 30))).orderBy("place", "url")


def completeness(listed: DataFrame) -> DataFrame:
    """(session, reported, found, missing, complete) of listing pages (session, num, total); rows without a number do not count."""
    out = listed.groupBy("session").agg(F.max("total").alias("reported"), F.countDistinct("num").alias("found"))
    return out.withColumn("missing", F.col("reported") - F.col("found")).withColumn("complete", F.col("missing") == 0)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()])


def fetch_status(fetches: DataFrame) -> DataFrame:
    """Fetches that worked and failed, and the bytes kept."""
    ok = F.col("status").between(200, 299)
    return fetches.agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.sum(F.when(ok, F.col("nbytes"))).alias("bytes"))


def confusion(track: DataFrame, bills: DataFrame) -> DataFrame:
    """Outcomes told from history alone against the record of chapter laws."""
    rows = track.select(*BILL, "outcome").join(bills.select(*BILL, tx.truthy(F.col("chapter_law")).alias("enacted")), BILL)
    return rows.groupBy("enacted", "outcome").agg(F.count("*").alias("n"))


def companions(related: DataFrame, words: DataFrame) -> DataFrame:
    """For related pairs (session, num, other): shared words of both, counted with repeats, over the words of both."""
    mine = words.groupBy(*BILL, "word").agg(F.count("*").alias("n"))
    a = mine.select("session", "num", "word", F.col("n").alias("na"))
    b = mine.select("session", F.col("num").alias("other"), "word", F.col("n").alias("nb"))
    total = words.groupBy(*BILL).agg(F.count("*").alias("total"))
    both = related.select("session", "num", "other").distinct().join(a, BILL).join(b, ["session", "other", "word"]).groupBy("session", "num", "other").agg(F.sum(F.least("na", "nb")).alias("shared"))
    out = related.select("session", "num", "other").distinct().join(both, ["session", "num", "other"], "left")
    out = out.join(total, BILL).join(total.select("session", F.col("num").alias("other"), F.col("total").alias("other_total")), ["session", "other"])
    return out.withColumn("ratio", 2 * F.coalesce("shared", F.lit(0)) / (F.col("total") + F.col("other_total")))


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """Items in the matching blocks of two sequences of numbers from 0: what SequenceMatcher(None, a, b, autojunk=False) finds.

    Short ranges go to SequenceMatcher. In longer ones the longest block is
    found by halving its length: runs of every power of two have numbers
    (prefix doubling), and two of them name a run of any length, so a range
    costs about its length, however often its words repeat.
    """
    named, n = [np.concatenate((a, [-1], b)).astype(np.int64)], len(a)
    while 2 << (len(named) - 1) <= min(n, len(b)):
        last, step = named[-1], 1 << (len(named) - 1)
        named.append(np.unique(last[:-step] * (len(last) + 1) + last[step:], return_inverse=True)[1])

    def runs(lo: int, hi: int, size: int) -> np.ndarray:
        k = size.bit_length() - 1
        x = named[k]
        return x[lo : hi - size + 1] * (len(x) + 1) + x[lo + size - (1 << k) : hi + 1 - (1 << k)]

    total, todo = 0, [(0, n, n + 1, n + 1 + len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if (a1 - a0) * (b1 - b0) <= 40_000:
            if a1 > a0 and b1 > b0:
                total += sum(m.size for m in SequenceMatcher(None, named[0][a0:a1].tolist(), named[0][b0:b1].tolist(), autojunk=False).get_matching_blocks())
            continue
        size, over = 0, min(a1 - a0, b1 - b0) + 1
        while over - size > 1:
            mid = (size + over) // 2
            size, over = (mid, over) if np.isin(runs(a0, a1, mid), runs(b0, b1, mid)).any() else (size, mid)
        if size:
            x, y = runs(a0, a1, size), runs(b0, b1, size)
            i = int(np.isin(x, y).argmax())
            j = int((y == x[i]).argmax())
            total += size
            todo += [(a0, a0 + i, b0, b0 + j), (a0 + i + size, a1, b0 + j + size, b1)]
    return total


def agreement(left: list, right: list, matcher: SequenceMatcher | None = None) -> float:
    """2 x matching blocks over both lengths; ``matcher``, if given, has ``right`` as its second sequence."""
    if len(left) * len(right) <= 1_000_000:
        matcher = matcher or SequenceMatcher(None, b=right, autojunk=False)
        matcher.set_seq1(left)
        return matcher.ratio()
    at: dict = {}
    a, b = (np.array([at.setdefault(w, len(at)) for w in x], np.int64) for x in (left, right))
    return 2 * matched(a, b) / (len(a) + len(b))


def sequence_ratio(pairs: DataFrame, left: str = "left_words", right: str = "right_words") -> DataFrame:
    """pairs with ratio: agreement of two word sequences, 2 x matching blocks over both lengths, on the candidate pairs only."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([agreement(list(x), list(y)) for x, y in zip(a, b, strict=True)])

    return pairs.withColumn("ratio", ratio(left, right))


def longest(a: str, b: str, a0: int, a1: int, b0: int, b1: int, most: int) -> tuple[int, int, int, bool] | None:
    """Start in a, start in b and size of the longest block that a[a0:a1] and b[b0:b1] share, the first in a and then in b, and whether others are as long; None after ``most`` searches.

    Only what is longer than the best so far, or as long while it is the only
    one, is looked for. Where a window of a is not in b, neither is the
    shortest end of it that is not in b, so the next window begins behind that
    end's first place.
    """
    i, x, y, size, tied = a0, a0, b0, 0, True
    while i + (n := size + tied) <= a1:
        most -= 1
        if most < 0:
            return None
        j = b.find(a[i : i + n], b0, b1)
        if j >= 0:
            while True:
                step = 1
                while i + n + step <= a1 and j + n + step <= b1 and a[i + n : i + n + step] == b[j + n : j + n + step]:
                    n, step = n + step, 2 * step
                while step := step // 2:
                    if i + n + step <= a1 and j + n + step <= b1 and a[i + n : i + n + step] == b[j + n : j + n + step]:
                        n += step
                most -= 1
                k = b.find(a[i : i + n + 1], j + 1, b1) if i + n < a1 else -1
                if most < 0:
                    return None
                if k < 0:
                    break
                j, n = k, n + 1
            if n == size:
                tied = True
            else:
                x, y, size, tied, most = i, j, n, b.find(a[i : i + n], j + 1, b1) >= 0, most - 1
            i += 1
            continue
        known, gone = 0, 1  # ends of these lengths are in b, and are not
        while gone < n and b.find(a[i + n - gone : i + n], b0, b1) >= 0:
            known, gone, most = gone, 2 * gone, most - 1
        gone = min(gone, n)
        while gone - known > 1:
            mid, most = (known + gone) // 2, most - 1
            known, gone = (mid, gone) if b.find(a[i + n - mid : i + n], b0, b1) >= 0 else (known, mid)
        i += n - gone + 1
    return x, y, size, tied


def shared(a: str, b: str, most: int = 2_000) -> tuple[int, bool]:
    """matched() of sequences whose items are characters, and whether b and a are known to have the same, since no block had to be chosen.

    Near copies take a few searches a block; ranges that take many go to matched().
    """
    total, both, todo = 0, True, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        found = longest(a, b, a0, a1, b0, b1, most)
        if found is None:
            codes = np.frombuffer((a[a0:a1] + b[b0:b1]).encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.unique(codes, return_inverse=True)[1]
            total, both = total + matched(codes[: a1 - a0], codes[a1 - a0 :]), False
        elif found[2]:
            i, j, size, tied = found
            total, both = total + size, both and not tied
            todo += [(a0, i, b0, j), (i + size, a1, j + size, b1)]
    return total, both


def same_texts(docs: DataFrame, copies: int = 64) -> DataFrame:
    """(component, doc_id, ids): the ids, ascending, that share a text in a component, in rows of about ``copies`` ids each, named by their smallest."""
    of = ["component", "key"]
    ids = docs.select("component", F.sha2("text", 256).alias("key"), "doc_id")
    parts = ids.groupBy(*of).agg(F.ceil(F.count("*") / copies).cast("int").alias("parts"))
    dealt = ids.join(parts.hint("merge"), of).groupBy(*of, F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"))
    return dealt.agg(F.min("doc_id").alias("doc_id"), F.sort_array(F.collect_list("doc_id")).alias("ids")).select("component", "doc_id", "ids")


def sequence_ratios(docs: DataFrame, block: int = 48, copies: int = 64) -> DataFrame:
    """(doc_id, other, ratio) for all pairs, doc_id > other, of docs(doc_id, component, text) with one component: sequence_ratio of their words, parted by spaces.

    Equal texts of a component go on as one row for about ``copies`` ids, so
    different texts are compared, not rows; ids are paired where a comparison's
    row is read. These rows are dealt into blocks, and every pair of blocks
    meets in one group of at most about two blocks of texts, so no task holds a
    component whole and a text is sent once a block instead of once a pair.
    Equal texts agree wholly. The agreement depends on which text is first, so
    both ways are found where ids call for both. Ids are taken to be distinct;
    a null id or text has no pairs.
    """
    live = docs.where("doc_id is not null and text is not null and component is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    same = same_texts(live, copies)
    sizes = same.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.sum(F.size("ids")).alias("n")).where("n > 1")
    dealt = same.join(sizes.drop("n").hint("merge"), "component").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.drop("component").join(live.hint("merge"), "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "ids", "text")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        two = group["i"].iloc[0] != group["j"].iloc[0]
        at, signs, known = {}, {}, {}
        for t in set(group["text"]):
            codes = [at.setdefault(w, len(at)) for w in t.split(" ")]
            signs[t] = "".join(map(chr, codes)) if len(at) <= sys.maxunicode else None  # there are no more characters

        def ratio(left: str, right: str) -> float:
            if left == right:
                return 1.0
            if (left, right) not in known:
                a, b = signs[left], signs[right]
                if a is None or b is None:
                    known[left, right] = agreement(left.split(" "), right.split(" "))
                else:
                    total, both = shared(a, b)
                    known[left, right] = 2 * total / (len(a) + len(b))
                    if both:
                        known[right, left] = known[left, right]
            return known[left, right]

        rows, out = list(zip(group["own"], group["ids"], group["text"], strict=True)), []
        for k, (mine, xs, a) in enumerate(rows):
            if not two and len(xs) > 1:
                out.append((xs, xs, 1.0, -1.0))
            for own, ys, b in rows[k + 1 :]:
                if not two or own != mine:
                    out.append((xs, ys, ratio(a, b) if xs[-1] > ys[0] else -1.0, ratio(b, a) if ys[-1] > xs[0] else -1.0))
        return pd.DataFrame(out, columns=["xs", "ys", "above", "below"])

    found = dealt.groupBy("component", "i", "j").applyInPandas(run, "xs array<long>, ys array<long>, above double, below double")
    found = found.select(F.explode("xs").alias("x"), "ys", "above", "below").select("x", F.explode("ys").alias("y"), "above", "below")
    return found.select(F.greatest("x", "y").alias("doc_id"), F.least("x", "y").alias("other"), F.when(F.col("x") > F.col("y"), F.col("above")).otherwise(F.col("below")).alias("ratio")).where("doc_id > other and ratio >= 0")


def search_index(bills: DataFrame, track: DataFrame) -> DataFrame:
    """One row a bill of the search index: n number, l label, t title up to 120, o outcome, d status, s lower-cased text."""
    rows = bills.join(track.select(*BILL, "outcome", "outcome_label"), BILL, "left").withColumn("outcome", F.coalesce("outcome", F.lit("pending"))).withColumn("outcome_label", F.coalesce("outcome_label", F.lit(rules.OUTCOME_LABEL["pending"])))
    text = F.lower(F.concat_ws(" ", *[tx.optional(F.col(c)) for c in ("label", "title", "sponsor", "cosponsors")]))
    return rows.select("session", F.col("num").alias("n"), F.col("label").alias("l"), F.left(F.coalesce("title", F.lit("")), F.lit(120)).alias("t"), F.col("outcome").alias("o"), tx.status_text(F.col("chapter_law"), F.col("outcome_label")).alias("d"), text.alias("s"))


def search(index: DataFrame, query: str, outcome: str | None = None, cap: int = 400) -> DataFrame:
    """Up to ``cap`` hits by number, each with the count of all hits."""
    hits = index.where(tx.matches(query, outcome, F.col("s"), F.col("o")))
    n = hits.count()
    return hits.orderBy("n").limit(cap).withColumn("of", F.lit(n))
