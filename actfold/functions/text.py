"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and what each becomes; those without a counterpart are deleted.
PUNCTUATION = "‘’‚‛“”‐‑‒–—―−   ﻿"
PLAIN = "''''\"\"-------   "
MARKERS = r"\[\[[+-]|[+-]\]\]"
WORD = r"[A-Za-z0-9§().,;:'/-]+"
CITATION = r"\b\d+[0-9A-Za-z]*\.\d+[0-9A-Za-z.]*"


def truthy(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def optional(c: Column) -> Column:
    """Empty text as null."""
    return F.when(truthy(c), c)


def normalize(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, PLAIN)


def squeeze(c: Column) -> Column:
    """White space, in the Unicode sense, collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def canonical(c: Column) -> Column:
    return squeeze(normalize(F.regexp_replace(F.coalesce(c, F.lit("")), MARKERS, "")))


def loose_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(canonical(c)), "[^a-z0-9]+", "")


def raw_words(c: Column) -> Column:
    """Matches of the word pattern in the text as it is."""
    return F.regexp_count(c, F.lit(WORD))


def space_words(c: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def tokens(c: Column) -> Column:
    """Word tokens of one segment, typography normalised."""
    return F.regexp_extract_all(normalize(c), F.lit(f"({WORD})"), 1)


def stitch(words: Column) -> Column:
    """Tokens of a document in order, one that ends in a hyphen joined to the next."""
    init = F.array().cast("array<string>")
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(words, init, lambda acc, w: F.when((F.size(acc) > 0) & F.endswith(F.when(F.size(acc) > 0, last(acc)).otherwise(""), F.lit("-")), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last(acc), w)))).otherwise(F.concat(acc, F.array(w))))


def stitched_count(words: Column) -> Column:
    """How many tokens stitch() leaves, without building them: a token is joined when the one before it ends in a hyphen."""
    joined = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (i > 1) & F.endswith(F.element_at(words, F.greatest(i - 1, F.lit(1))), F.lit("-")))
    return F.when(F.size(words) > 0, F.size(words) - F.size(joined)).otherwise(0)


def cites_in(clause: Column) -> Column:
    """All section numbers in a clause: parentheticals dropped, a dot required, trailing dots stripped."""
    cleaned = F.regexp_replace(clause, r"\([^)]*\)", " ")
    return F.transform(F.regexp_extract_all(cleaned, F.lit(f"({CITATION})"), 1), lambda x: F.regexp_replace(x, r"\.+$", ""))


def strip_cite_prefix(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^\s*(?:ss?\.|section)\s*", ""))


def tidy_statute(c: Column) -> Column:
    """A citation without prefix and annotations."""
    bare = strip_cite_prefix(c)
    only = F.regexp_extract(bare, r"^\s*\d+[A-Za-z]?\.[\w.]*\d[\w.]*(?:\([^)]{1,8}\))*", 0)
    return F.regexp_replace(F.trim(F.when(only != "", only).otherwise(bare)), r"\.+$", "")


def base_cite(c: Column) -> Column:
    """The citation that has a page: no prefix, no subsection."""
    return F.regexp_replace(F.regexp_replace(strip_cite_prefix(c), r"\s*\(.*$", ""), r"\.+$", "")


def safe_cite(c: Column) -> Column:
    return c.rlike(r"^[0-9A-Za-z.]+$")


def statute_url(base: str, year: int, cite: Column) -> Column:
    return F.concat(F.lit(f"{base}/{year}/"), cite)


def chapter_of(cite: Column) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(cite, F.lit(""))), r"^(\d+)", 1).try_cast("int")


def slug(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


def parse_date(c: Column) -> Column:
    """M/D/YYYY with four digits of year; otherwise null."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(t, "M/d/yyyy"))


def parse_date_loose(c: Column) -> Column:
    """Three integers split at slashes, whatever the year's length; otherwise null."""
    part = lambda i: F.try_element_at(F.split(c, "/"), F.lit(i))
    text = F.concat_ws("-", F.lpad(F.trim(part(3)), 4, "0"), F.lpad(F.trim(part(1)), 2, "0"), F.lpad(F.trim(part(2)), 2, "0"))
    return F.when(F.size(F.split(c, "/")) == 3, F.try_to_date(text, "yyyy-MM-dd"))


def bill_number(c: Column) -> Column:
    """The number in a token such as ``797`` or ``HB 797``."""
    return F.regexp_extract(c, r"(\d+)\s*$", 1).try_cast("long")


def bill_number_of_url(c: Column) -> Column:
    return F.regexp_extract(c, r"/Bill/[^/]+/(\d+)", 1).try_cast("long")


def chamber_of(label: Column) -> Column:
    base = F.upper(F.trim(F.regexp_replace(label, "^(?:CS/)+", "")))
    return F.when(F.left(base, F.lit(1)) == "S", "Senate").when(F.left(base, F.lit(1)) == "H", "House").otherwise("")


def name_list(c: Column) -> Column:
    """Names between semicolons, trimmed, empties dropped, joined again."""
    return F.array_join(F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != ""), "; ")


def byline(c: Column) -> Column:
    """struct(subject, sponsor, cosponsors) of ``SUBJECT by names (CO-INTRODUCERS) names``."""
    return byline_of(byline_cut(c))


def byline_cut(c: Column) -> Column:
    """struct(subject, names) of a byline."""
    split = c.rlike(r"(?s)^.*?\s+by\s+.*$")
    part = lambda k: F.regexp_extract(c, r"(?s)^(.*?)\s+by\s+(.*)$", k)
    return F.struct(F.trim(F.when(split, part(1)).otherwise(c)).alias("subject"), F.when(split, part(2)).otherwise("").alias("names"))


def byline_of(cut: Column) -> Column:
    """What byline() gives of a byline's two parts."""
    names = cut["names"]
    first = F.substring_index(names, "(CO-INTRODUCERS)", 1)
    rest = F.when(F.contains(names, F.lit("(CO-INTRODUCERS)")), F.substring(names, F.length(first) + F.lit(len("(CO-INTRODUCERS)") + 1), F.length(names))).otherwise("")
    return F.struct(cut["subject"].alias("subject"), name_list(first).alias("sponsor"), name_list(rest).alias("cosponsors"))


def clean_areas(given: Column, areas: list[str]) -> Column:
    """The fixed areas that were given, in their fixed order."""
    return F.array_intersect(F.array(*map(F.lit, areas)), given)


def matches(query: str, outcome: str | None, text: Column, outcome_col: Column) -> Column:
    """Search predicate: an outcome, if asked for, and a substring of the lower-cased text."""
    hit = F.contains(text, F.lit(query.lower().strip()))
    return hit & (outcome_col == outcome) if outcome else hit


def status_text(chapter_law: Column, outcome_label: Column) -> Column:
    return F.when(truthy(chapter_law), F.concat(F.lit("LAW · ch "), chapter_law)).otherwise(F.upper(outcome_label))


def degenerate(text: Column) -> Column:
    """Why a reply cannot be used, or null."""
    bare = F.trim(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    run = F.regexp_extract(text, r"(?s)(.)\1{24,}", 1)
    return (
        F.when(text.isNull() | (bare == ""), "empty response")
        .when(text.rlike(r"(?s)(.)\1{24,}"), F.concat(F.lit("padded with repeated "), F.when(run == "\n", "'\\n'").otherwise(F.concat(F.lit("'"), run, F.lit("'")))))
        .when(F.startswith(bare, F.lit("{")) & ~F.endswith(bare, F.lit("}")), "truncated before the object closed")
    )
