"""Small literal cases, one row a case."""

import pytest
from pyspark.sql import functions as F

from actfold.functions import rules
from actfold.functions import text as tx
from actfold.operators import areas, digest, events, lookup, segments, statutes, verify, writes
from actfold.sources import pages

HISTORY = "session string, num long, seq long, date string, chamber string, action string"
BILLS = "session string, num long, label string, title string, sponsor string, cosponsors string, chapter_law string, effective_date string, last_action string"
SEG = "session string, num long, seg_ix long, kind string, text string, line long, page long"
KEYS = ["session", "num"]


def value(spark, make, *args):
    """A column function of literals."""
    return spark.range(1).select(make(*[F.lit(a) for a in args]).alias("x")).first().x


def track(spark, actions, label="HB 1", law=""):
    h = spark.createDataFrame([("s", 1, i, "1/2/2026", "House", a) for i, a in enumerate(actions)], HISTORY)
    b = spark.createDataFrame([("s", 1, label, "t", "", "", law, "", "")], BILLS)
    return events.progress(h, b).first()


@pytest.mark.parametrize(
    ("actions", "label", "want"),
    [
        (["Filed", "Favorable with CS by Rules", "Laid on Table under Rule 7.18(a)", "CS Filed", "Referred to Rules"], "HB 1", {"outcome": "pending"}),
        (["Filed", "Referred to Rules", "Withdrawn from Rules", "Placed on Calendar, on 2nd reading"], "HB 1", {"outcome": "pending", "stage": "on_calendar"}),
        (["Filed", "Withdrawn prior to introduction"], "HB 1", {"outcome": "died"}),
        (["Filed", "Died in Rules, companion bill(s) passed, see CS/CS/HB 123 (Ch. 2026-45)"], "HB 1", {"outcome": "superseded", "companion": "CS/CS/HB 123"}),
        (["Filed", "Approved by Governor", "Chapter No. 2026-174"], "HB 1", {"outcome": "became_law", "percent": 100}),
        (["Filed", "Signed by Officers and presented to Governor", "Vetoed by Governor"], "HB 1", {"outcome": "vetoed", "stage": "to_governor"}),
        (["Filed", "Died in Ways & Means Committee"], "HB 1", {"outcome": "died", "died_in": "Ways & Means Committee"}),
        (["Filed", "Approved by Governor", "Laid on Table, companion bill(s) passed, see SB 2"], "HB 1", {"outcome": "became_law"}),
        (["Filed", "Signed by Officers and filed with Secretary of State"], "HJR 203", {"outcome": "to_ballot"}),
        (["Adopted"], "HB 1", {"outcome": "pending"}),
        (["Adopted"], "SR 1466", {"outcome": "adopted"}),
        ([""], "HB 1", {"outcome": "pending", "stage": "filed", "events": 1}),
    ],
)
def test_progress(spark, actions, label, want):
    got = track(spark, actions, label).asDict()
    assert {k: got[k] for k in want} == want


def test_chapter_law_decides(spark):
    assert track(spark, ["Filed", "Died in Rules"], law="2026-1").outcome == "became_law"


@pytest.mark.parametrize(("label", "kind"), [("CS/CS/HJR 203", "joint_resolution"), ("HB 33", "bill"), ("SR 1466", "resolution"), ("", "bill"), (None, "bill")])
def test_kind(spark, label, kind):
    assert value(spark, lambda c: rules.kind_of(c.cast("string")), label) == kind


def test_pathway(spark):
    h = spark.createDataFrame([("s", 1, i, "1/2/2026", "House", a) for i, a in enumerate(["Filed", "Referred to Rules", "Read 2nd time"])], HISTORY)
    b = spark.createDataFrame([("s", 1, "HB 1", "t", "", "", "", "", "")], BILLS)
    got = events.pathway(events.progress(h, b), events.milestones(h, b)).orderBy("rung").collect()
    assert [r.reached for r in got] == [True] * 6 + [False] * 5 and [r.current for r in got].index(True) == 5
    assert [r.date for r in got][5] == "1/2/2026" and got[2].date is None


@pytest.mark.parametrize(("dead", "action"), [(True, "6/13/2024 House - Died in Rules"), (False, "6/13/2024 House - Withdrawn from Rules"), (False, None), (True, "Laid on Table")])
def test_dead(spark, dead, action):
    assert value(spark, lambda c: rules.is_dead(c.cast("string")), action) is dead


def test_marks_of_rules(spark):
    words = spark.createDataFrame([(1, i, 10.0, 50.0, 200.0, 210.0, "w") for i in range(4)], "page int, word_ix int, x0 double, x1 double, top double, bottom double, text string").withColumn("page", F.col("word_ix"))
    thin = spark.createDataFrame([(0, 1, 10.0, 50.0, 210.4, 0.5, 40.0), (1, 2, 10.0, 50.0, 205.3, 0.5, 40.0), (2, 3, 10.0, 50.0, 240.0, 0.5, 40.0), (3, 4, 10.0, 15.0, 210.4, 0.5, 5.0)], "page int, rule_ix int, x0 double, x1 double, top double, height double, width double")
    assert [r.kind for r in segments.marked_words(words, thin).orderBy("word_ix").collect()] == ["insert", "delete", "plain", "plain"]


def test_geometry_lines(spark):
    words = spark.createDataFrame([(1, 0, 30.0, 40.0, 200.0, 210.0, "17"), (1, 1, 100.0, 140.0, 200.0, 210.0, "old"), (1, 2, 150.0, 190.0, 201.0, 211.0, "new"), (1, 3, 200.0, 230.0, 200.0, 210.0, "words")], "page int, word_ix int, x0 double, x1 double, top double, bottom double, text string")
    thin = spark.createDataFrame([(1, 1, 150.0, 230.0, 211.0, 0.5, 80.0)], "page int, rule_ix int, x0 double, x1 double, top double, height double, width double")
    got = segments.geometry_segments(words, thin).orderBy("seg_ix").collect()
    assert [(r.line, r.kind, r.text) for r in got] == [(17, "plain", "old"), (17, "insert", "new words")]


def marked(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    return [(r.kind, r.text, r.line) for r in pages.marked_segments(df).orderBy("pos").collect()]


def test_marked_html(spark):
    assert marked(spark, "<pre><u>applica</u><u>bility</u></pre>") == [("insert", "applicability", None)]
    assert marked(spark, "<pre>    1         An act relating to <u>public notice</u>;</pre>") == [("plain", "An act relating to", 1), ("insert", "public notice", 1), ("plain", ";", 1)]
    assert marked(spark, '<body>x <span class="Remove">y</span><style>z</style></body>') == [("plain", "x", None), ("delete", "y", None)]


def seg(spark, *parts, num=1):
    return spark.createDataFrame([("s", num, i, k, t, n, 1) for i, (k, t, n) in enumerate(parts)], SEG)


def test_stitching(spark):
    df = seg(spark, ("insert", "end-of-", 1), ("insert", "course exam", 2))
    assert value(spark, lambda: tx.stitch(F.array(F.lit("end-of-"), F.lit("course"), F.lit("exam")))) == ["end-of-course", "exam"]
    assert segments.stats(df, KEYS).first().words_inserted == 2


@pytest.mark.parametrize(("clause", "cites"), [("493.6201(4)", ["493.6201"]), ("and (4)(a), (d), and (e)", []), ("1.01, 2.02.", ["1.01", "2.02"])])
def test_citations(spark, clause, cites):
    assert value(spark, tx.cites_in, clause) == cites


def test_title_references(spark):
    df = seg(spark, ("plain", "An act; reenacting ss. 489.107(4)(b), 489.113(2), relating to x; amending s. 1.01, F.S.", None))
    got = statutes.cross_reference(df, KEYS).collect()
    assert sorted((r.action, r.statute, r.in_title, r.in_body) for r in got) == [("amend", "1.01", True, False), ("reenact", "489.107", True, False), ("reenact", "489.113", True, False)]


def test_section_reference(spark):
    df = seg(spark, ("plain", "Section 1. Subsection (15) of section 215.422, Florida Statutes, is amended to read:", 1), ("insert", "three new words", 2))
    (r,) = statutes.cross_reference(df, KEYS).collect()
    assert (r.statute, r.action, r.bill_section, r.words_added, r.line_start, r.line_end, r.scope) == ("215.422", "amend", 1, 3, 1, 2, "Subsection (15) of")
    assert statutes.summary(spark.createDataFrame([r])).first().summary == "amends s. 215.422 at line 1 (+3 / -0 words)"


def test_chapter_reference(spark):
    df = seg(spark, ("plain", "Section 1. Chapter 205, Florida Statutes, consisting of ss. 205.013, 205.022, 205.023, is repealed.", 4))
    got = statutes.cross_reference(df, KEYS).collect()
    assert sorted((r.statute, r.action, r.scope, r.line_start) for r in got) == [(c, "repeal", "chapter 205", 4) for c in ("205.013", "205.022", "205.023")]


def test_three_readings(spark):
    df = seg(spark, ("plain", "Florida Statutes", 1), ("insert", "2026", 1), ("delete", "2025", 1), ("plain", "is in force", 1))
    quotes = ["Florida Statutes 2026 is", "florida statutes 2025, is in", "Statutes 2026 2025 is in force", "no such words at all", "two words", ""]
    c = spark.createDataFrame([("s", 1, i, q) for i, q in enumerate(quotes)], "session string, num long, ord int, quote string")
    got = verify.checked(c, segments.readings(df, KEYS), KEYS).orderBy("ord").collect()
    assert [r.quote_status for r in got] == ["exact", "loose", "exact", "failed", "failed", "failed"]
    assert [r.drop_reason for r in got][3:] == ["not found in the bill text", "too short to identify a passage", "empty quote"]


@pytest.mark.parametrize(("text", "bad"), [('{"reading": "}' + "\n" * 60, True), ("", True), (None, True), ('{"a": 1', True), ('{"a": 1}', False), ("x" * 24, False), ("x" * 25, True)])
def test_degenerate(spark, text, bad):
    assert (value(spark, lambda c: tx.degenerate(c.cast("string")), text) is not None) is bad


@pytest.mark.parametrize(
    ("make", "args", "hit"),
    [
        (verify.flags_intent, ["The sponsor intends this"], True),
        (verify.flags_intent, ["Claimants' representatives must file"], False),
        (verify.flags_intent, ["Representative Smith wrote it"], True),
        (verify.flags_inverted, ["Local governments can levy the tax", "may not be levied"], True),
        (verify.flags_inverted, ["A hospital may bill up to 125 percent", "may not exceed 125 percent"], False),
        (verify.flags_inverted, ["They cannot levy it", "may not be levied"], False),
        (verify.flags_false_repeal, ["Removes the requirement to file", " , , "], True),
        (verify.flags_false_repeal, ["Removes the requirement to file", "shall file"], False),
        (verify.flags_cut_headline, ["a" * 109], True),
        (verify.flags_cut_headline, ["a" * 108 + "."], False),
        (verify.flags_cut_headline, ["a" * 107 + "-."], True),
        (verify.flags_cut_headline, ["short"], False),
    ],
)
def test_guards(spark, make, args, hit):
    assert (value(spark, make, *args) is not None) is hit


def test_retry_notes(spark):
    note = lambda r: value(spark, lambda c: verify.retry_note(c, [("cut at the", "shorter"), ("claims a repeal", "look")], "again"), r)
    assert [note("headline cut at the limit"), note("claims a repeal (x)"), note("other")] == ["shorter", "look", "again"]


def test_runs_are_marked_once(spark):
    df = seg(spark, *[("insert", f"w{i}", i) for i in range(4)])
    assert segments.context_blocks(df, KEYS).first().passage == "[[+w0 w1 w2 w3+]]"


def test_dedupe(spark):
    c = spark.createDataFrame([("s", 1, i, q) for i, q in enumerate(["One two.", "one, TWO", "three", "", ""])], "session string, num long, ord int, quote string")
    assert [r.ord for r in verify.deduped(c, KEYS, ["ord"]).orderBy("ord").collect()] == [0, 2, 3, 4]


def test_sponsors(spark):
    b = spark.createDataFrame([("s", 1, "HB 1", "t", "Rules; Judiciary; Community Affairs; McClain", "", "", "", ""), ("s", 2, "HB 2", "t", "Health Subcommittee; Roth", "", "", "", "")], BILLS)
    names = spark.createDataFrame([("Rules",), ("Judiciary",), ("Community Affairs",), ("Rules",)], "name string")
    got = areas.split_sponsors(b, names).orderBy("num").collect()
    assert (got[0].panels, got[0].people) == (["Rules", "Judiciary", "Community Affairs"], ["McClain"])
    assert (got[1].panels, got[1].people) == (["Health Subcommittee"], ["Roth"])


def test_statute_links(spark):
    c = spark.createDataFrame([("1002.33(10)(e)",), ("s. 1003.42(2)(w)",), ("999.99(1)",)], "statute string")
    r = spark.createDataFrame([("1002.33",), ("1003.42",)], "statute string")
    assert sorted(x.link for x in lookup.statute_links(c, r).collect()) == ["", "1002.33", "1003.42"]
    assert value(spark, tx.tidy_statute, "s. 493.6102(16) (new) - 28 words") == "493.6102(16)"


@pytest.mark.parametrize(("chapter", "area"), [("553.1", "Agriculture"), ("333.01", "Transportation"), ("403.1", "Environment & Water"), ("1.01", None), ("x", None)])
def test_first_range_counts(spark, chapter, area):
    assert areas.areas_of_refs(spark.createDataFrame([(chapter,)], "statute string")).first().area == area


def test_area_votes(spark):
    b = spark.createDataFrame([("s", i, "HB", t, "", "", "", "", "") for i, t in enumerate(["Water", "Artificial intelligence", "Water", "Bridge"])], BILLS)
    r = spark.createDataFrame([("s", 0, "1000.1"), ("s", 0, "97.1"), ("s", 1, "97.1"), ("s", 0, "5.5")], "session string, num long, statute string")
    got = {x.num: (x.area, x.area_slug) for x in areas.classify(b, r).collect()}
    assert got == {0: ("Education", "education"), 1: ("AI & Technology", "ai-technology"), 2: ("Environment & Water", "environment-water"), 3: (None, "")}


def test_dates(spark):
    d = lambda s: str(value(spark, tx.parse_date, s))
    assert [d("1/2/2026"), d("13/2/2026"), d("1/2/26"), d("soon"), d("02/03/2026 ")] == ["2026-01-02", "None", "None", "None", "2026-02-03"]
    assert str(value(spark, tx.parse_date_loose, "1/2/26")) == "0026-01-02"


def test_byline(spark):
    got = value(spark, tx.byline, "GENERAL BILL by Rules ; McClain; (CO-INTRODUCERS) Roth; ; Pizzo")
    assert (got.subject, got.sponsor, got.cosponsors) == ("GENERAL BILL", "Rules; McClain", "Roth; Pizzo")
    assert value(spark, tx.byline, "MEMORIAL").subject == "MEMORIAL"


def test_no_digest_where_nothing_is_new(spark, tmp_path):
    rows = digest.documents(spark.createDataFrame([], "session string, num long, label string, title string, area string, area_slug string, one_line string"), "daily", "2026-01-01")
    assert not writes.write_if_any(rows, str(tmp_path / "x")) and not (tmp_path / "x").exists()


def test_nothing_is_sent_twice(spark):
    rows = spark.createDataFrame([("s", 1, "HB 1", "t", "Housing", "housing", "")], "session string, num long, label string, title string, area string, area_slug string, one_line string")
    subs = spark.createDataFrame([(1, "a@x", ["housing"], True, True, "d", False, 0), (2, "b@x", ["taxes"], True, True, "d", False, 0), (3, "c@x", ["housing"], True, True, "", False, 0)], "id long, email string, areas array<string>, daily boolean, weekly boolean, confirmed_at string, unsubscribed boolean, bounces int")
    none = spark.createDataFrame([], "subscriber_id long, payload string")
    first = digest.deliveries(rows, subs, none, "p", "daily")
    assert [r.id for r in first.collect()] == [1]
    sent = first.select(F.col("id").alias("subscriber_id"), "payload")
    assert digest.deliveries(rows, subs, sent, "p", "daily").count() == 0
    assert digest.messages(digest.deliveries(rows, subs, none, "p", "weekly"), "weekly", "s", "https://e").count() == 2


def test_members(spark):
    html = '<div class="senator"><h2>Senator Jason W. B. "Jay" Pizzo</h2><p>Party: No Party Affiliation</p></div>'
    p = spark.createDataFrame([(1, html, "https://x/Senators/S37")], "page_id long, html string, url string")
    (r,) = pages.members(pages.page_blocks(p), p.select(F.col("page_id").alias("page"), "url")).collect()
    assert (r.name, r.party, r.district) == ("Jason W. B. Pizzo", "No Party Affiliation", 37)


def test_a_brief_with_references_whole(spark):
    """Bills with no, three and 62 references, each brief compared as a whole text with one written by a loop."""
    bills = [("s", n, f"HB {n}", f"Title {n}", "House", "Roth" if n % 2 else "", "7/1/2024", "An act." if n == 2 else None) for n in (1, 2, 3)]
    refs = [("s", 2, 1, "1.01", "amend", 7, 9, 3, 0, None), ("s", 2, None, "9.02", "repeal", None, None, 0, 0, ""), ("s", 2, 1, "1.005", "create", 0, None, 0, 12, "Subsection (2) of")]
    refs += [("s", 3, k, f"{k}.01", "amend", k, k, 1, 1, None) for k in range(1, 63)]
    blocks = [("s", n, k, 1, 10 * k, f"passage {k} [[+new+]]") for n in (2, 3) for k in range(n)]
    totals = [("s", 2, 1234, 5), ("s", 3, 0, 0)]
    head = verify.headers(spark.createDataFrame(bills, "session string, num long, label string, title string, chamber string, sponsor string, effective_date string, long_title string"), spark.createDataFrame(refs, "session string, num long, bill_section int, statute string, action string, line_start int, line_end int, words_added int, words_deleted int, scope string"))
    got = {r.num: r.text for r in verify.briefs(head, spark.createDataFrame(blocks, "session string, num long, block_ix long, changed long, line long, passage string"), spark.createDataFrame(totals, "session string, num long, space_words_added long, space_words_deleted long")).collect()}
    for _, n, label, title, chamber, sponsor, effective, long_title in bills:
        out = [f"BILL: {label} — {title}", f"CHAMBER: {chamber}"]
        out += [f"SPONSOR: {sponsor}"] * bool(sponsor) + [f"EFFECTIVE: {effective}"]
        out += [f"\nOFFICIAL SUMMARY (written by the Legislature):\n{long_title}"] * bool(long_title)
        own = sorted((r for r in refs if r[1] == n), key=lambda r: (r[2] is None, r[2] or 0, r[3], r[4]))
        if own:
            out.append(f"\nSTATUTES THIS BILL OPERATES ON ({len(own)}):")
            for _, _, section, statute, action, line, _, added, deleted, scope in own[:60]:
                out.append(f"  section {section or '-'}: {action}s s. {statute} at {f'line {line}' if line else 'title only'}" + (f", +{added}/-{deleted} words" if added or deleted else "") + (f" [{scope}]" if scope else ""))
            out += [f"  ... and {len(own) - 60} more"] * (len(own) > 60)
        mine = [b for b in blocks if b[1] == n]
        if mine:
            words = next(t for t in totals if t[1] == n)
            out.append(f"\nCHANGED LANGUAGE ({len(mine)} of {len(mine)} passages). In total this bill adds {words[2]:,} words and deletes {words[3]:,}.")
            out += [f"\n[{f'line {b[4]}' if b[4] else '—'}] {b[5]}" for b in mine]
        else:
            out.append("\nCHANGED LANGUAGE: none marked")
        assert got[n] == "\n".join(out)
