"""Ordered rule lists and label maps, and the expressions made of them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of measures, their labels, and the label prefixes that name them.
KIND_LABEL = {"bill": "Bill", "resolution": "Resolution", "joint_resolution": "Joint resolution (constitutional amendment)", "concurrent_resolution": "Concurrent resolution", "memorial": "Memorial"}
KIND_PREFIX = {"HJR": "joint_resolution", "SJR": "joint_resolution", "HCR": "concurrent_resolution", "SCR": "concurrent_resolution", "HM": "memorial", "SM": "memorial", "HR": "resolution", "SR": "resolution"}

# The rungs in order, with their labels for bills and for resolutions.
STAGES = ["filed", "referred", "in_committee", "reported", "on_calendar", "floor", "passed_origin", "second_chamber", "enrolled", "to_governor", "law"]
STAGE_LABEL = ["Filed", "Referred to committee", "Heard in committee", "Reported out of committee", "Placed on calendar", "Floor reading", "Passed originating chamber", "Sent to second chamber", "Passed both chambers", "Sent to the Governor", "Became law"]
RESOLUTION_LABEL = ["Filed", "Referred to committee", "Heard in committee", "Reported out of committee", "Placed on calendar", "Floor reading", "Adopted", "Sent to second chamber", "Adopted by both chambers", "Signed by officers", "Filed with the Secretary of State"]

# Patterns of actions and the stage each means; the first that is found counts.
STAGE_RULES = [
    (r"^Chapter No\.", "law"),
    (r"filed with Secretary of State", "law"),
    (r"^Adopted", "passed_origin"),
    (r"^Approved by Governor", "law"),
    (r"^Became Law without", "law"),
    (r"^Vetoed by Governor", "to_governor"),
    (r"^Signed by Officers and presented to Governor", "to_governor"),
    (r"^Ordered enrolled", "enrolled"),
    (r"^Enrolled", "enrolled"),
    (r"^(In Messages|Immediately certified|Received)", "second_chamber"),
    (r"^(CS )?[Pp]assed", "passed_origin"),
    (r"^Read \d+(st|nd|rd|th) time", "floor"),
    (r"Calendar", "on_calendar"),
    (r"^(Favorable|Reported out|CS by|Unfavorable)", "reported"),
    (r"^(On Committee agenda|Added to .* agenda|Now in )", "in_committee"),
    (r"^(Referred to|Pending reference review)", "referred"),
    (r"^(Filed|Introduced|CS Filed|\d+(st|nd|rd|th) Reading)", "filed"),
]
NO_STAGE = r"^Laid on Table under Rule"

# Outcomes with their labels, the settled ones, and the actions that end a measure.
OUTCOME_LABEL = {"pending": "Still moving", "became_law": "Became law", "vetoed": "Vetoed by the Governor", "died": "Died", "superseded": "Superseded — its companion passed", "adopted": "Adopted", "to_ballot": "Goes to the voters as a constitutional amendment"}
OUTCOME_SHORT = {"pending": "still moving", "became_law": "became law", "vetoed": "vetoed", "died": "died", "superseded": "superseded by companion", "adopted": "adopted", "to_ballot": "went to the ballot"}
SETTLED = ["became_law", "vetoed", "adopted", "to_ballot"]
DEATH_RULES = [
    r"^Died\b",
    r"^Withdrawn prior to introduction",
    r"^Withdrawn from further consideration",
    r"^Failed to pass",
    r"^Indefinitely postponed",
    r"^Laid on Table[,;]\s*[Cc]ompanion bill",
    r"^Laid on Table\s*(?:-+\s*[SH]J\s*\d+)?\s*$",
    r"^Original bill laid on Table",
]
COMPANION = r"companion bill\(s\) passed,\s*see\s+([A-Z/]*\s?[A-Z]{1,4}\s*\d+)"
DIED_IN = r"^Died (?:in|on) (.+?)(?:[,;]|$)"

# Verbs and the category of action each means, and the categories' labels.
ACTION_CATEGORY = {
    "amended": "amend", "amending": "amend", "revising": "amend", "added": "amend",
    "created": "create", "creating": "create",
    "repealed": "repeal", "repealing": "repeal", "abrogating": "repeal",
    "reenacted": "reenact", "reenacting": "reenact",
    "redesignated": "renumber", "redesignating": "renumber", "renumbered": "renumber", "renumbering": "renumber", "reordered": "renumber",
    "transferred": "transfer", "transferring": "transfer",
    "revived": "revive", "readopted": "revive",
    "directed": "direct",
}
ACTION_LABEL = {"amend": "amends", "create": "creates", "repeal": "repeals", "reenact": "reenacts", "renumber": "renumbers", "transfer": "transfers", "revive": "revives", "direct": "directs"}

# The thirteen areas; inclusive chapter ranges, of which the first that holds counts; title patterns likewise.
AREAS = ["Agriculture", "AI & Technology", "Criminal Justice", "Development & Land Use", "Education", "Elections", "Environment & Water", "Healthcare", "Housing", "Insurance", "Local Government", "Taxes & Budget", "Transportation"]
CHAPTERS = [
    ("Elections", [(97, 107)]),
    ("Education", [(1000, 1013), (228, 246)]),
    ("Criminal Justice", [(775, 985), (741, 741), (943, 947)]),
    ("Transportation", [(316, 349), (310, 315)]),
    ("Environment & Water", [(253, 259), (369, 380), (403, 403), (373, 373), (161, 162)]),
    ("Healthcare", [(381, 408), (456, 499), (409, 409), (394, 397)]),
    ("Insurance", [(624, 651)]),
    ("Agriculture", [(500, 604)]),
    ("Housing", [(420, 424), (718, 723)]),
    ("Development & Land Use", [(163, 164), (177, 177), (190, 190), (333, 333), (553, 553)]),
    ("Local Government", [(125, 125), (165, 189), (112, 112), (119, 119), (286, 286)]),
    ("Taxes & Budget", [(192, 220), (73, 76), (215, 218)]),
]
TITLE_RULES = [
    ("AI & Technology", r"\b(artificial intelligence|machine learning|algorithm\w*|autonomous|deepfake|generative|chatbot|social media platform|data centers?|cryptocurrenc\w+|digital asset\w*|blockchain)\b"),
    ("Elections", r"\b(election|ballot|votin|voter|redistrict)\w*\b"),
    ("Education", r"\b(school|student|charter school|university|college|teacher|K-12)\b"),
    ("Criminal Justice", r"\b(criminal|felony|misdemeanor|sentenc\w+|offender|inmate|probation|law enforcement)\b"),
    ("Healthcare", r"\b(health|medicaid|medicare|hospital|patient|nurs\w+|physician|prescription|mental health)\b"),
    ("Transportation", r"\b(transportation|highway|motor vehicle|driver licen\w+|airport|seaport|toll)\b"),
    ("Environment & Water", r"\b(environment\w*|water|wetland|coastal|pollut\w+|conservation|everglades)\b"),
    ("Housing", r"\b(housing|landlord|tenant|condominium|homeowners association|eviction)\b"),
    ("Insurance", r"\b(insur\w+|reinsur\w+|underwrit\w+)\b"),
    ("Agriculture", r"\b(agricultur\w+|farm\w*|livestock|citrus|aquacultur\w+|forestry)\b"),
    ("Taxes & Budget", r"\b(tax\w*|appropriation|revenue|millage|trust fund|budget)\b"),
    ("Local Government", r"\b(municipalit\w+|count(y|ies)|special district|public records|public officers?)\b"),
    ("Development & Land Use", r"\b(land use|comprehensive plan|zoning|development|building code|permitting)\b"),
]


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a small fixed map, null where there is none."""
    return F.try_element_at(F.create_map(*map(F.lit, chain(*table.items()))), key)


def first_match(rules: list[tuple[str, str]], c: Column) -> Column:
    """The value of the first pattern found, letters in either case; null if none is."""
    (pattern, value), *rest = rules
    out = F.when(c.rlike(f"(?i){pattern}"), value)
    for pattern, value in rest:
        out = out.when(c.rlike(f"(?i){pattern}"), value)
    return out


def kind_of(label: Column) -> Column:
    base = F.upper(F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), "^(?:CS/)+", "")))
    return F.coalesce(lookup(KIND_PREFIX, F.regexp_extract(base, "^([A-Z]+)", 1)), F.lit("bill"))


def stage_of(action: Column) -> Column:
    return F.when(~action.rlike(f"(?i){NO_STAGE}"), first_match(STAGE_RULES, action))


def rank_of(stage: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, STAGES)), stage) - 1).cast("int")


def is_terminal(action: Column) -> Column:
    out = F.lit(False)
    for pattern in DEATH_RULES:
        out = out | action.rlike(f"(?i){pattern}")
    return out


def is_dead(last_action: Column) -> Column:
    """Whether a last action ends a measure, its date and chamber stripped."""
    return is_terminal(F.regexp_replace(F.trim(F.coalesce(last_action, F.lit(""))), r"^\d[\d/]*\s+\w*\s*-\s*", ""))


def companion_of(action: Column) -> Column:
    found = F.regexp_extract(action, f"(?i){COMPANION}", 1)
    return F.when(found != "", F.trim(F.regexp_replace(found, r"\s+", " ")))


def died_in(action: Column) -> Column:
    found = F.regexp_extract(action, f"(?i){DIED_IN}", 1)
    return F.when(found != "", F.trim(found))


def stage_label(stage: Column, kind: Column) -> Column:
    return F.when(kind == "bill", lookup(dict(zip(STAGES, STAGE_LABEL, strict=True)), stage)).otherwise(lookup(dict(zip(STAGES, RESOLUTION_LABEL, strict=True)), stage))


def percent(rank: Column) -> Column:
    return (rank * 100 / (len(STAGES) - 1)).cast("int")


def area_of_title(title: Column) -> Column:
    return first_match([(p, a) for a, p in TITLE_RULES], title)


def chapter_areas() -> list[tuple[int, str]]:
    """(chapter, area) for every chapter of a range, the first range that holds it counting."""
    out: dict[int, str] = {}
    for area, ranges in CHAPTERS:
        for low, high in ranges:
            for chapter in range(low, high + 1):
                out.setdefault(chapter, area)
    return sorted(out.items())
