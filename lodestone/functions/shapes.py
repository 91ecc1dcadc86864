"""Predicates on the shape of labels, table strings and grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, split_camel

# Legal forms that mark a label as an organization's name (a regular expression's alternatives).
CORPORATE = r"(?i)\b(?:Inc|Corp|Corporation|Company|Co|Ltd|Limited|LLC|N\.?V\.?|GmbH|AG|S\.?A\.?|S\.?p\.?A\.?|plc|PLC|Holdings|Group|Industries|Partners|Bhd|Pty)\b\.?"
# Last words of document titles.
TITLE_TAILS = (
    "Report", "Factbook", "Dashboard", "Tracker", "Index", "Bulletin", "Briefing", "Forecast", "Outlook", "Whitepaper", "Yearbook", "Atlas",
    "Monitor", "Hub", "Tool", "Database", "Calendar", "Alert", "Portal", "Platform", "Survey", "Directory", "Source", "App", "Service",
    "Review", "Reviews", "Newsletter", "Brief", "Memo", "Note", "Page", "Site", "Paper",
)
YEAR_PREFIX = r"^(?:Q[1-4]\s+)?(?:19|20)\d{2}\b"
# Kinds of places whose descendants' labels are known places.
PLACE_KINDS = (
    "Country", "Continent", "Region", "City", "State", "Province", "Territory", "GeopoliticalEntity", "PoliticalRegion", "AdministrativeRegion", "GeographicRegion", "GeographicEntity", "AdministrativeArea",
)
# Words of organizations, events and roles for the audit.
AUDIT_SUFFIXES = (
    " inc", " inc.", ", inc", " ltd", " ltd.", ", ltd", " corp", " corp.", " corporation", " industries", " petrochemicals", " petroleum",
    " company", " co.", " co ltd", " group", " plc", " gmbh", " s.a.", " holdings", " bank ", " bank of ", " university", " federation", " association", " council ",
)
EVENT_WORDS = ("crisis", "closure", "war", "disruption", "shortage", "conflict", "incident", "shutdown", "blockage", "attack", "sanctions", "embargo", "dispute", "treaty", "escalation", "mobilization", "summit")
ROLE_LABELS = ("president", "primeminister", "prime minister", "chancellor", "ceo", "cfo", "cto", "coo", "chairman", "chairwoman", "chairperson", "founder", "director", "minister", "secretary")
NOT_IN_NAMES = ("of", "the", "and", "in", "on", "for", "to", "at")
# Table strings that name no entity.
TABLE_NOISE = (
    "total", "subtotal", "grand total", "other", "others", "all", "balance", "ending balance", "opening balance", "beginning balance",
    "average", "weighted average", "sum", "n/a", "na", "nil", "none", "amount", "amounts", "value", "values", "rate", "share", "shares",
    "year", "years", "fy", "cy", "quarter", "month", "day", "current", "previous", "prior", "next", "last", "first", "second",
    "third", "fourth", "fifth", "annual", "interim", "ttm", "increase", "decrease", "change", "variance",
    "yes", "no", "true", "false", "applicable", "not applicable", "above", "below", "see notes", "see note", "note", "notes",
)
DATE_LIKE = r"^(?:Q[1-4]\s+)?(?:FY|fy|cy|CY|H[12]\s+)?(?:19|20)\d{2}\b"
PERMISSIVE = r"(?i)^[\s\-+$€£¥₹%()0-9,.–—a-z]+$"
# Labels that a model makes up.
PLACEHOLDERS = ("category a", "category b", "category c", "column 1", "column 2", "column 3", "row 1", "row 2", "row 3", "item 1", "item 2", "value 1", "value 2", "example", "placeholder", "lorem ipsum")
BIBLIOGRAPHY = r"(?i)\b(?:et al\.?|vol\.?|pp\.?|ibid\.?|op\. cit\.?|doi:|https?://|ISBN|ISSN|journal|press|proceedings)\b"
CONTENTS_CAPTION = r"(?i)\b(?:Table of Contents|Index|Bibliography|References)\b"
PAGE_NUMBER = r"^\s*[ivxlcdmIVXLCDM\d\-,\s]+\s*$"


def entity_shape(label: Column | str, is_known_place: Column | None = None, more_suffixes: str | None = None, more_tails: str | None = None) -> Column:
    """Why a class label looks like a named entity: the first of four reasons, or null."""
    c = F.trim(F.coalesce(col(label), F.lit("")))
    spaced = split_camel(c)
    suffix = c.rlike(CORPORATE) | (c.rlike(more_suffixes) if more_suffixes else F.lit(False))
    tail = spaced.rlike(r"(?i)\s(?:" + "|".join(TITLE_TAILS) + r")\s*$") | (spaced.rlike(more_tails) if more_tails else F.lit(False))
    place = is_known_place if is_known_place is not None else F.lit(False)
    return (
        F.when(c == "", F.lit(None).cast("string"))
        .when(suffix, "corporate-suffix")
        .when(place, "known-place")
        .when(tail, "document-title")
        .when(F.contains(c, F.lit(" ")) & c.rlike(YEAR_PREFIX), "year-prefix")
    )


def words_pattern(words: list[str]) -> str | None:
    """A pattern for extra whole words from a user's settings; None without any."""
    cleaned = [w.strip() for w in words if w and w.strip()]
    return r"(?i)\b(?:" + "|".join("\\Q" + w + "\\E" for w in cleaned) + r")\b" if cleaned else None


def has_corporate_suffix(label: Column | str) -> Column:
    padded = F.concat(F.lit(" "), F.lower(col(label)), F.lit(" "))
    return reduce(lambda a, s: a | F.contains(padded, F.lit(s)), AUDIT_SUFFIXES, F.lit(False))


def has_event_word(label: Column | str) -> Column:
    return F.lower(col(label)).rlike(r"\b(?:" + "|".join(EVENT_WORDS) + r")\b")


def is_person_name(label: Column | str) -> Column:
    """Two to four capitalised words without digits, and nothing that speaks against a person."""
    parts = F.filter(F.split(F.trim(col(label)), r"\s+"), lambda p: p != "")
    fine = F.forall(parts, lambda p: p.rlike(r"^\p{Lu}") & ~p.rlike(r"\d") & ~F.lower(p).isin(*NOT_IN_NAMES))
    return F.size(parts).between(2, 4) & fine & ~has_corporate_suffix(label) & ~has_event_word(label)


def is_suspicious(label: Column | str, parent: Column | str) -> Column:
    """Whether a new class deserves an audit, from its label and its parent's."""
    c, p = col(label), F.lower(F.coalesce(col(parent), F.lit("owl:Thing")))
    has = lambda *words: reduce(lambda a, w: a | F.contains(p, F.lit(w)), words, F.lit(False))
    found = (
        (p == "owl:thing")
        | (has_corporate_suffix(c) & ~has("organization", "organisation"))
        | (has_event_word(c) & ~has("event", "crisis", "conflict"))
        | is_person_name(c)
        | (F.replace(F.lower(c), F.lit(" "), F.lit("")).isin(*ROLE_LABELS) & ~has("role"))
    )
    return F.coalesce((F.trim(c) != "") & found, F.lit(False))


def is_table_candidate(value: Column | str) -> Column:
    """Whether a table string could name an entity."""
    c = F.trim(col(value))
    letters = F.length(F.regexp_replace(c, r"\P{L}", ""))
    return F.coalesce((F.length(c) >= 3) & ~F.lower(c).isin(*TABLE_NOISE) & ~c.rlike(DATE_LIKE) & (~c.rlike(PERMISSIVE) | (letters >= 3)), F.lit(False))


def _filled(grid: Column) -> Column:
    return F.size(F.filter(F.flatten(grid), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))


def is_simple_grid(grid: Column | str) -> Column:
    """At least 2 x 2, rectangular, and 4 cells and 30 % of all filled."""
    g = col(grid)
    width = F.size(F.get(g, F.lit(0)))
    even = F.forall(g, lambda r: F.size(r) == width)
    filled = _filled(g)
    return F.coalesce((F.size(g) >= 2) & (width >= 2) & even & (filled >= 4) & (filled >= F.floor(F.size(g) * width * 0.3)), F.lit(False))


def is_thin_band(top: Column | str, bottom: Column | str, page_height: Column | str) -> Column:
    height = F.greatest(col(bottom) - col(top), F.lit(0.0))
    return (col(page_height) > 0) & (height / col(page_height) < 0.02)


def grid_noise(grid: Column | str, caption: Column | str | None = None, top: Column | None = None, bottom: Column | None = None, page_height: Column | None = None) -> Column:
    """Why a grid holds no data: contents, index, bibliography, header or footer band; null if it may hold some."""
    g = col(grid)
    cells = F.transform(F.filter(F.flatten(g), lambda x: x.isNotNull()), lambda x: F.trim(x))
    filled = F.filter(cells, lambda x: x != "")
    last = F.filter(F.transform(g, lambda r: F.trim(F.coalesce(F.element_at(r, -1), F.lit("")))), lambda x: x != "")
    pages = F.size(F.filter(last, lambda x: x.rlike(PAGE_NUMBER)))
    cited = F.size(F.filter(filled, lambda x: x.rlike(BIBLIOGRAPHY)))
    out = F.when(F.size(g) < 3, F.lit(None).cast("string")).when(F.size(filled) == 0, "empty-cells")
    out = out.when((F.size(last) >= 5) & (pages / F.size(last) >= 0.7), "toc-or-index").when((cited >= 4) & (cited / F.size(filled) >= 0.25), "bibliography")
    if top is not None:
        small = (page_height > 0) & (F.size(g) <= 2) & (F.size(filled) < 3)
        out = F.when(small & (top < page_height * 0.08), "header-band").when(small & ((page_height - bottom) < page_height * 0.08), "footer-band").otherwise(out)
    if caption is not None:
        out = F.when(F.coalesce(col(caption).rlike(CONTENTS_CAPTION), F.lit(False)), "caption-toc-index-bib").otherwise(out)
    return out


def is_fabricated(labels: Column | str) -> Column:
    """Two placeholder labels or more among all labels and cells."""
    return F.size(F.filter(col(labels), lambda x: F.lower(F.trim(x)).isin(*PLACEHOLDERS))) >= 2


# Words that speak for a role of a class, and what each is worth.
ROLE_TERMS = {
    "relationship_like_class": (2, ("relationship", "association", "composition", "participation", "link", "role", "connection", "mapping", "correlation", "dependency", "interaction", "membership", "assignment")),
    "specification_class": (2, ("specification", "plan", "planned", "protocol", "definition", "template", "design", "instruction", "rule", "criterion", "criteria", "guideline", "schedule", "requirement")),
    "value_or_measurement_class": (2, ("value", "measurement", "quantity", "unit", "code", "status", "score", "result", "observation value", "dimension", "scale", "level", "amount", "date", "time", "interval", "duration")),
    "event_or_process_class": (2, ("event", "process", "procedure", "activity", "act", "encounter", "administration", "intervention", "assessment", "visit", "screening", "test", "collection", "observation")),
    "domain_object_class": (1, ("person", "patient", "study", "protocol", "site", "organization", "investigator", "drug", "device", "substance", "specimen", "document", "arm", "cohort", "group", "subject", "condition", "disease", "treatment", "exposure", "agent", "product")),
}
# Phrases anywhere in the text, then in the name or label, with their extra score.
ROLE_PHRASES = (("relationship_like_class", ("a relationship between",), 5), ("relationship_like_class", ("comprised of", "composed of"), 2), ("specification_class", ("specification",), 3), ("specification_class", ("planned",), 2), ("relationship_like_class", ("objectpropertyclass",), 1))
ROLE_NAMES = (("relationship_like_class", ("relationship",), 5), ("specification_class", ("specification",), 4), ("value_or_measurement_class", ("value", "measurement"), 4), ("event_or_process_class", ("event", "activity", "procedure"), 3))


def semantic_role(text: Column | str, name: Column | str) -> Column:
    """``struct<role, confidence>`` of a class from all its text and its name: the best of five weighted scores."""
    t, n = F.lower(F.coalesce(col(text), F.lit(""))), F.lower(F.coalesce(col(name), F.lit("")))
    any_of = lambda c, words: reduce(lambda a, w: a | F.contains(c, F.lit(w)), words, F.lit(False)).cast("int")
    scores = []
    for role, (worth, terms) in ROLE_TERMS.items():
        score = reduce(lambda a, w: a + t.rlike(rf"\b{w}\b").cast("int") * worth, terms, F.lit(0))
        for c, rules in ((t, ROLE_PHRASES), (n, ROLE_NAMES)):
            score = reduce(lambda a, r: a + any_of(c, r[1]) * r[2], [r for r in rules if r[0] == role], score)
        scores.append(score)
    order = F.array_sort(F.array(*scores))
    best, second = F.element_at(order, -1), F.element_at(order, -2)
    role = F.lit("unclassified_class")
    for name_, score in reversed(list(zip(ROLE_TERMS, scores, strict=True))):
        role = F.when(score == best, name_).otherwise(role)
    confidence = F.when(best == 0, "low").when(best >= second + 4, "high").when(best >= second + 2, "medium").otherwise("low")
    return F.struct(F.when(best == 0, "unclassified_class").otherwise(role).alias("role"), confidence.alias("confidence"))
