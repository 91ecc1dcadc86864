"""Time: mentions in text, time instances, parents, gap filling, containment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions.text import col, let

# Months by name and by abbreviation, and the years that count.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SHORT_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
YEAR = r"(19[7-9]\d|20[0-3]\d)"
_NAMES = "|".join([*MONTHS, *SHORT_MONTHS, "sept"])

# Date patterns, most specific first; a match takes its span from those that follow.
PATTERNS = (
    ("day_iso", rf"(?i)\b{YEAR}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])\b"),
    ("day_named", rf"(?i)\b({_NAMES})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+{YEAR}\b"),
    ("month_iso", rf"(?i)\b{YEAR}-(0[1-9]|1[0-2])\b"),
    ("month_named", rf"(?i)\b({_NAMES})\.?\s+{YEAR}\b"),
    ("quarter", rf"(?i)\b(?:(Q[1-4])[\s-]?(?:FY)?{YEAR}|{YEAR}[\s-]?(Q[1-4]))\b"),
    ("year", rf"(?i)\b{YEAR}\b"),
)


def _month(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, (long, short) in enumerate(zip(MONTHS, SHORT_MONTHS, strict=True), 1):
        out = F.when(F.lower(name).isin(long, short, *(["sept"] if short == "sep" else [])), i).otherwise(out)
    return out


def masked_mentions(text: Column | str) -> Column:
    """Sorted distinct identifiers of the dates in a text, without Python.

    Each pattern's matches are blanked out before the next is tried. Texts where two patterns overlap in part
    can differ from :func:`mentions`, which claims spans; dates that don't exist give nothing in both.
    """
    number = lambda s, p, g=1: F.regexp_extract(s, p, g).try_cast("int")
    named = r"(?i)([a-z]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
    iso = lambda s: F.format_string("%s_%02d_%02d", F.regexp_extract(s, named, 3), _month(F.regexp_extract(s, named, 1)), number(s, named, 2))
    makers = {
        "day_iso": lambda s: F.when(s.try_cast("date").isNotNull(), F.concat(F.lit("DAY_"), F.replace(s, F.lit("-"), F.lit("_")))),
        "day_named": lambda s: F.when(F.replace(iso(s), F.lit("_"), F.lit("-")).try_cast("date").isNotNull(), F.concat(F.lit("DAY_"), iso(s))),
        "month_iso": lambda s: F.concat(F.lit("MONTH_"), F.replace(s, F.lit("-"), F.lit("_"))),
        "month_named": lambda s: F.format_string("MONTH_%s_%02d", F.regexp_extract(s, r"(\d{4})", 1), _month(F.regexp_extract(s, r"([A-Za-z]+)", 1))),
        "quarter": lambda s: F.format_string("Q%s_%s", F.regexp_extract(s, r"(?i)Q([1-4])", 1), F.regexp_extract(s, r"((?:19|20)\d{2})", 1)),
        "year": lambda s: F.concat(F.lit("YEAR_"), s),
    }

    def step(i: int, rest: Column, found: list[Column]) -> Column:
        kind, pattern = PATTERNS[i]
        hits = F.regexp_extract_all(rest, F.lit(f"({pattern.removeprefix('(?i)')})".replace("(", "(?i)(", 1)), F.lit(1))
        found = [*found, F.transform(hits, makers[kind])]
        if i + 1 == len(PATTERNS):
            return F.array_sort(F.array_distinct(F.array_compact(F.concat(*found))))
        return let(F.regexp_replace(rest, pattern, "#"), lambda left: step(i + 1, left, found))

    # most texts name no year, and then no date
    none = F.array().cast("array<string>")
    return let(F.coalesce(col(text), F.lit("")), lambda t: F.when(t.rlike(YEAR), step(0, t, [])).otherwise(none))


def find_mentions(text: str | None) -> list[str]:
    """Sorted identifiers of the dates in a text; a span that a pattern has claimed is closed to later ones."""
    import datetime

    claimed: list[tuple[int, int]] = []
    found: set[str] = set()
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            start, end = m.span()
            if any(start < b and end > a for a, b in claimed):
                continue
            claimed.append((start, end))
            g = m.groups()
            month = lambda name: (MONTHS.index(name.lower()) if name.lower() in MONTHS else SHORT_MONTHS.index(name.lower()[:3])) + 1
            if kind in ("day_iso", "day_named"):
                y, mo, d = (int(g[0]), int(g[1]), int(g[2])) if kind == "day_iso" else (int(g[2]), month(g[0]), int(g[1]))
                try:
                    datetime.date(y, mo, d)
                except ValueError:
                    continue
                found.add(f"DAY_{y}_{mo:02d}_{d:02d}")
            elif kind == "month_iso":
                found.add(f"MONTH_{g[0]}_{g[1]}")
            elif kind == "month_named":
                found.add(f"MONTH_{g[1]}_{month(g[0]):02d}")
            elif kind == "quarter":
                found.add(f"Q{(g[0] or g[3])[1]}_{g[1] or g[2]}")
            else:
                found.add(f"YEAR_{g[0]}")
    return sorted(found)


def mentions(text: Column | str) -> Column:
    """As :func:`find_mentions`, in Arrow batches: claiming spans needs the order of matches."""

    @F.pandas_udf("array<string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(find_mentions)

    return run(col(text))


def records(identifiers: DataFrame) -> DataFrame:
    """``(time_identifier, time_level, start_date, end_date, display_label, parent_identifier)`` of identifiers."""
    level, start = C.level_of("time_identifier"), C.start_of("time_identifier")
    rows = identifiers.select("time_identifier", level.alias("time_level"), start.alias("start_date")).where("start_date is not null").distinct()
    return rows.select("*", C.end_of("time_level", "start_date").alias("end_date"), C.label_of("time_level", "start_date").alias("display_label"), C.parent_id("time_level", "start_date").alias("parent_identifier"))


def with_parents(identifiers: DataFrame, highest: str = "year") -> DataFrame:
    """The identifiers and their parents up to a level, as ``(time_identifier)``: at most three steps, all in one pass."""
    top = C.LEVELS.index(highest)
    level, start = C.level_of("time_identifier"), C.start_of("time_identifier")
    rank = F.array_position(F.array(*map(F.lit, C.LEVELS)), level) - 1
    makers = [C.day_id(start), C.month_id(start), C.quarter_id(start), C.year_id(start)]
    chain = F.array_compact(F.array(*[F.when((F.lit(i) > rank) & (F.lit(i) <= top), m) for i, m in enumerate(makers)]))
    return identifiers.select(F.explode(F.concat(F.array("time_identifier"), chain)).alias("time_identifier")).distinct()


def fill_months(identifiers: DataFrame, lowest: str = "day") -> DataFrame:
    """The identifiers and every month between the first and the last, if months are wanted and there are two at least."""
    if lowest not in ("day", "month"):
        return identifiers.select("time_identifier").distinct()
    months = identifiers.where(C.level_of("time_identifier") == "month").select(C.start_of("time_identifier").alias("m"))
    span = months.agg(F.min("m").alias("a"), F.max("m").alias("b"), F.count_distinct("m").alias("n")).where("n >= 2")
    filled = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m")).select(C.month_id("m").alias("time_identifier"))
    return identifiers.select("time_identifier").union(filled).distinct()


def hierarchy(identifiers: DataFrame, lowest: str = "day", highest: str = "year") -> DataFrame:
    """Records of the identifiers at the wanted levels, their parents, and the months between, with parents again."""
    floor, top = C.LEVELS.index(lowest), C.LEVELS.index(highest)
    rank = F.array_position(F.array(*map(F.lit, C.LEVELS)), C.level_of("time_identifier")) - 1
    wanted = identifiers.where(rank.between(floor, top))
    return records(with_parents(fill_months(with_parents(wanted, highest), lowest), highest))


def new_edges(edges: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct edges that aren't stored."""
    return edges.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def containing(events: DataFrame, instances: DataFrame, at: str = "ts") -> DataFrame:
    """Events with every time instance whose dates hold them.

    A range join as equi-joins: an event's day, month, quarter and year each name the only instance of their level.
    """
    ids = F.explode(F.array(C.day_id(at), C.month_id(at), C.quarter_id(at), C.year_id(at))).alias("time_identifier")
    return events.select("*", ids).join(instances, "time_identifier")
