"""String functions over columns: names, slugs, IRIs, trigrams, legibility, sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common English words that share of which tells prose from glyph noise.
STOPWORDS = (
    "the", "and", "of", "to", "in", "for", "a", "is", "that", "on", "with", "as", "by", "are", "we", "our", "or", "from", "this", "be", "which", "has", "have", "not", "its", "was",
)
MIN_WORDS_TO_JUDGE = 50
LEGIBILITY_FLOOR = 0.05

# Legal suffixes of organization names, compounds first.
NAME_SUFFIXES = (
    "co ltd", "company ltd", "company limited", "holdings limited", "holdings inc", "holdings group", "holdings ltd", "group plc", "group inc", "group ltd", "incorporated", "corporation",
    "inc", "ltd", "limited", "corp", "company", "co", "holdings", "holding", "group", "plc", "ag", "gmbh", "sa", "nv", "spa", "llc", "llp", "lp", "se", "asa", "ab", "oy", "kk", "kabushiki", "pty", "bv", "kg",
)

# Words that don't count in a class label.
LABEL_STOP_TOKENS = ("the", "a", "an", "of", "and", "or")

# Units that may end a table label.
UNIT_SUFFIXES = (" usd m", " usd mn", " usd", " million", " mn", " m", " bn", " billion", " thousands", " thousand", " k", " %", " percent", " count")

# Sections of an evaluated summary and the headers that open them.
SECTIONS = {
    "CLAIMS": ("CLAIMS",),
    "EVIDENCE": ("EVIDENCE",),
    "FINDINGS": ("FINDINGS",),
    "OBSERVATIONS": ("OBSERVATIONS",),
    "EVENTS": ("EVENTS",),
    "ENTITIES": ("ENTITIES",),
    "DATES": ("DATES",),
    "REGULATORY_SAFETY_WARNINGS": ("REGULATORY", "SAFETY", "WARNINGS"),
    "LISTS": ("LISTS", "LIST COMPLETENESS"),
}

# Vocabularies that no class is minted into.
UPPER_ONTOLOGIES = (
    "http://xmlns.com/foaf/", "http://www.w3.org/ns/org", "http://www.w3.org/2004/02/skos/", "http://www.w3.org/2006/time", "http://www.w3.org/2002/07/owl",
    "http://www.w3.org/2000/01/rdf-schema", "http://www.w3.org/1999/02/22-rdf-syntax-ns", "http://www.w3.org/2001/XMLSchema", "http://purl.org/dc/",
)
OWL_THING = "http://www.w3.org/2002/07/owl#Thing"

# The parts of a label in camel case.
CAMEL = r"([A-Z]+(?=[A-Z][a-z])|[A-Z][a-z]+|[A-Z]+|[a-z]+|\d+)"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_nul(x: Column | str) -> Column:
    """The text without NUL characters."""
    return F.replace(col(x), F.lit("\x00"), F.lit(""))


def collapse_spaces(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def normalize_name(x: Column | str) -> Column:
    """Lower case, only word characters, single spaces."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(col(x), r"(?U)[^\w\s]", ""))), r"(?U)\s+", " ")


def short_forms(x: Column | str, rounds: int = 5) -> Column:
    """A normalized name and the forms left as trailing legal suffixes go one by one; at least 3 characters stay."""

    def shorter(name: Column) -> Column:
        out = F.lit(None).cast("string")
        for suffix in reversed(NAME_SUFFIXES):
            left = F.trim(F.substring(name, F.lit(1), F.length(name) - len(suffix) - 1))
            out = F.when(name.endswith(" " + suffix) & (F.length(left) >= 3), left).otherwise(out)
        return out

    forms = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        F.array(F.trim(col(x))),
        lambda acc, _: F.array_compact(F.concat(acc, F.array(shorter(F.element_at(acc, -1))))),
    )
    return F.when(F.trim(col(x)) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(forms))


def slugify(x: Column | str) -> Column:
    """Lower case, runs of other signs than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(x))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def kebab(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(x)), r"(?U)[^\w]+", "-"), r"^-+|-+$", "")


def local_name(iri: Column | str) -> Column:
    """What follows the last ``#``, else the last ``/``."""
    c = col(iri)
    return F.when(F.contains(c, F.lit("#")), F.substring_index(c, "#", -1)).otherwise(F.substring_index(c, "/", -1))


def namespace_of(iri: Column | str) -> Column:
    """The IRI up to and with the last ``#``, else the last ``/``; empty without either."""
    c = col(iri)
    return F.when(F.contains(c, F.lit("#")), F.regexp_extract(c, r"^(.*#)", 1)).otherwise(F.regexp_extract(c, r"^(.*/)", 1))


def mint_namespace(parent: Column | str, default: str) -> Column:
    """Where a child of ``parent`` is minted: beside it, but never in an upper ontology."""
    c = col(parent)
    upper = reduce(lambda a, p: a | c.startswith(p), UPPER_ONTOLOGIES, F.lit(False))
    return F.when(c.isNull() | (c == "") | (c == OWL_THING) | upper, F.lit(default)).otherwise(F.when(F.contains(c, F.lit("#")), namespace_of(c)).otherwise(F.regexp_extract(c, r"^(.*/)", 1)))


def label_tokens(x: Column | str) -> Column:
    """Sorted distinct words of a label: periods deleted, other signs blank, stop words out."""
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), r"\.", ""), r"[^a-z0-9 ]+", " ")
    return F.array_sort(F.array_distinct(F.array_except(F.split(F.trim(F.regexp_replace(cleaned, " +", " ")), " "), F.array(F.lit(""), *map(F.lit, LABEL_STOP_TOKENS)))))


def split_camel(x: Column | str) -> Column:
    """``FoodTracker`` as ``Food Tracker``; labels with a space stay."""
    c = col(x)
    tokens = F.regexp_extract_all(c, F.lit(CAMEL), F.lit(1))
    return F.when(F.contains(c, F.lit(" ")) | (F.size(tokens) == 0), c).otherwise(F.array_join(tokens, " "))


def table_label(x: Column | str) -> Column:
    """A table label without signs and without trailing units, however many."""
    plain = F.trim(F.regexp_replace(F.lower(F.trim(col(x))), r"[^a-z0-9]+", " "))
    units = "|".join(u.strip() for u in UNIT_SUFFIXES if "%" not in u)
    return F.regexp_replace(plain, rf"(?: (?:{units}))+$", "")


def trigrams(x: Column | str) -> Column:
    """Distinct trigrams of the lower-cased words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(col(x)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    """Shared trigrams by all trigrams of both; 0 without any."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_union(x, y))
    return F.when(both > 0, F.size(F.array_intersect(x, y)) / both).otherwise(F.lit(0.0))


def legibility(x: Column | str) -> Column:
    """Share of common English words among the alphabetic tokens; -1 under 50 tokens."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit(r"([a-z]{2,})"), F.lit(1))
    common = F.size(F.filter(words, lambda w: w.isin(*STOPWORDS)))
    return F.when(F.size(words) < MIN_WORDS_TO_JUDGE, F.lit(-1.0)).otherwise(common / F.size(words))


def is_legible(x: Column | str) -> Column:
    score = legibility(x)
    return (score < 0) | (score >= LEGIBILITY_FLOOR)


def section_coverage(x: Column | str) -> Column:
    """A struct of booleans: which sections have a header at the start of a line."""
    c = F.coalesce(col(x), F.lit(""))
    return F.struct(*[reduce(lambda a, b: a | b, [c.rlike(rf"(?mi)^\s*[#>*\-\s]*{alias}\b") for alias in aliases]).alias(name) for name, aliases in SECTIONS.items()])


def snippet(x: Column | str, length: int = 200) -> Column:
    return F.concat(F.substring(col(x), 1, length), F.lit("..."))


def clip(x: Column | str, cap: int = 600) -> Column:
    """One line without white space around it, of ``cap`` characters at most, then an ellipsis."""
    line = F.regexp_replace(F.regexp_replace(col(x), r"(?U)^\s+|\s+$", ""), "\n", " ")
    return F.when(F.length(line) > cap, F.concat(F.regexp_replace(F.substring(line, 1, cap), r"(?U)\s+$", ""), F.lit("..."))).otherwise(line)


def scrub_citations(x: Column | str) -> Column:
    """Text without IRIs in brackets, full or with a prefix."""
    return F.regexp_replace(col(x), r"\s*\[[A-Za-z][A-Za-z0-9_-]*:[^\]\s][^\]]*\]", "")


def first_nonblank(values: Column | str) -> Column:
    return F.get(F.filter(col(values), lambda v: F.trim(v) != ""), F.lit(0))


def embed_text(label: Column | str, *more: Column | str) -> Column:
    """The parts joined by a dash, blanks left out."""
    return F.concat_ws(" — ", *[F.when(F.trim(col(p)) != "", F.trim(col(p))) for p in (label, *more)])


def date_field(x: Column | str) -> Column:
    """``yyyy-mm-dd`` as it is, anything else null."""
    c = F.trim(col(x))
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c)


def string_field(x: Column | str) -> Column:
    return F.nullif(F.trim(col(x)), F.lit(""))


def json_text(x: Column | str) -> Column:
    """The text if it is a JSON value, else its outermost braces if they are, else null."""
    c = F.regexp_replace(F.trim(col(x)), r"^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(c).isNotNull(), c).when((inner != "") & F.try_parse_json(inner).isNotNull(), inner)


def looks_numeric(x: Column | str) -> Column:
    cleaned = F.trim(F.translate(F.coalesce(col(x), F.lit("")), ",$€£¥%()", ""))
    return F.coalesce(cleaned.try_cast("double").isNotNull(), F.lit(False)) & (cleaned != "")


def human_bytes(x: Column | str) -> Column:
    c = col(x).cast("double")
    out = F.format_string("%.0f B", c)
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(c >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(c / 1024**power, 1))).otherwise(out)  # ties go to the even digit
    return out


def safe_filename(x: Column | str, most: int = 120) -> Column:
    """A file name: other signs than words, hyphens and dots, and blanks, as underscores."""
    cleaned = F.regexp_replace(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)[^\w\s.-]+", "_"), r"(?U)\s+", "_")
    name = F.left(F.regexp_replace(cleaned, r"^[._]+|[._]+$", ""), F.lit(most))
    return F.when(name == "", F.lit("untitled")).otherwise(name)


def directory_slug(x: Column | str, most: int = 60) -> Column:
    """A folder name: lower case, words joined by hyphens."""
    words = F.lower(F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)[^\w\s-]+", "")))
    name = F.left(F.regexp_replace(F.regexp_replace(words, r"(?U)[\s_-]+", "-"), r"^-+|-+$", ""), F.lit(most))
    return F.when(name == "", F.lit("untitled")).otherwise(name)


#: HTML elements whose text isn't the page's.
UNREAD = ("script", "style", "noscript", "iframe", "form")


def html_to_text(x: Column | str) -> Column:
    """Page text without scripts, styles, frames and forms: a line per text node, blank lines no more than one by one."""
    page = F.coalesce(col(x), F.lit(""))
    for tag in UNREAD:
        page = F.regexp_replace(page, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "<x>")
    page = F.regexp_replace(page, r"(?s)<!--.*?-->", "<x>")
    page = F.regexp_replace(page, r"(?s)(?:<[^>]*>)+", "\n")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        page = F.replace(page, F.lit(entity), F.lit(sign))
    lines = F.transform(F.split(page, "\n"), lambda s: F.regexp_replace(s, r"^[ \t\r\f]+|[ \t\r\f]+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def unwrap_redirect(url: Column | str, parameter: str = "uddg") -> Column:
    """The target that a redirect link carries in a query parameter, else the link."""
    c = col(url)
    inner = F.try_url_decode(F.try_parse_url(F.when(c.startswith("//"), F.concat(F.lit("https:"), c)).otherwise(c), F.lit("QUERY"), F.lit(parameter)))
    return F.coalesce(inner, c)


def looks_like_pdf(content: Column | str) -> Column:
    return F.substring(col(content), 1, 5) == F.lit(b"%PDF-")


def year_term(x: Column | str) -> Column:
    """``YEAR_yyyy`` of the first 19xx or 20xx in a time term, else null."""
    year = F.regexp_extract(col(x), r"((?:19|20)\d{2})", 1)
    return F.when(year != "", F.concat(F.lit("YEAR_"), year))
