"""Expanding an ontology with proposals: classes, instances, relations, grouping, placement, audit.

A class is a row ``(iri, label, parent, descriptions array<string>, origin)``. Proposals are
resolved a whole round at a time, so results don't depend on the order of proposals: within a
round the smallest label of equal token sets is minted and the others are folded into it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import class_iri, property_iri
from ..functions.shapes import is_person_name
from ..functions.text import OWL_THING, label_tokens, local_name, mint_namespace, namespace_of
from ..session import settle
from .ranking import global_rank
from .search import token_set_match

# Landforms, events named after places, and roots of geography.
LANDFORMS = (
    "strait", "island", "islands", "peninsula", "mountain", "mountains", "river", "sea", "gulf", "bay", "lake", "channel", "ocean", "continent", "archipelago", "delta", "cape", "isthmus",
    "basin", "valley", "plateau", "desert", "harbor", "harbour", "fjord", "coast", "coastline", "shore", "shoreline", "atoll", "reef", "lagoon", "estuary", "tributary",
)
EVENT_STOPS = (
    "crisis", "closure", "war", "disruption", "shortage", "conflict", "incident", "shutdown", "blockage", "attack", "sanction", "sanctions", "embargo", "dispute", "agreement", "treaty", "ban",
    "restriction", "restrictions", "escalation", "mobilization", "summit",
)
GEOGRAPHY_ROOTS = ("geographicentity", "geographicfeature", "geographic_entity", "geographic feature", "place", "spatialthing", "spatial thing", "location", "geographicarea", "geographic area")
#: Longest label of a relation's end that is minted as a class.
LONGEST_ENDPOINT = 80
#: What marks an IRI as one of the geography ontology's.
GEOGRAPHY_MARK = "ontology/geography"


def label_index(classes: DataFrame) -> DataFrame:
    """``(key, iri)``: the first class of each lower-case label or local name."""
    rows = classes.select("iri", F.explode(F.array(F.lower(F.trim("label")), F.lower(local_name("iri")))).alias("key")).where("key <> ''")
    return rows.groupBy("key").agg(F.min("iri").alias("iri"))


def safe_parent(label: Column, parent: Column) -> Column:
    """False where a geography class would get a child whose label, like the parent's name, is no landform."""
    tokens = F.split(F.lower(F.coalesce(label, F.lit(""))), r"[_\s]+")
    landform = F.arrays_overlap(tokens, F.array(*map(F.lit, LANDFORMS))) | F.lower(local_name(parent)).isin(*LANDFORMS)
    return parent.isNull() | ~F.contains(F.lower(parent), F.lit(GEOGRAPHY_MARK)) | landform


def add_classes(classes: DataFrame, proposals: DataFrame, base: str, default_parent: str | None = None, max_rounds: int = 16) -> DataFrame:
    """``classes`` with ``proposals(label, description, parent_label)`` added, ``origin`` being ``proposal`` for new rows.

    A proposal waits until its parent's label is known, at first among the classes, then among those minted in earlier
    rounds; what never resolves hangs on the default parent. A label that matches a class folds its description into it.
    """
    root = F.lit(default_parent).cast("string")
    pending = settle(proposals.select(F.trim("label").alias("label"), F.nullif(F.trim("description"), F.lit("")).alias("description"), F.nullif(F.trim("parent_label"), F.lit("")).alias("parent_label")).where("label <> ''").distinct(), "pending")
    classes = classes.select("iri", "label", "parent", "descriptions", "origin")
    for number in range(max_rounds + 1):
        if pending.isEmpty():
            break
        known = label_index(classes)
        free = F.col("parent_label").isNull() | (F.upper("parent_label") == "NONE")
        found = pending.join(known.select(F.col("key").alias("_k"), F.col("iri").alias("_p")), F.lower("parent_label") == F.col("_k"), "left")
        found = found.join(classes.select(F.col("iri").alias("_own")), F.col("parent_label") == F.col("_own"), "left").withColumn("_p", F.coalesce("_own", "_p"))
        ready = found.where(free | F.col("_p").isNotNull())
        if number == max_rounds or ready.isEmpty():  # the rest can't be placed
            ready, pending = found.withColumn("_p", F.lit(None).cast("string")), pending.limit(0)
        else:
            pending = settle(found.where(~free & F.col("_p").isNull()).select("label", "description", "parent_label"), "pending")
        parent = F.when(free | F.col("_p").isNull(), root).otherwise(F.col("_p"))
        ready = ready.select("label", "description", F.when(safe_parent(F.col("label"), parent), parent).otherwise(root).alias("parent"))
        met = token_set_match(ready.select(F.col("label").alias("candidate"), "parent").distinct(), classes.select("iri", "label", "parent"))
        pairs = ready.alias("r").join(met.alias("m"), (F.col("r.label") == F.col("m.candidate")) & F.col("r.parent").eqNullSafe(F.col("m.parent")), "left")
        ready = settle(pairs.select("r.label", "r.description", "r.parent", "m.iri"), "ready")
        fresh = ready.where("iri is null").withColumn("_t", F.array_join(label_tokens("label"), " "))
        heads = fresh.groupBy("_t").agg(F.min(F.struct("label", "parent")).alias("_h"), F.array_sort(F.collect_set("description")).alias("descriptions"))
        minted = heads.select(F.col("_h.label").alias("label"), F.col("_h.parent").alias("parent"), "descriptions").withColumn("iri", class_iri(mint_namespace("parent", base), "label"))
        minted = minted.groupBy("iri").agg(F.min("label").alias("label"), F.min("parent").alias("parent"), F.array_distinct(F.flatten(F.collect_list("descriptions"))).alias("descriptions")).join(classes.select("iri"), "iri", "left_anti")
        folded = ready.where("iri is not null and description is not null").groupBy("iri").agg(F.array_sort(F.collect_set("description")).alias("_more"))
        classes = classes.join(folded, "iri", "left").withColumn("descriptions", F.array_union(F.coalesce("descriptions", F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")
        classes = settle(classes.unionByName(minted.withColumn("origin", F.lit("proposal"))), "classes")
    return classes


def add_instances(classes: DataFrame, proposals: DataFrame, base: str) -> DataFrame:
    """``(iri, label, type_iri)`` of ``proposals(label, type_label)`` whose type is a known class; one row an IRI."""
    known = label_index(classes)
    named = proposals.where("trim(label) <> ''").withColumn("_k", F.lower(F.trim("type_label")))
    typed = named.join(known.select(F.col("key").alias("_k"), F.col("iri").alias("type_iri")), "_k")
    rows = typed.select(class_iri(F.lit(base), "label").alias("iri"), F.trim("label").alias("label"), "type_iri")
    return rows.groupBy("iri").agg(F.min("label").alias("label"), F.min("type_iri").alias("type_iri"))


def garbage(endpoint: Column | str) -> Column:
    """Ends of relations that are no names: empty, with line breaks, or too long."""
    c = F.col(endpoint) if isinstance(endpoint, str) else endpoint
    return c.isNull() | (F.trim(c) == "") | c.rlike(r"[\n\r]") | (F.length(c) > LONGEST_ENDPOINT)


def add_relations(classes: DataFrame, properties: DataFrame, proposals: DataFrame, base: str, default_parent: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes with minted ends, and ``(property_iri, label, domain_iri, range_iri)`` of ``proposals(label, domain, range)``.

    A relation reuses the property ``properties(iri, label)`` of its label; an end that names no class becomes one,
    under the other end's parent where that is safe.
    """
    wanted = proposals.where(~garbage("domain") & ~garbage("range") & (F.trim("label") != "")).select(F.trim("label").alias("label"), F.trim("domain").alias("domain"), F.trim("range").alias("range")).distinct()
    known = label_index(classes)
    parents = classes.select("iri", "parent")

    def resolved(df: DataFrame, end: str, index: DataFrame) -> DataFrame:
        return df.join(index.select(F.col("key").alias("_k"), F.col("iri").alias(f"{end}_iri")), F.lower(end) == F.col("_k"), "left").drop("_k")

    both = resolved(resolved(wanted, "domain", known), "range", known)
    for end in ("domain", "range"):
        both = both.join(parents.select(F.col("iri").alias(f"{end}_iri"), F.col("parent").alias(f"{end}_parent")), f"{end}_iri", "left")
    root = F.lit(default_parent).cast("string")
    missing = both.where("domain_iri is null").select(F.col("domain").alias("label"), F.coalesce("range_parent", root).alias("parent")).union(both.where("range_iri is null").select("range", F.coalesce("domain_parent", root)))
    missing = missing.withColumn("parent", F.when(safe_parent(F.col("label"), F.col("parent")), F.col("parent")).otherwise(root))
    minted = missing.withColumn("iri", class_iri(mint_namespace("parent", base), "label")).groupBy("iri").agg(F.min("label").alias("label"), F.min("parent").alias("parent"))
    minted = minted.select("iri", "label", "parent", F.array().cast("array<string>").alias("descriptions"), F.lit("relation").alias("origin")).join(classes.select("iri"), "iri", "left_anti")
    classes = settle(classes.select("iri", "label", "parent", "descriptions", "origin").unionByName(minted), "classes")
    index = label_index(classes)
    placed = resolved(resolved(wanted, "domain", index), "range", index).where("domain_iri is not null and range_iri is not null")
    named = properties.select(F.explode(F.array(F.lower(F.trim("label")), F.lower(local_name("iri")), F.lower("iri"))).alias("_k"), "iri").groupBy("_k").agg(F.min("iri").alias("_have"))
    out = placed.join(named, F.lower("label") == F.col("_k"), "left").select(F.coalesce("_have", property_iri(F.lit(base), "label")).alias("property_iri"), "label", "domain_iri", "range_iri")
    return classes, out.distinct()


def orphans(classes: DataFrame, base: str) -> DataFrame:
    """Classes of the default namespace without a parent of their own."""
    return classes.where(F.col("iri").startswith(base) & (F.col("parent").isNull() | (F.col("parent") == OWL_THING)))


def apply_grouping(classes: DataFrame, concepts: DataFrame, assignments: DataFrame, base: str, default_parent: str | None = None) -> DataFrame:
    """Orphans of ``assignments(class_label, concept_label)`` put under ``concepts(label, description)``, which are minted where missing."""
    known = label_index(classes).select(F.col("key").alias("_k"), F.col("iri").alias("_have"))
    wanted = concepts.where("trim(label) <> ''").select(F.trim("label").alias("label"), F.coalesce("description", F.lit("")).alias("description")).join(known, F.lower("label") == F.col("_k"), "left")
    minted = wanted.where("_have is null").groupBy(class_iri(F.lit(base), "label").alias("iri")).agg(F.min("label").alias("label"), F.array_sort(F.collect_set("description")).alias("descriptions"))
    minted = minted.join(classes.select("iri"), "iri", "left_anti").select("iri", "label", F.lit(default_parent).cast("string").alias("parent"), "descriptions", F.lit("concept").alias("origin"))
    whole = settle(classes.select("iri", "label", "parent", "descriptions", "origin").unionByName(minted), "grouped")
    index = label_index(whole)
    pairs = assignments.join(index.select(F.col("key").alias("_a"), F.col("iri")), F.lower(F.trim("class_label")) == F.col("_a")).join(index.select(F.col("key").alias("_b"), F.col("iri").alias("_to")), F.lower(F.trim("concept_label")) == F.col("_b"))
    moves = pairs.where("iri <> _to").groupBy("iri").agg(F.min("_to").alias("_to"))
    loose = (F.col("parent").isNull() | (F.col("parent") == OWL_THING)) & (F.coalesce("origin", F.lit("")) != "concept")
    return whole.join(moves, "iri", "left").withColumn("parent", F.when(loose & F.col("_to").isNotNull(), F.col("_to")).otherwise(F.col("parent"))).drop("_to")


def place_landforms(classes: DataFrame, exempt: tuple[str, ...] = ("geography", "w3.org/2006/time")) -> DataFrame:
    """``(old, new, parent, signal)``: parentless classes named after a landform, and where they belong.

    The keyword is the alphabetically first of a label's; its class is the parent, else a root of geography. A class
    moves to its parent's namespace unless something is there already.
    """
    local = F.lower(local_name("iri"))
    words = F.array_distinct(F.concat(F.split(local, r"[_\s]+"), F.split(F.regexp_replace(F.lower("label"), r"[^a-z0-9 ]+", " "), r"\s+")))
    named = classes.select("iri", "label", "parent", local.alias("_local"), words.alias("_words"))
    homes = named.where(F.col("_local").isin(*LANDFORMS))
    plural = homes.where(F.col("_local").endswith("s")).select(F.regexp_replace("_local", "s$", "").alias("_kw"), "iri").where(F.col("_kw").isin(*LANDFORMS))
    homes = homes.select(F.col("_local").alias("_kw"), "iri").union(plural).groupBy("_kw").agg(F.min("iri").alias("_home"))
    flat = F.array(F.replace("_local", F.lit("_"), F.lit("")), F.replace(F.lower("label"), F.lit(" "), F.lit("")))
    root = F.broadcast(named.where(F.arrays_overlap(flat, F.array(*map(F.lit, GEOGRAPHY_ROOTS)))).agg(F.min("iri").alias("_root")))
    outside = reduce(lambda a, m: a & ~F.contains(F.lower(namespace_of("iri")), F.lit(m)), exempt, F.lit(True))
    loose = F.col("parent").isNull() | (F.col("parent") == OWL_THING)
    hits = F.array_sort(F.array_intersect("_words", F.array(*map(F.lit, LANDFORMS))))
    found = named.where(outside & loose & ~F.arrays_overlap("_words", F.array(*map(F.lit, EVENT_STOPS)))).withColumn("_kw", F.get(hits, F.lit(0))).where("_kw is not null")
    singular = F.regexp_replace("_kw", "s$", "")
    found = found.join(homes, "_kw", "left").join(homes.select(F.col("_kw").alias("_one"), F.col("_home").alias("_home1")), singular == F.col("_one"), "left").join(root)
    found = found.withColumn("_parent", F.coalesce("_home", "_home1", "_root")).where("_parent is not null and _parent <> iri")
    found = found.withColumn("_new", F.concat(namespace_of("_parent"), local_name("iri")))
    taken = classes.select(F.col("iri").alias("_new"), F.lit(True).alias("_taken"))
    return found.join(taken, "_new", "left").select(F.col("iri").alias("old"), F.when(F.col("_taken"), F.col("iri")).otherwise(F.col("_new")).alias("new"), F.col("_parent").alias("parent"), F.concat(F.lit("landform:"), "_kw").alias("signal"))


def move(classes: DataFrame, moves: DataFrame) -> DataFrame:
    """Classes after ``moves(old, new, parent)``; references to a moved class follow it."""
    m = moves.select(F.col("old").alias("iri"), F.col("new").alias("_new"), F.col("parent").alias("_parent"))
    out = classes.join(m, "iri", "left").withColumn("parent", F.coalesce("_parent", "parent")).withColumn("iri", F.coalesce("_new", "iri")).drop("_new", "_parent")
    refs = moves.select(F.col("old").alias("parent"), F.col("new").alias("_new"))
    return out.join(refs, "parent", "left").withColumn("parent", F.coalesce("_new", "parent")).drop("_new").select(*classes.columns)


def apply_audit(classes: DataFrame, decisions: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """Classes and ``(iri, label, type_iri)`` instances after ``decisions(iri, action, new_parent)``.

    KEEP keeps, RE_HOME changes the parent, CONVERT_TO_INSTANCE makes an instance. A person's name under a person or
    role becomes an instance of Person whatever was decided. Parents that don't exist are minted.
    """
    label_of = classes.select(F.col("iri").alias("parent"), F.lower("label").alias("_pl"))
    rows = classes.join(label_of, "parent", "left").join(decisions.select("iri", F.upper(F.trim("action")).alias("_do"), F.nullif(F.trim("new_parent"), F.lit("")).alias("_to")), "iri", "left")
    person = is_person_name("label") & F.coalesce(F.regexp_replace("_pl", " ", "").isin("person", "personrole", "role"), F.lit(False))
    rows = rows.withColumn("_do", F.when(person, "CONVERT_TO_INSTANCE").otherwise(F.coalesce("_do", F.lit("KEEP")))).withColumn("_to", F.when(person, "Person").otherwise(F.col("_to")))
    rows = settle(rows.withColumn("_do", F.when(F.col("_to").isNull(), "KEEP").otherwise(F.col("_do"))), "audit")
    index = label_index(classes)
    targets = rows.where("_do <> 'KEEP'").select("_to").distinct().join(index.select(F.col("key").alias("_k"), F.col("iri").alias("_ti")), F.lower("_to") == F.col("_k"), "left")
    targets = targets.withColumn("_minted", F.col("_ti").isNull()).withColumn("_ti", F.coalesce("_ti", class_iri(F.lit(base), "_to"))).select("_to", "_ti", "_minted")
    rows = rows.join(targets, "_to", "left")
    kept = rows.where("_do <> 'CONVERT_TO_INSTANCE'").withColumn("parent", F.when(F.col("_do") == "RE_HOME", F.col("_ti")).otherwise(F.col("parent"))).select(*classes.columns)
    fresh = targets.where("_minted").groupBy(F.col("_ti").alias("iri")).agg(F.min("_to").alias("label")).select("iri", "label", F.lit(None).cast("string").alias("parent"), F.array().cast("array<string>").alias("descriptions"), F.lit("audit").alias("origin"))
    return kept.unionByName(fresh.select(*classes.columns)), rows.where("_do = 'CONVERT_TO_INSTANCE'").select("iri", "label", F.col("_ti").alias("type_iri"))


def coerce_labels(rows: DataFrame, column: str, canonical: dict[str, str], known: DataFrame) -> DataFrame:
    """Labels of a column replaced by their canonical IRI where that IRI is known; others stay."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(k.lower(), v) for k, v in canonical.items()], "_k string, iri string").join(known.select("iri"), "iri", "left_semi").select("_k", F.col("iri").alias("_iri"))
    return rows.join(F.broadcast(table), F.lower(F.trim(column)) == F.col("_k"), "left").withColumn(column, F.coalesce("_iri", column)).drop("_k", "_iri")


def promote_entities(proposals: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Proposals that are classes, and those that look like entities with the reason, from one tagged table."""
    tagged = settle(proposals.withColumn("reason", reason), "tagged")
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")


def cached(keys: DataFrame, store: DataFrame, make, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Results of ``keys`` from a cache table, made where it lacks them; and the rows to append to the cache."""
    missing = keys.join(store.select(key), key, "left_anti")
    made = settle(make(missing), "made")
    return store.join(keys.select(key).distinct(), key, "left_semi").unionByName(made.select(*store.columns)), made


def batches_of(rows: DataFrame, n: int, key: str) -> DataFrame:
    """Rows with a ``batch`` number, ``n`` rows each in order of key."""
    return global_rank(rows, [(key, False)], "batch").withColumn("batch", F.floor((F.col("batch") - 1) / n).cast("int"))
