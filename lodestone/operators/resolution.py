"""Deduplication and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import content_hash, entity_iri
from ..functions.text import normalize_name, short_forms
from .search import trigram_join


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; an aggregate with map-side combine, not a sort of each group."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def dedup_documents(df: DataFrame, text: str = "text", key: str = "doc_id", stored: DataFrame | None = None) -> DataFrame:
    """``(key, content_hash, first_id, is_duplicate)``: exact copies by SHA-256; the smallest id of a text is kept.

    With ``stored(content_hash)`` a text that is stored already is a duplicate too. Texts themselves aren't shuffled.
    """
    hashed = df.select(key, content_hash(text).alias("content_hash"))
    firsts = hashed.groupBy("content_hash").agg(F.min(key).alias("first_id"))
    out = hashed.join(firsts, "content_hash")
    known = F.lit(False)
    if stored is not None:
        out = out.join(stored.select("content_hash").distinct().withColumn("_known", F.lit(True)), "content_hash", "left")
        known = F.coalesce("_known", F.lit(False))
    return out.select(key, "content_hash", "first_id", ((F.col(key) != F.col("first_id")) | known).alias("is_duplicate"))


def resolve(mentions: DataFrame, store: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``(name, class_iri, normalized, entity_id, how)`` for ``mentions(name, class_iri)`` against ``store(entity_id, normalized, class_iri)``.

    Equal normalized name and class: that entity. Else the most similar stored name of the class by trigrams, if it
    reaches the threshold. Else a new entity, one for each normalized name and class.
    """
    named = mentions.withColumn("normalized", normalize_name("name")).where("normalized <> ''")
    keys = named.groupBy("normalized", "class_iri").agg(F.min("name").alias("name"))
    kept = store.groupBy("normalized", "class_iri").agg(F.min("entity_id").alias("entity_id"))
    exact = keys.join(kept, ["normalized", "class_iri"], "left")
    misses = exact.where("entity_id is null").select("normalized", "class_iri")
    similar = trigram_join(misses, kept, threshold, "normalized", "normalized", ["class_iri"])
    best = similar.groupBy(F.col("_l.normalized").alias("normalized"), F.col("_l.class_iri").alias("class_iri")).agg(F.min_by(F.col("_r.entity_id"), F.struct(-F.col("similarity"), F.col("_r.entity_id"))).alias("_near"))
    found = exact.join(best, ["normalized", "class_iri"], "left")
    how = F.when(F.col("entity_id").isNotNull(), "exact").when(F.col("_near").isNotNull(), "fuzzy").otherwise("new")
    ids = found.select("normalized", "class_iri", F.coalesce("entity_id", "_near", entity_iri("name", "class_iri")).alias("entity_id"), how.alias("how"))
    return named.join(ids, ["normalized", "class_iri"]).select("name", "class_iri", "normalized", "entity_id", "how")


def name_dictionary(entities: DataFrame) -> DataFrame:
    """``(variant, entity_id)`` of ``entities(entity_id, normalized)``: names and short forms that mean one entity.

    A full name beats a short form of another entity; a short form of several entities means none, nor does a full
    name of several.
    """
    forms = entities.select("entity_id", "normalized", F.explode(short_forms("normalized")).alias("variant"))
    kinds = forms.withColumn("full", F.col("variant") == F.col("normalized"))
    counted = kinds.groupBy("variant").agg(
        F.count_distinct(F.when(F.col("full"), F.col("entity_id"))).alias("n_full"),
        F.min(F.when(F.col("full"), F.col("entity_id"))).alias("full_id"),
        F.count_distinct("entity_id").alias("n"),
        F.min("entity_id").alias("id"),
    )
    chosen = F.when(F.col("n_full") == 1, F.col("full_id")).when((F.col("n_full") == 0) & (F.col("n") == 1), F.col("id"))
    return counted.select("variant", chosen.alias("entity_id")).where("entity_id is not null")


def link_by_name(strings: DataFrame, dictionary: DataFrame, text: str) -> DataFrame:
    """Rows of ``strings`` with the entity that their normalized text names."""
    return strings.withColumn("variant", normalize_name(text)).join(dictionary, "variant").drop("variant")


def link_by_substring(artifacts: DataFrame, entities: DataFrame, on: str, text: str, name: str) -> DataFrame:
    """Pairs of the same ``on`` key where the lower-cased text holds the lower-cased name."""
    joined = artifacts.join(entities, on)
    return joined.where(F.contains(F.lower(text), F.lower(name)) & (F.trim(name) != ""))


def validate_class(mentions: DataFrame, offered: DataFrame, keys: list[str]) -> DataFrame:
    """Mentions whose class was offered for them."""
    return mentions.join(offered.select(*keys).distinct(), keys, "left_semi")


def merge_suggestions(proposals: DataFrame, suggestions: DataFrame, label: str = "label") -> DataFrame:
    """Proposals and those suggestions whose label, case aside, isn't proposed."""
    known = proposals.select(F.lower(F.trim(label)).alias("_k")).distinct()
    fresh = suggestions.withColumn("_k", F.lower(F.trim(label))).join(known, "_k", "left_anti")
    once = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(label))).where("_n = 1").drop("_k", "_n")
    return proposals.unionByName(once, allowMissingColumns=True)
