"""Deterministic identifiers: the same key gives the same id on every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, kebab, slugify

#: Namespace of minted records; a parameter everywhere.
NAMESPACE = "https://example.org/knowledge"


def content_hash(text: Column | str) -> Column:
    return F.sha2(col(text).cast("binary"), 256)


def hash16(text: Column | str) -> Column:
    return F.left(content_hash(text), F.lit(16))


def document_iri(digest: Column | str, namespace: str = NAMESPACE) -> Column:
    return F.concat(F.lit(f"{namespace}#Document_"), F.left(col(digest), F.lit(16)))


def chunk_iri(digest: Column | str, index: Column | str, kind: str = "Chunk", namespace: str = NAMESPACE) -> Column:
    return F.format_string(f"{namespace}#{kind}_%s_%04d", F.left(col(digest), F.lit(16)), col(index).cast("int"))


def entity_iri(name: Column | str, class_iri: Column | str, namespace: str = NAMESPACE) -> Column:
    """Slug of the name, 50 characters at most, and 16 digits of a hash of name and class."""
    slug = F.left(kebab(name), F.lit(50))
    digest = F.left(F.sha2(F.concat(col(name), F.lit("|"), col(class_iri)).cast("binary"), 256), F.lit(16))
    return F.concat(F.lit(f"{namespace}#"), F.when(slug == "", F.lit("entity")).otherwise(slug), F.lit("-"), digest)


def record_iri(kind: Column | str, *key: Column | str, namespace: str = NAMESPACE) -> Column:
    """Artifacts, insights, recommendations, conversations: kind and a hash of their key."""
    parts = F.concat_ws("|", *[col(k).cast("string") for k in key])
    return F.concat(F.lit(f"{namespace}#"), col(kind), F.lit("_"), F.left(F.sha2(parts.cast("binary"), 256), F.lit(16)))


def class_iri(base: Column, label: Column | str) -> Column:
    slug = slugify(label)
    return F.concat(base, F.when(slug == "", F.lit("unnamed_class")).otherwise(slug))


def property_iri(base: Column, label: Column | str) -> Column:
    slug = slugify(label)
    return F.concat(base, F.when(slug == "", F.lit("unnamed_property")).otherwise(slug))


def table_iri(digest: Column | str, index: Column | str, namespace: str = NAMESPACE) -> Column:
    return F.format_string(f"{namespace}#Table_%s_%04d", F.left(col(digest), F.lit(16)), col(index).cast("int"))


def part_iri(table: Column | str, kind: str, *numbers: Column | str) -> Column:
    """Column, row and cell ids below a table's."""
    return F.concat_ws("_", F.concat(col(table), F.lit(f"_{kind}")), *[F.format_string("%03d", col(n).cast("int")) for n in numbers])
