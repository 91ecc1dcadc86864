"""Views of one graph item with what hangs on it, and lists of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..operators.lifecycle import count_left, page


def list_documents(documents: DataFrame, chunks: DataFrame, status: str | None = "ACTIVE", limit: int = 50, offset: int = 0) -> DataFrame:
    """Documents of a status with their number of chunks; by name."""
    rows = documents if status is None else documents.where(F.col("status") == status)
    return page(count_left(rows, chunks, "document_id", "n_chunks"), ["title", "document_id"], limit, offset)


def document(documents: DataFrame, chunks: DataFrame, document_id: str, limit: int = 20) -> DataFrame:
    """One row a chunk of a document, in order, with its snippet."""
    rows = chunks.where(F.col("document_id") == document_id).join(documents.select("document_id", "title"), "document_id")
    return rows.select("document_id", "title", "chunk_id", "chunk_index", snippet("text").alias("snippet")).orderBy("chunk_index").limit(limit)


def entity(entity_id: str, edges: DataFrame, chunks: DataFrame, documents: DataFrame, limit: int = 20) -> DataFrame:
    """Chunks that assert something about an entity, with their documents."""
    about = edges.where((F.col("target_id") == entity_id) & (F.col("target_type") == "entity") & (F.col("predicate") == "assertsAbout") & (F.col("relationship_source") == "DOCUMENT_EXTRACTION"))
    rows = about.where("source_type = 'chunk'").select(F.col("source_id").alias("chunk_id")).distinct().join(chunks, "chunk_id").join(documents.select("document_id", "title"), "document_id")
    return rows.select("chunk_id", snippet("text").alias("snippet"), "document_id", "title").orderBy("chunk_id").limit(limit)


def ontology_class(iri: str, classes: DataFrame, entities: DataFrame, limit: int = 30) -> DataFrame:
    """``(kind, id, label)``: direct subclasses and entities of a class."""
    children = classes.where(F.exists("superclasses", lambda s: s["iri"] == iri)).select(F.lit("subclass").alias("kind"), F.col("iri").alias("id"), "label").orderBy("id").limit(limit)
    members = entities.where(F.col("class_iri") == iri).select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("name").alias("label")).orderBy("id").limit(limit)
    return children.union(members)


def artifact(artifact_id: str, sources: DataFrame, chunks: DataFrame, documents: DataFrame, edges: DataFrame, entities: DataFrame, limit: int = 20) -> DataFrame:
    """``(kind, id, text)``: source chunks and entities of an artifact."""
    from_chunks = sources.where(F.col("artifact_id") == artifact_id).select("chunk_id").distinct().join(chunks, "chunk_id").join(documents.select("document_id", "title"), "document_id")
    rows = from_chunks.select(F.lit("source").alias("kind"), F.col("chunk_id").alias("id"), snippet("text").alias("text")).orderBy("id").limit(limit)
    about = edges.where((F.col("source_id") == artifact_id) & (F.col("source_type") == "artifact") & (F.col("predicate") == "assertsAbout")).select(F.col("target_id").alias("entity_id")).distinct()
    return rows.union(about.join(entities, "entity_id").select(F.lit("entity"), "entity_id", "name"))
