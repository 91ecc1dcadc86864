"""Documents to a graph: ingest, time, entities, findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import chunk_iri, document_iri, record_iri
from ..functions.text import normalize_name, strip_nul
from ..hooks import Hooks
from ..operators.chunking import chunk
from ..operators.resolution import dedup_documents, link_by_substring, name_dictionary
from ..operators.timeline import hierarchy, mentions

# Predicates by their short names.
PREDICATES = (
    "subClassOf", "equivalentClass", "disjointWith", "type", "chunkOf", "hasChunk", "derivedFromChunk", "derivedFromDocument", "summarizes", "assertsAbout",
    "hasIntelligenceArtifact", "referencesChunk", "referencesArtifact", "insightBasedOn", "recommendationBasedOn", "hasTime", "intervalDuring", "intervalContains", "monthOfYear", "before", "after",
)
EDGE = ["source_type", "source_id", "predicate", "target_type", "target_id", "relationship_source"]


@dataclass
class Graph:
    documents: DataFrame
    chunks: DataFrame
    times: DataFrame
    findings: DataFrame
    edges: DataFrame


def edge(df: DataFrame, source_type: str, source: str, predicate: str, target_type: str, target: str, origin: str) -> DataFrame:
    """Distinct edge rows of one kind."""
    if predicate not in PREDICATES:
        raise ValueError(f"unknown predicate: {predicate}")
    return df.select(F.lit(source_type).alias("source_type"), F.col(source).alias("source_id"), F.lit(predicate).alias("predicate"), F.lit(target_type).alias("target_type"), F.col(target).alias("target_id"), F.lit(origin).alias("relationship_source")).distinct()


def ingest(documents: DataFrame, size: int = 800, overlap: int = 120, separator: str = "\n\n", hooks: Hooks | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents ``(doc_id, text)`` without copies, their chunks with embeddings, and chunk edges."""
    hooks = hooks or Hooks()
    clean = documents.select("doc_id", strip_nul("text").alias("text")).where(F.trim("text") != "")
    firsts = dedup_documents(clean).where("not is_duplicate").select("doc_id", "content_hash")
    docs = clean.join(firsts, "doc_id").withColumn("document_id", document_iri("content_hash"))
    chunks = chunk(docs, "text", size, overlap, separator).withColumn("chunk_id", chunk_iri("content_hash", "chunk_index"))
    chunks = chunks.select("chunk_id", "document_id", "chunk_index", F.col("chunk_text").alias("text"), "token_count").withColumn("embedding", hooks.embed(F.col("text")))
    return docs, chunks, edge(chunks, "chunk", "chunk_id", "chunkOf", "document", "document_id", "DOCUMENT_EXTRACTION")


def enrich_time(chunks: DataFrame, lowest: str = "day", highest: str = "year") -> tuple[DataFrame, DataFrame]:
    """Time instances of the chunks and the edges to and among them."""
    found = chunks.select("chunk_id", F.explode(mentions("text")).alias("time_identifier"))
    times = hierarchy(found.select("time_identifier").distinct(), lowest, highest)
    has = edge(found.join(times.select("time_identifier"), "time_identifier", "left_semi"), "chunk", "chunk_id", "hasTime", "time", "time_identifier", "TIME_ENRICHMENT")
    inside = times.where("parent_identifier is not null").join(times.select(F.col("time_identifier").alias("parent_identifier")), "parent_identifier", "left_semi")
    return times, has.union(edge(inside, "time", "time_identifier", "intervalDuring", "time", "parent_identifier", "TIME_ENRICHMENT"))


def link_entities(chunks: DataFrame, entities: DataFrame, most_words: int | None = None) -> DataFrame:
    """Edges from chunks to the entities of a gazetteer ``(entity_id, name)`` that their texts name.

    Word n-grams of a chunk, of the lengths that the gazetteer's names have (``most_words`` at most, if given), meet the
    names and short forms by an equi-join.
    """
    names = name_dictionary(entities.select("entity_id", normalize_name("name").alias("normalized")))
    words = chunks.select("chunk_id", F.split(normalize_name("text"), " ").alias("w"))
    lengths = sorted(n for (n,) in names.where("variant is not null").select(F.size(F.split("variant", " "))).distinct().collect() if most_words is None or n <= most_words)  # one row a length
    grams = F.flatten(F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))))
    met = words.select("chunk_id", F.explode(F.array_distinct(grams)).alias("variant")).join(names, "variant")
    return edge(met, "chunk", "chunk_id", "assertsAbout", "entity", "entity_id", "DOCUMENT_EXTRACTION")


def findings(chunks: DataFrame, entities: DataFrame | None = None, mentions: DataFrame | None = None, hooks: Hooks | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of each chunk and their edges to the chunk and to entities that they name."""
    hooks = hooks or Hooks()
    rows = chunks.select("chunk_id", "document_id", F.posexplode(hooks.findings(F.col("text"))).alias("n", "text"))
    rows = rows.select(record_iri(F.lit("Finding"), "chunk_id", "n").alias("artifact_id"), "chunk_id", "document_id", "text", F.lit("ACTIVE").alias("status"))
    edges = edge(rows, "artifact", "artifact_id", "derivedFromChunk", "chunk", "chunk_id", "LLM_INFERENCE")
    if entities is not None and mentions is not None:
        named = mentions.select(F.col("source_id").alias("chunk_id"), F.col("target_id").alias("entity_id")).join(entities.select("entity_id", "name"), "entity_id")
        edges = edges.union(edge(link_by_substring(rows, named, "chunk_id", "text", "name"), "artifact", "artifact_id", "assertsAbout", "entity", "entity_id", "LLM_INFERENCE"))
    return rows, edges


def build_graph(documents: DataFrame, entities: DataFrame, hooks: Hooks | None = None, size: int = 800, overlap: int = 120, separator: str = "\n\n") -> Graph:
    """All passes over a document folder."""
    docs, chunks, edges = ingest(documents, size, overlap, separator, hooks)
    times, time_edges = enrich_time(chunks)
    mentions = link_entities(chunks, entities)
    found, found_edges = findings(chunks, entities, mentions, hooks)
    return Graph(docs, chunks, times, found, edges.union(time_edges).union(mentions).union(found_edges))
