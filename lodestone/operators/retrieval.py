"""From seeds to candidates: hits, bridges, constraint groups, evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions.text import clip
from .ranking import global_rank


def hits(edges: DataFrame, matched: DataFrame, limit: int | None = 500, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """``(source, hits)``: sources by their number of edges to ``matched(target)``, most first."""
    out = edges.join(matched.select(target).distinct(), target, "left_semi").groupBy(source).agg(F.count("*").alias("hits"))
    return out if limit is None else out.orderBy(F.col("hits").desc(), source).limit(limit)


def typed_edges(edges: DataFrame, **wanted: str) -> DataFrame:
    """Edges whose columns have the given values."""
    return edges.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in wanted.items()], F.lit(True)))


def tables_of_documents(chunks: DataFrame, candidates: DataFrame, tables: DataFrame, limit: int = 50) -> DataFrame:
    """``(table_id, document_id, hits)``: tables of the documents that candidate chunks come from, by the chunks they have.

    A chunk counts once for a document however often it is listed. Repeats go after the match, so that only matched chunks
    are aggregated; unless candidates are few, chunks meet them in as many tasks as their rows need.
    """
    found, rows = candidates.select("chunk_id").distinct(), chunks.select("chunk_id", "document_id")
    if session.plan_bytes(found) > session.BROADCAST_BYTES:
        rows, found = session.dealt(rows, "chunk_id", found)
    docs = rows.join(found, "chunk_id").distinct().groupBy("document_id").agg(F.count("*").alias("hits"))
    return tables.join(docs, "document_id").select("table_id", "document_id", "hits").orderBy(F.col("hits").desc(), "table_id", "document_id").limit(limit)


def fulltext_bridge(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(chunk_id, hits, kind)``: candidates ``(chunk_id, hits)`` swapped for full text where their document has it.

    A document's full-text chunks take the sum of its candidates' hits; summaries stay for other documents.
    """
    full = chunks.where("kind = 'fulltext'")
    scored = candidates.join(chunks.select("chunk_id", "document_id", "kind"), "chunk_id")
    per_doc = scored.groupBy("document_id").agg(F.sum("hits").alias("hits"))
    swapped = full.select("chunk_id", "document_id").join(per_doc, "document_id").select("chunk_id", "hits", F.lit("fulltext").alias("kind"))
    kept = scored.where("kind <> 'fulltext'").join(full.select("document_id").distinct(), "document_id", "left_anti").select("chunk_id", "hits", "kind")
    return swapped.unionByName(kept)


def prefer_fulltext(chunks: DataFrame) -> DataFrame:
    """Full-text chunks if there are any, else all."""
    any_full = F.broadcast(chunks.agg(F.coalesce(F.max(F.col("kind") == "fulltext"), F.lit(False)).alias("_any")))
    return chunks.join(any_full).where("kind = 'fulltext' OR NOT _any").drop("_any")


def in_every_group(edges: DataFrame, groups: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """``source`` with an edge to at least one target of each group of ``groups(group_no, target)``."""
    n = F.broadcast(groups.agg(F.count_distinct("group_no").alias("_n")))
    met = edges.join(groups, target).groupBy(source).agg(F.count_distinct("group_no").alias("_met"))
    return met.join(n).where("_met = _n").select(source)


def append_absent(lists: list[DataFrame], key: str) -> DataFrame:
    """Lists one after the other, each ``(key, position)``, every key at its first place, as ``(key, list_no, position)``."""
    rows = reduce(DataFrame.unionByName, [d.select(key, "position").withColumn("list_no", F.lit(i)) for i, d in enumerate(lists)])
    return rows.groupBy(key).agg(F.min(F.struct("list_no", "position")).alias("_p")).select(key, "_p.list_no", "_p.position")


def pack_evidence(chunks: DataFrame, artifacts: DataFrame, cap: int = 600) -> DataFrame:
    """``(rank, kind, id, score, snippet)``: chunks by score, then artifacts by score; texts clipped to one line."""
    part = lambda df, n, kind: df.select(F.lit(n).alias("_part_no"), F.lit(kind).alias("kind"), "id", "score", clip("text", cap).alias("snippet"))
    both = part(chunks, 0, "chunk").unionByName(part(artifacts, 1, "artifact"))
    return global_rank(both, [("_part_no", False), ("score", True), ("id", False)]).select("rank", "kind", "id", "score", "snippet")


def wants_probes(intent: str, n_entities: int, cap: int = 8) -> bool:
    """Whether a question gets one probe an entity: comparisons and enumerations of three entities or more."""
    return intent in ("comparison", "enumeration") and n_entities >= 3 and cap > 0


def probe_texts(question: DataFrame, expanded: DataFrame, entities: DataFrame, cap: int = 8) -> DataFrame:
    """``(probe, text)``: the question, expansions, then entities; the first of equal texts without case, ``cap`` entities."""
    rows = question.select(F.lit(0).alias("part"), F.lit(0).alias("n"), "text")
    rows = rows.union(expanded.select(F.lit(1), "n", "text")).union(entities.where(F.col("n") < cap).select(F.lit(2), "n", "text"))
    key = F.lower(F.trim("text"))
    first = rows.where(key != "").groupBy(key.alias("k")).agg(F.min(F.struct("part", "n", "text")).alias("r"))
    return first.select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("r.part", "r.n")).alias("probe"), F.col("r.text").alias("text"))
