"""Clusters of findings, layered rollups, and what insights and recommendations start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import record_iri
from ..session import settle
from .graph import components
from .search import neighbour_join

#: Order in which members of a cluster are read.
BY_CONFIDENCE = ("confidence", "id")


def clusters(artifacts: DataFrame, threshold: float = 0.35, k: int = 25, least: int = 2, group: str = "type", key: str = "id", vector: str = "embedding") -> DataFrame:
    """``(key, cluster)``: components of neighbour links of one type with at least ``least`` members."""
    links = neighbour_join(artifacts, k, threshold, group, key, vector).select(F.col(key).alias("a"), F.col("other").alias("b"))
    comps = settle(components(links), "clusters")
    large = comps.groupBy("component").count().where(F.col("count") >= least).select("component")
    return comps.join(large, "component").select(F.col("node").alias(key), F.col("component").alias("cluster"))


def batches(members: DataFrame, most: int = 30, least: int = 2, confidence: str = "confidence", key: str = "id") -> DataFrame:
    """Members with ``batch``: clusters in order of confidence, cut every ``most``; a tail shorter than ``least`` goes."""
    n = F.row_number().over(Window.partitionBy("cluster").orderBy(F.coalesce(F.col(confidence), F.lit(0)).desc(), key))
    cut = members.withColumn("batch", F.floor((n - 1) / most).cast("int"))
    sizes = cut.groupBy("cluster", "batch").count().where(F.col("count") >= least).select("cluster", "batch")
    return cut.join(sizes, ["cluster", "batch"])


def merged_text(texts: Column) -> Column:
    """The offline merge: distinct texts in order, joined."""
    return F.array_join(F.array_sort(F.array_distinct(texts)), " ")


def inherit_edges(edges: DataFrame, parents: DataFrame, predicates: tuple[str, ...] = ("assertsAbout", "summarizes")) -> DataFrame:
    """Distinct ``(source_id, predicate, target_id)`` that rollups take over from ``parents(child_id, parent_id)``."""
    wanted = edges.where(F.col("predicate").isin(*predicates))
    return wanted.join(parents, wanted.source_id == parents.child_id).select(F.col("parent_id").alias("source_id"), "predicate", "target_id").distinct()


def layers(artifacts: DataFrame, embed: Callable[[Column], Column], n_layers: int = 2, base: int = 0, merge: Callable[[Column], Column] = merged_text, threshold: float = 0.35, k: int = 25, most: int = 30, least: int = 2, type_name: str = "Rollup") -> DataFrame:
    """Rollups of ``artifacts(id, type, text, confidence, embedding)``, layer upon layer: those and ``layer, members``.

    Layer ``base + s`` is made from layer ``base + s - 1``; it ends where no cluster is left.
    """
    source, made = artifacts.select("id", "type", "text", "confidence", "embedding"), []
    for step in range(1, n_layers + 1):
        found = clusters(source, threshold, k, least).join(source, "id")
        cut = batches(found, most, least)
        rows = cut.groupBy("cluster", "batch").agg(F.first("type").alias("type"), F.array_sort(F.collect_list("id")).alias("members"), merge(F.collect_list("text")).alias("text"), F.avg("confidence").alias("confidence"))
        rows = rows.select(record_iri(F.lit(type_name), F.lit(base + step), F.array_join(F.col("members").cast("array<string>"), ",")).alias("id"), "type", "text", "confidence", embed(F.col("text")).alias("embedding"), F.lit(base + step).alias("layer"), F.col("members").cast("array<string>").alias("members"))
        rows = settle(rows, "layer")
        if rows.isEmpty():
            break
        made.append(rows)
        source = rows.select("id", "type", "text", "confidence", "embedding")
    if not made:
        return artifacts.limit(0).select(F.col("id").cast("string"), "type", "text", F.col("confidence").cast("double"), "embedding", F.lit(0).alias("layer"), F.array().cast("array<string>").alias("members"))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def insight_groups(links: DataFrame, used: DataFrame | None, least: int = 3) -> DataFrame:
    """``(class_id, n)``: classes with ``least`` rows of ``links(class_id, entity_id, artifact_id)``, best first, those in ``used`` aside.

    Rows count, not artifacts: an artifact on two entities of a class counts twice.
    """
    rows = links if used is None else links.join(used.select("class_id").distinct(), "class_id", "left_anti")
    return rows.groupBy("class_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def top_members(members: DataFrame, group: str, n: int = 25, confidence: str = "confidence", recent: str | None = None, key: str = "id") -> DataFrame:
    """Each group's ``n`` rows of the highest confidence, then the latest, then the smallest key."""
    order = [F.coalesce(F.col(confidence), F.lit(0)).desc(), *([F.col(recent).desc()] if recent else []), F.col(key)]
    return members.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def recommendation_inputs(insights: DataFrame, references: DataFrame, n: int = 15, least: int = 2) -> DataFrame:
    """The ``n`` best insights that no ``references(insight_id)`` names; none if there are fewer than ``least``."""
    free = insights.join(references.select(F.col("insight_id").alias("id")).distinct(), "id", "left_anti")
    best = free.orderBy(F.coalesce("confidence", F.lit(0)).desc(), "id").limit(n)
    return best.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1)))).where(F.col("_n") >= least).drop("_n")


def next_layer(artifacts: DataFrame) -> int:
    """One more than the highest layer."""
    return artifacts.agg(F.coalesce(F.max(F.col("layer").cast("int")), F.lit(0))).head()[0] + 1
