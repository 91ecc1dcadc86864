"""Question to evidence: seeds, traversal, candidates, rerank, fusion, packing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import bfs
from ..operators.retrieval import hits
from ..operators.search import ranked_list, rerank, rrf

#: Rows that a mode returns; artifacts get half.
TOP_K = {"simple_qa": 20, "deep_research": 30, "artifact_only": 40}


@dataclass(frozen=True)
class Store:
    """What a question is asked of.

    ``edges(source_type, source_id, target_type, target_id)``;
    ``items(id, node_type, text, embedding)`` are what can be evidence.
    """

    edges: DataFrame
    items: DataFrame


def retrieve(store: Store, seeds: DataFrame, probes: DataFrame, mode: str = "simple_qa", max_hops: int = 2, decay: float = 0.5, k: int = 60) -> DataFrame:
    """``(id, score, text)``: the best evidence by reciprocal rank fusion.

    Lists are one rerank per probe of the items that the walk reaches, and the items by their number of edges to the
    nodes reached. Walk scores decide membership only.
    """
    top = TOP_K[mode]
    reached = bfs(store.edges, seeds, max_hops, decay)
    near = reached.select("node_type", F.col("node_id").alias("id"))
    candidates = store.items.join(near, ["node_type", "id"], "left_semi")
    nearest = rerank(candidates, probes, 3 * top).select((F.col("probe") + 1).alias("list_no"), "id", "rank")
    linked = hits(store.edges.select(F.col("source_id"), F.struct("target_type", "target_id").alias("target")), reached.select(F.struct(F.col("node_type").alias("target_type"), F.col("node_id").alias("target_id")).alias("target")), limit=3 * top, target="target")
    coverage = ranked_list(linked.select(F.col("source_id").alias("id"), "hits").join(candidates.select("id"), "id", "left_semi"), 1_000, [F.col("hits").desc()])
    fused = rrf(nearest.unionByName(coverage), k).limit(top)
    return fused.join(store.items.select("id", "text"), "id").orderBy(F.col("score").desc(), "id")
