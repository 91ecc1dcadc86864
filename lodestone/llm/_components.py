"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import settle

_LINKS = "u long, v long"


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of these links: each node but the smallest, and the smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(node, component)`` of every node of ``links(u, v)``; component is its smallest node.

    Batches of links are first replaced by spanning stars, which keeps what is
    connected. Then large-star and small-star rounds run until nothing changes;
    each round is an aggregation with map-side combine and a join that skew
    handling can split, and is written to the shared folder. Nulls are no links;
    self links make a node its own component. Empty links: no rows.
    """
    links = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).dropna()
    alone = links.where("u = v").select("u").distinct()
    stars = settle(links.where("u <> v").mapInArrow(_local_forests, _LINKS).distinct().mapInArrow(_local_forests, _LINKS), "links")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour goes to the smallest node around
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = settle(small.where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).head()
        if now[0] == now[2] and (now[0], now[1]) == before:
            break
        before = (now[0], now[1])
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = stars.select(F.col("v").alias("node")).distinct()
    return (
        stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .union(roots.select("node", F.col("node").alias("component")))
        .union(alone.select(F.col("u").alias("node"), F.col("u").alias("component")))
        .groupBy("node").agg(F.min("component").alias("component"))
    )
