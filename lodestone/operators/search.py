"""Similarity search and rank fusion: exact k-NN, rerank, neighbour joins, trigram joins, RRF."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trigrams
from ..functions.vectors import l2_distance


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def knn(df: DataFrame, probe: Column, k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """``df`` rows with the ``k`` least distances to a probe; ties by key. One top-k, no full sort."""
    return df.where(F.col(vector).isNotNull()).withColumn("distance", l2_distance(vector, probe)).orderBy("distance", key).limit(k)


def rerank(candidates: DataFrame, probes: DataFrame, k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """``(probe, key, distance, rank)``: the ``k`` nearest candidates of each of ``probes(probe, probe_vector)``.

    Probes are a query's handful of questions; each candidate meets all of them in one pass.
    """
    few = probes.select(F.collect_list(F.struct("probe", "probe_vector")).alias("_probes"))
    met = candidates.where(F.col(vector).isNotNull()).select(key, vector).join(F.broadcast(few)).select(key, vector, F.explode("_probes").alias("_p"))
    far = met.select(F.col("_p.probe").alias("probe"), key, l2_distance(vector, F.col("_p.probe_vector")).alias("distance"))
    return far.withColumn("rank", F.row_number().over(Window.partitionBy("probe").orderBy("distance", key))).where(F.col("rank") <= k)


#: Rows of a group that meet as many others in one task.
BLOCK = 1024


def _nearest(k: int):
    def run(table: pa.Table) -> pa.Table:
        """One block of queries against one block of its group: each query's ``k`` nearest, by distance, then id."""
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        rows = lambda part: np.array(part.column("vector").to_pylist(), dtype=np.float64)
        left, right = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        ids, others = left.column("_id").to_pylist(), np.array(right.column("_id").to_pylist(), dtype=object)
        a, b, far = [], [], []
        if len(left) and len(right):
            order = np.argsort(others, kind="stable")
            others, found, wanted = others[order], rows(right)[order], rows(left)
            for i, me in enumerate(ids):
                distance = np.sqrt(((found - wanted[i]) ** 2).sum(axis=1))
                distance[others == me] = np.inf
                limit = np.partition(distance, min(k, len(distance)) - 1)[min(k, len(distance)) - 1]
                near = np.flatnonzero(distance <= limit)
                near = near[np.argsort(distance[near], kind="stable")][:k]
                near = near[np.isfinite(distance[near])]
                a += [me] * len(near)
                b += others[near].tolist()
                far += distance[near].tolist()
        kind = table.column("_id").type
        return pa.table({"_a": pa.array(a, kind), "_b": pa.array(b, kind), "distance": pa.array(far, pa.float64())})

    return run


def neighbour_join(df: DataFrame, k: int, threshold: float, group: str, key: str = "id", vector: str = "embedding", block: int = BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """``(group, key, other, distance, rank)``: of each row's ``k`` nearest rows of its group, those within ``threshold``.

    First the ``k`` nearest, then the threshold. Groups are dealt into blocks of about ``block`` rows, and a block of
    queries meets a block of rows in one task, which returns ``k`` rows a query: pairs never become rows, and a hot
    group is spread. ``queries`` holds the keys to search for; by default all.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(group).alias("_g"), F.col(key).alias("_id"), F.col(vector).alias("vector"))
    sizes = rows.groupBy("_g").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    placed = rows.join(sizes, "_g").withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_n").cast("long")).cast("int"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    asking = placed if queries is None else placed.join(queries.select(F.col(key).alias("_id")), "_id", "left_semi")
    asked = asking.select("_g", F.col("_block").alias("_q"), all_blocks.alias("_d"), F.lit(True).alias("asks"), "_id", "vector")
    met = asked.unionByName(placed.select("_g", all_blocks.alias("_q"), F.col("_block").alias("_d"), F.lit(False).alias("asks"), "_id", "vector"))
    kind = rows.schema["_id"].dataType.simpleString()
    here = met.groupBy("_g", "_q", "_d").applyInArrow(_nearest(k), f"_a {kind}, _b {kind}, distance double")
    best = here.withColumn("rank", F.row_number().over(Window.partitionBy("_a").orderBy("distance", "_b"))).where((F.col("rank") <= k) & (F.col("distance") <= threshold))
    return best.join(rows.select(F.col("_g").alias(group), F.col("_id").alias("_a")), "_a").select(group, F.col("_a").alias(key), F.col("_b").alias("other"), "distance", "rank")


def rrf(lists: DataFrame, k: int = 60, key: str = "id") -> DataFrame:
    """``(key, score)`` of ``lists(list_no, key, rank)``: the sum of ``1 / (k + rank)``, best first.

    Ties go to the item that comes first when the lists are read one after the other.
    """
    fused = lists.groupBy(key).agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("_first"))
    return fused.orderBy(F.round("score", 12).desc(), "_first", key).select(key, "score")


def ranked_list(df: DataFrame, list_no: int, order: list[Column], key: str = "id") -> DataFrame:
    """One list for :func:`rrf`: rows ranked from 1 in the given order, then by key."""
    rank = F.row_number().over(Window.partitionBy(F.lit(list_no)).orderBy(*order, F.col(key)))
    return df.select(F.lit(list_no).alias("list_no"), F.col(key), rank.alias("rank"))


def trigram_join(left: DataFrame, right: DataFrame, threshold: float, left_text: str, right_text: str, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows with trigram similarity of ``threshold`` or more, with ``similarity``.

    A set-similarity join: only pairs that share a trigram of their prefix meet, the prefix being
    the rarest trigrams of which a similar pair must share one; sizes are compared before sets.
    """
    on = on or []
    a = left.select(*[F.col(c).alias(f"_on_{c}") for c in on], F.col(left_text).alias("_ta"), F.struct("*").alias("_l")).withColumn("_ga", trigrams("_ta"))
    b = right.select(*[F.col(c).alias(f"_on_{c}") for c in on], F.col(right_text).alias("_tb"), F.struct("*").alias("_r")).withColumn("_gb", trigrams("_tb"))
    counts = a.select(F.explode("_ga").alias("g")).union(b.select(F.explode("_gb").alias("g"))).groupBy("g").count()

    def prefixed(df: DataFrame, text: str, grams: str) -> DataFrame:
        texts = df.select(text, grams).distinct()
        ranked = texts.select(text, F.size(grams).alias("n"), F.explode(grams).alias("g")).join(counts, "g")
        ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(text).orderBy("count", "g")))
        return ranked.where(F.col("_r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select(text, F.col("n").alias(f"n{text}"), "g")

    pairs = prefixed(a, "_ta", "_ga").join(prefixed(b, "_tb", "_gb"), "g").where((F.least("n_ta", "n_tb") >= F.greatest("n_ta", "n_tb") * threshold)).select("_ta", "_tb").distinct()
    keys = [f"_on_{c}" for c in on]
    joined = pairs.join(a, "_ta").join(b, ["_tb", *keys])
    both = F.size(F.array_union("_ga", "_gb"))
    return joined.withColumn("similarity", F.size(F.array_intersect("_ga", "_gb")) / both).where(F.col("similarity") >= threshold).select("_l", "_r", "similarity")


def fuzzy_label_match(candidates: DataFrame, labels: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``(candidate, iri, ratio)``: for ``candidates(candidate)`` the best of ``labels(iri, label)``, both normalized.

    An equal label wins; else the best sequence-matcher ratio among labels with the same first character, if it
    reaches the threshold. The ratio has no built-in form, so it runs on Arrow batches of blocked pairs.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        import difflib

        return pd.Series([difflib.SequenceMatcher(a=x, b=y).ratio() for x, y in zip(a, b, strict=True)])

    left = candidates.where("candidate <> ''").select("candidate", F.left("candidate", F.lit(1)).alias("_c")).distinct()
    right = labels.where("label <> ''").select("iri", "label", F.left("label", F.lit(1)).alias("_c"))
    pairs = left.join(right, "_c")
    bound = 2 * F.least(F.length("candidate"), F.length("label")) / (F.length("candidate") + F.length("label"))
    scored = pairs.where(bound >= threshold).withColumn("ratio", F.when(F.col("candidate") == F.col("label"), F.lit(1.0)).otherwise(ratio("candidate", "label"))).where(F.col("ratio") >= threshold)
    best = F.row_number().over(Window.partitionBy("candidate").orderBy(F.col("ratio").desc(), "iri"))
    return scored.withColumn("_n", best).where("_n = 1").select("candidate", "iri", "ratio")


def token_set_match(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """``(candidate, iri, how)`` for ``candidates(candidate, parent)`` and ``labels(iri, label, parent)``.

    First an equal label without case, then an equal token set, then a token set that strictly holds the other
    under the same parent; the smallest iri of a kind.
    """
    from ..functions.text import label_tokens

    a = candidates.select("candidate", "parent", F.lower(F.trim("candidate")).alias("_k"), label_tokens("candidate").alias("_t"))
    b = labels.select("iri", F.col("parent").alias("_p"), F.lower(F.trim("label")).alias("_k2"), label_tokens("label").alias("_t2"))
    exact = a.join(b, F.col("_k") == F.col("_k2")).select("candidate", "parent", "iri", F.lit(1).alias("_rank"))
    same = a.where(F.size("_t") > 0).join(b, F.col("_t") == F.col("_t2")).select("candidate", "parent", "iri", F.lit(2).alias("_rank"))
    shared = a.select("candidate", "parent", "_t", F.explode("_t").alias("_w")).join(b.select("iri", "_p", "_t2", F.explode("_t2").alias("_w")), "_w").where(F.col("parent").eqNullSafe(F.col("_p")))
    common = F.size(F.array_intersect("_t", "_t2"))
    inside = shared.where((common == F.least(F.size("_t"), F.size("_t2"))) & (F.size("_t") != F.size("_t2"))).select("candidate", "parent", "iri", F.lit(3).alias("_rank"))
    found = reduce(DataFrame.union, [exact, same, inside])
    best = found.groupBy("candidate", "parent").agg(F.min(F.struct("_rank", "iri")).alias("_b"))
    return best.select("candidate", "parent", F.col("_b.iri").alias("iri"), F.element_at(F.array(F.lit("exact"), F.lit("tokens"), F.lit("containment")), F.col("_b._rank")).alias("how"))
