"""Positions in a total order without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def global_rank(df: DataFrame, order: list[tuple[str, bool]], alias: str = "rank") -> DataFrame:
    """``df`` with its 1-based position by ``order``, pairs of a column and whether it descends; nulls first ascending.

    Rows are dealt to ranges of the order and numbered within each; the ranges' counts, one number a
    partition, give the offsets.
    """
    by: list[Column] = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
    dealt = settle(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = sorted((r[0], r[1]) for r in dealt.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets += [F.lit(part), F.lit(total)]
        total += n
    offset = F.create_map(*offsets)[F.col("_part")] if offsets else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return dealt.withColumn(alias, (rank + offset).cast("long")).drop("_part")
