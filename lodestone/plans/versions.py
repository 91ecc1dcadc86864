"""Version folders: tables with a manifest, named by the second."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import local_name


def version_name(taken: set[str], now: datetime.datetime | None = None) -> str:
    """``vYYYYmmddTHHMMSSZ``, with ``-1`` to ``-99`` where it is taken."""
    now = now or datetime.datetime.now(datetime.UTC)
    name = now.strftime("v%Y%m%dT%H%M%SZ")
    for candidate in (name, *(f"{name}-{i}" for i in range(1, 100))):
        if candidate not in taken:
            return candidate
    raise RuntimeError(f"{name}: no free version name")


def write_version(tables: dict[str, DataFrame], folder: str, manifest: dict) -> None:
    """Each table as Parquet, and a one-row manifest with their row counts."""
    counts = {name: df.count() for name, df in tables.items()}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(manifest | {"counts": counts}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/manifest")


def read_version(spark: SparkSession, folder: str, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    manifest = json.loads(spark.read.text(f"{folder}/manifest").head()[0])
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}, manifest


def section_counts(tables: dict[str, DataFrame]) -> dict[str, int]:
    return {k: v.count() for k, v in tables.items()}


def repaired(classes: DataFrame, project: str, foreign: tuple[str, ...], canonical: tuple[str, ...]) -> DataFrame:
    """``(old, new)``: classes squatting in a foreign vocabulary, whose local name isn't canonical there, and their project IRIs."""
    away = F.lit(False)
    for prefix in foreign:
        away = away | F.col("iri").startswith(prefix)
    return classes.where(away & ~local_name("iri").isin(*canonical)).select(F.col("iri").alias("old"), F.concat(F.lit(project), local_name("iri")).alias("new"))
