"""Shared scratch tables of a session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Largest table, in bytes by the optimizer's estimate, that operators broadcast.
BROADCAST_BYTES = 16 << 20

#: Rows that a task gets of a table that ``dealt`` deals out.
TASK_ROWS = 500_000


_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all nodes share: ``spark.checkpoint.dir``; a local one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        found = _OWN[app]
    return found.rstrip("/")


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; costs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def dealt(df: DataFrame, key: str, *others: DataFrame) -> list[DataFrame]:
    """``df`` and ``others`` dealt out by ``key``, in as many partitions as the rows of ``df`` need, whatever the session's number; counts them first.

    Inner joins on ``key`` stay in these partitions; a semi-join would be moved below them.
    """
    n = max(1, -(-df.count() // TASK_ROWS))
    return [d.repartition(n, key) for d in (df, *others)]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once an application, unless their path has it."""
    package = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _SHIPPED or package.parent in on_path:
        return
    target = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
