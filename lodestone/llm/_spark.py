"""Session helpers: shared scratch tables, size estimates, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest measured side, in bytes, that is ever broadcast.
BROADCAST_BYTES = 16 << 20


_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by all nodes: ``spark.checkpoint.dir``, or a local one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        found = _OWN[app]
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Spark would use for it, as other libraries need it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/+", "file:///", full)


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; costs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, settled_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows one; otherwise joins shuffle."""
    return F.broadcast(df) if settled_bytes <= most else df


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a settled table's rows: 16 a fixed-width field, real lengths for strings and binaries."""
    wide = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    fixed = F.lit(16 * len(df.columns))
    each = fixed
    for c in wide:
        each = each + F.coalesce(F.octet_length(c), F.lit(0))
    for c in arrays:
        e = dict((f.name, f.dataType) for f in df.schema.fields)[c].elementType
        if e.typeName() in ("string", "binary"):
            each = each + F.coalesce(F.aggregate(c, F.lit(0), lambda s, x: s + F.coalesce(F.octet_length(x), F.lit(0)) + 16), F.lit(0))
        else:
            each = each + F.coalesce(F.size(c), F.lit(0)) * 8
    return int(df.agg(F.coalesce(F.sum(each.cast("long")), F.lit(0)).alias("n")).head()[0])


#: Rows that travel to a Python worker at once: a few MB of text, on both sides of the pipe.
ARROW_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to what documents allow, if they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until no column of ``df`` has one of them (in either case)."""
    taken, mark = {c.lower() for c in df.columns}, "__lodestone_"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def clean(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
