"""Mixing sources to target weights by entropy balancing.

Rates closest to 1 in relative entropy (weighted by words) subject to each
source's target of words are exponential tilts ``exp(lambda_source)``. The dual is
convex; every source's multiplier is found by safeguarded Newton steps, all sources
at once, as a column expression over the table of sources. That table is the
aggregate of the documents and is never collected.

Rates become whole copies by rounding with carried error: the sizes of a source are
taken from the largest down; of each, as many documents get one copy more as come
nearest to the words that their fractional rates ask for and what earlier sizes left
over. So a source misses its target by about half of its smallest document, if small ones
are there to make up. It needs one row for each size of a source; the documents of a
size that get the copy are chosen within salts of it, so that neither a hot source nor
a third of all rows with one size lands in one task.

Defined results: null or blank text has size 0 and takes nothing; a null source is
a source of its own, sorted last; repeated rows count and are rounded each; an empty
table gives no rows; other columns are kept out.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import broadcast_if_small, clean, measured_bytes, settle, unused

#: Weights of the sources in order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: A document is used this often at most.
MOST_COPIES = 3
SALTS = 256
NEWTON_STEPS = 60


def n_words(text: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``position``, 0-based by code point, null last, without a one-task sort.

    Ranges of names are sorted apart; the ranges' counts, one per partition, give the offsets.
    """
    key = F.when(F.col("source").isNull(), F.lit(1)).otherwise(F.lit(0))
    hexed = F.hex(F.encode(F.coalesce("source", F.lit("")), "UTF-8"))  # bytes of UTF-8 sort as code points
    spread = settle(sources.withColumn("_null", key).withColumn("_hex", hexed).repartitionByRange("_null", "_hex").withColumn("_part", F.spark_partition_id()), "sources")
    counts = {r[0]: r[1] for r in spread.groupBy("_part").count().collect()}  # one row per partition
    offsets, total = [], 0
    for part in sorted(counts):
        offsets += [F.lit(part), F.lit(total)]
        total += counts[part]
    offset = F.create_map(*offsets)[F.col("_part")] if offsets else F.lit(0)
    window = Window.partitionBy("_part").orderBy("_null", "_hex")
    return spread.withColumn("position", (F.row_number().over(window) - 1 + offset).cast("long")).drop("_null", "_hex", "_part")


def waterfill(sources: DataFrame, weight: Column, most: float = MOST_COPIES) -> DataFrame:
    """``sources(source_size, ...)`` with ``target``: shares of the whole by weight, at most ``most`` times the size.

    The excess of a stopped source is shared by weight among the others until none is
    above. A source stops when the level ``target / weight`` passes its
    ``most * size / weight``. Each round is one aggregate of two numbers.
    """
    sources = sources.withColumn("_weight", weight.cast("double"))
    total = float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).head()[0])
    level, stop = -1.0, most * F.col("source_size")
    while True:
        stopped = stop <= F.lit(level) * F.col("_weight")
        fixed, weights = sources.agg(
            F.coalesce(F.sum(F.when(stopped, stop)), F.lit(0)).cast("double"), F.coalesce(F.sum(F.when(~stopped, F.col("_weight"))), F.lit(0)).cast("double")
        ).head()
        now = (total - fixed) / weights if weights else level
        if now <= level:
            break
        level = now
    target = F.least(stop.cast("double"), F.lit(level) * F.col("_weight"))
    return sources.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0))).drop("_weight")


def multiplier(size: Column, target: Column) -> Column:
    """Minimiser of the dual ``size * exp(x) - target * x`` by Newton steps of length 1 at most."""
    step = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), target / (size * F.exp(x)) - 1))
    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), lambda x, _: x + step(x))


def source_rates(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``(source, source_size, target, rate)`` of ``docs(source, size)``; rate is the tilt ``exp(lambda)``."""
    sources = ranked(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    filled = waterfill(sources, weight, most)
    size, target = F.col("source_size").cast("double"), F.col("target")
    rate = F.when((size > 0) & (target > 0), F.least(F.lit(float(most)), F.round(F.exp(multiplier(size, target)), 12))).otherwise(F.lit(0.0))
    return settle(filled.select("source", "source_size", "target", rate.alias("rate")), "rates")


def _shuffled(key: str) -> Column:
    """A number in [0, 2**60) that stands for a random order of keys."""
    return F.conv(F.left(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(15)), 16, 10).cast("long")


def _carry(table: pa.Table) -> pa.Table:
    """One source's sizes: how many documents of each get a copy more."""
    table = table.sort_by([("size", "descending")])
    left, more = 0.0, []
    for size, n, rate in zip(*(table.column(c).to_pylist() for c in ("size", "n", "rate")), strict=True):
        wanted = n * (rate - math.floor(rate)) * size + left
        more.append(max(0, min(n, math.floor(wanted / size + 0.5))) if size else 0)
        left = wanted - more[-1] * size
    return pa.table({"_key": table.column("_key"), "size": table.column("size"), "more": pa.array(more, pa.int64())})


def copies(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """``docs(doc_id, source, size)`` with ``source_size``, ``target``, ``rate`` and whole ``copies``."""
    docs = docs.withColumn("_order", _shuffled("doc_id")).withColumn("_salt", (F.shiftright("_order", 7) % SALTS).cast("int")).withColumn("_key", _key("source"))
    rates = rates.withColumn("_key", _key("source")).drop("source")
    cells = docs.groupBy("_key", "size", "_salt").agg(F.count("*").alias("n"))
    sizes = cells.groupBy("_key", "size").agg(F.sum("n").alias("n")).join(rates, "_key")
    rounded = sizes.select("_key", "size", "n", "rate").groupBy("_key").applyInArrow(_carry, "_key string, size long, more long")
    sizes = sizes.withColumnRenamed("n", "all").join(rounded, ["_key", "size"])
    by_salt = Window.partitionBy("_key", "size").orderBy("_salt")
    reach = F.floor(F.sum("n").over(by_salt.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(20,0)") * F.col("more").cast("decimal(18,0)") / F.col("all").cast("decimal(20,0)")).cast("long")
    cells = cells.join(sizes, ["_key", "size"]).withColumn("_reach", reach)
    cells = cells.withColumn("extra", F.col("_reach") - F.coalesce(F.lag("_reach").over(by_salt), F.lit(0)))
    cells = cells.select("_key", "size", "_salt", "extra", "source_size", "target", "rate")
    rank = F.row_number().over(Window.partitionBy("_key", "size", "_salt").orderBy("_order", "doc_id"))
    found = docs.withColumn("_rank", rank).join(cells, ["_key", "size", "_salt"])
    whole = F.floor("rate") + F.when(F.col("_rank") <= F.col("extra"), 1).otherwise(0)
    return found.withColumn("copies", whole.cast("long")).drop("_key", "_salt", "_order", "_rank", "extra")


def _key(column: str) -> Column:
    """Null and any string as different keys."""
    return F.concat(F.when(F.col(column).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(column), F.lit("")))


def _mixed(df: DataFrame, text: str, source: str, key: str, weights: tuple[float, ...]) -> DataFrame:
    docs = settle(clean(df, key, source, text).select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), n_words(text).alias("size")), "sizes")
    return copies(docs, source_rates(docs, weights))


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per input row: key, size, source_size, target, taken, copies, rate."""
    found = _mixed(df, text, source, key, weights)
    return found.select(F.col("doc_id").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def resample(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``df`` with each row repeated as often as its mix takes it (0 to 3 times); columns stay.

    Rows meet their copies by key, size and source. Where rows that share these differ in copies, as many of them
    as in the mix get one more, first by text.
    """
    name, size, origin, low, high, n_high, copy = unused(df, "key", "size", "source", "low", "high", "n_high", "copy")
    found = _mixed(df, text, source, key, weights).select(F.col("doc_id").alias(name), F.col("size").alias(size), F.col("source").alias(origin), "copies")
    # copies of one size and source differ by one at most
    counted = found.groupBy(name, size, origin).agg(F.min("copies").alias(low), F.max("copies").alias(high), (F.sum("copies") - F.count("*") * F.min("copies")).alias(n_high))
    counted = settle(counted.where(F.col(high) > 0), "copies")
    counted = broadcast_if_small(counted, measured_bytes(counted))
    same = F.col(f"`{key}`").eqNullSafe(F.col(name)) & (n_words(text) == F.col(size)) & F.col(f"`{source}`").eqNullSafe(F.col(origin))
    columns = [F.col(f"`{c}`") for c in df.columns]
    repeat = lambda rows, n: rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*columns)
    torn = F.col(low) < F.col(high)
    if counted.where(torn).isEmpty():
        return repeat(df.join(counted, same), F.col(low))
    whole = repeat(df.join(counted.where(~torn), same), F.col(low))
    rank = F.row_number().over(Window.partitionBy(name, size, origin).orderBy(F.col(f"`{text}`"), F.to_json(F.struct(*columns))))
    shared = df.join(counted.where(torn), same).withColumn(copy, rank)
    return whole.union(repeat(shared.withColumn(low, F.col(low) + F.when(F.col(copy) <= F.col(n_high), 1).otherwise(0)), F.col(low)))
