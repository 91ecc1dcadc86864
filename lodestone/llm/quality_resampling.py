"""Quality by importance resampling.

Two bag-of-n-grams models over hashed word unigrams and bigrams are counted: one of
target text (rows labelled good), one of the raw corpus (all rows). A document's log
weight is the log of its likelihood under the first over that under the second: the sum over its n-grams of the
log ratio of the two. Adding Gumbel noise, drawn from a hash of the document's id, and taking the ``k`` largest sums
samples ``k`` documents without replacement in proportion to their weights. A ``temperature`` (1 by
default, which is the likelihood ratio itself) divides log weights, for samples that are less sharp.

The k-th largest sum is found by narrowing histograms over all rows, so nothing is
sorted in one task and no row is left out.

Defined results: null or blank text has log weight 0; an unlabelled row is raw text
only; no target rows: all weights are 0 and the sample is uniform; rows whose sum
equals the k-th are all kept, so repeated rows stay or go together; rows with a null id are no target and share
one draw of noise; repeated ids share theirs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import clean, settle

BUCKETS = 1 << 16
#: Labelled good rows that the target model is counted over; beyond, a hash of the id decides which.
TARGET_ROWS = 200_000
_SLICES = 16
_BINS = 4096


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and the document of each."""
    starts, ends, firsts = _text.words(data, offsets)
    values = _text.span_hashes(data, starts, ends)
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    at, doc = _text.window_starts(firsts, 2)
    pairs = _text.window_hashes(values, at, 2)
    shift = np.uint64(64 - 16)
    return np.concatenate([_text.mix64(values) >> shift, pairs >> shift]).astype(np.int64), np.concatenate([owner, doc])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        data, offsets = _text.utf8(batch.column(0))
        for a, b in _text.chunks(offsets):
            bucket, doc = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            total[1] += np.bincount(bucket[target[a:b][doc]], minlength=BUCKETS)
    parts = total.reshape(2 * _SLICES, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(2 * _SLICES), pa.int32()), pa.array([p.tobytes() for p in parts])], names=["slice", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()])})


def marked(df: DataFrame, targets: DataFrame, text: str, key: str, bound: int) -> DataFrame:
    """``(text, target)`` of all rows; at most ``bound`` target ids (in expectation) are used, so they are broadcast."""
    ids = targets.select(F.col(f"`{key}`").alias("_id")).where("_id is not null").distinct()
    n = ids.count()
    if n > bound:
        ids = ids.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
    found = df.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(ids.withColumn("target", F.lit(True))), "_id", "left")
    return found.select("text", F.coalesce("target", F.lit(False)).alias("target"))


def fit(df: DataFrame, targets: DataFrame, text: str = "text", key: str = "doc_id", smoothing: float = 1.0, bound: int = TARGET_ROWS) -> np.ndarray:
    """Log ratio of the target's to the raw model's probability for each bucket; 0 without target rows."""
    counted = marked(df, targets, text, key, bound).mapInArrow(_count, "slice int, counts binary").groupBy("slice").applyInArrow(_add, "slice int, counts binary")
    found = {r[0]: bytes(r[1]) for r in counted.collect()}  # 32 rows of 32 KB
    if not found:
        return np.zeros(BUCKETS)
    raw, good = (np.frombuffer(b"".join(found[m * _SLICES + i] for i in range(_SLICES)), np.int64).astype(float) for m in (0, 1))
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log((good + smoothing) / (good + smoothing).sum()) - np.log((raw + smoothing) / (raw + smoothing).sum())


def score(df: DataFrame, ratio: np.ndarray, text: str = "text", key: str = "doc_id", seed: int = 7, temperature: float = 1.0) -> DataFrame:
    """``(key, log_weight, noisy)`` for each row; log_weight is divided by the temperature."""
    kept = clean(df, key, text)
    shared = df.sparkSession.sparkContext.broadcast(ratio)  # 512 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(len(batch))
            data, offsets = _text.utf8(batch.column(1))
            for a, b in _text.chunks(offsets):
                bucket, doc = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total[a:b] = np.bincount(doc, weights=shared.value[bucket], minlength=b - a) / temperature
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total)], names=[key, "log_weight"])

    weighted = kept.mapInArrow(run, f"`{key}` {kept.schema[0].dataType.simpleString()}, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`"), F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52)  # never 0 or 1
    return weighted.withColumn("noisy", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value: histograms over ever narrower ranges, a few thousand counts each."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).head()
    if not n or k <= 0:
        return None
    if k >= n:
        return low
    above = 0
    while low < high:
        width = (high - low) / _BINS
        if not width or low + width <= low:
            break
        inside = df.where((F.col(column) >= low) & (F.col(column) <= high))
        bins = F.least(F.floor((F.col(column) - low) / width), F.lit(_BINS - 1))
        rows = inside.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for row in rows:
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
    return low


def resample(df: DataFrame, targets: DataFrame, share: float, text: str = "text", key: str = "doc_id", seed: int = 7, temperature: float = 1.0) -> DataFrame:
    """One row per input row: key, ``log_weight``, ``noisy``, ``kept``; ``share`` of all rows is kept, as the ids of ``targets`` suggest."""
    scored = settle(score(df, fit(df, targets, text, key), text, key, seed, temperature), "scores")
    limit = kth_largest(scored, "noisy", round(share * scored.count()))
    return scored.withColumn("kept", F.col("noisy") >= F.lit(limit) if limit is not None else F.lit(False))
