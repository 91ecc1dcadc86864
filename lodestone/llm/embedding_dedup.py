"""Embedding near-dedup by collision-counting projections.

Vectors of one label are compared by cosine. Equal vectors are one class with a
count; a class is projected on ``m`` orthonormal directions. For unit vectors with
cosine ``c`` or more the squared differences of all projections sum to ``2 - 2c`` at
most, so at most ``(2 - 2c) / w**2`` of them can differ by more than ``w``. Hence the
count of collisions in windows of half-width ``w`` centred on the query that loses no
pair is ``m`` minus that number: the threshold is calibrated for a recall of 1, for
whatever data. Pairs that reach it are verified in double precision.

Classes are sorted into slabs of the first projection as wide as the largest
distance of a link; only a slab and its neighbour can hold linked pairs. Slabs are
dealt into blocks of bounded size, and block meets block in one task, so a hot label
or slab is spread. Tasks return sums of links per class and a spanning forest of the
links instead of pairs. Within a label the work grows with the square of what the
projections can't keep apart; labels are the clusters that bound it.

Defined results: a vector that is null, empty, zero, or holds null or non-finite
components, and one whose label is null, links with nothing and is its own
component; vectors of different lengths don't link; repeated rows link with each
other as equal vectors do; rows with a null id
link with nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components, forest
from ._spark import clean, settle

THRESHOLD = 0.98
PROJECTIONS = 16
BLOCK = 2048
SEED = 20


def directions(dim: int, projections: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    """``(dim, m)`` orthonormal columns, m being ``projections`` or ``dim`` if that is less; equal on all machines."""
    rng = np.random.Generator(np.random.PCG64(seed + dim))
    q, r = np.linalg.qr(rng.standard_normal((dim, min(projections, dim))))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which changes no cosine, so that squares neither overflow nor vanish."""
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -power)


def calibrate(threshold: float, projections: int, most_misses: int | None = None) -> tuple[float, int]:
    """Half-width of the windows and the least count of collisions that no link can miss."""
    reach = max(2 - 2 * threshold, 0.0)
    misses = min(4 if most_misses is None else most_misses, projections // 4)
    width = float(np.sqrt(reach / (misses + 1)))
    # with misses + 1 differences above the width, their squares would sum to more than the reach
    return width * (1 + 1e-6) + 1e-6, projections - misses


def block_pairs(x: np.ndarray, split: int, threshold: float, projections: int = PROJECTIONS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with cosine at the threshold: among all rows, or across ``split`` if that isn't 0."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    h = (unit @ directions(x.shape[1], projections)).astype(np.float32)
    width, least = calibrate(threshold, h.shape[1])
    left = np.arange(split or len(x))
    # windows on the first projection: rows sorted by it, one range of partners for each run of queries
    right = np.arange(split, len(x)) if split else left
    right = right[np.argsort(h[right, 0], kind="stable")]
    left = left[np.argsort(h[left, 0], kind="stable")]
    span = np.float32(np.sqrt(max(2 - 2 * threshold, 0.0)) + 1e-5)
    found_i, found_j = [], []
    for a in range(0, len(left), 256):
        rows = left[a : a + 256]
        lo, hi = np.searchsorted(h[right, 0], [h[rows[0], 0] - span, h[rows[-1], 0] + span])
        near = right[lo:hi]
        if not len(near):
            continue
        count = np.zeros((len(rows), len(near)), np.int8)
        for p in range(h.shape[1]):
            count += np.abs(h[rows, p][:, None] - h[near, p][None, :]) <= width
        i, j = np.nonzero(count >= least)
        i, j = rows[i], near[j]
        if not split:
            i, j = i[i < j], j[i < j]
        norms = np.linalg.norm(x[i], axis=1) * np.linalg.norm(x[j], axis=1)
        ok = np.einsum("ij,ij->i", x[i], x[j]) >= threshold * norms
        found_i.append(i[ok])
        found_j.append(j[ok])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found_i or none), np.concatenate(found_j or none)


def _first_projection(projections: int, threshold: float):
    slab = max(np.sqrt(max(2 - 2 * threshold, 0.0)), 1e-3) * (1 + 1e-6)

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            firsts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            out = np.zeros(len(batch), np.int64)
            for i in range(len(batch)):
                v = scaled(values[None, firsts[i] : firsts[i + 1]])[0]
                out[i] = np.floor(v @ _axis(len(v), projections) / np.linalg.norm(v) / slab)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "slab"])

    return run


_AXES: dict[tuple[int, int], np.ndarray] = {}


def _axis(dim: int, projections: int) -> np.ndarray:
    if (dim, projections) not in _AXES:
        _AXES[dim, projections] = directions(dim, projections)[:, 0]
    return _AXES[dim, projections]


def _links(threshold: float, projections: int):
    def run(table: pa.Table) -> pa.Table:
        late = table.column("late").to_numpy()
        order = np.argsort(late, kind="stable")
        table = table.take(pa.array(order))
        split = 0 if table.column("same")[0].as_py() else int((~late).sum())
        none = np.zeros(0, np.int64)
        u, v, n = none, none, none
        if len(table) > 1 and (table.column("same")[0].as_py() or 0 < split < len(table)):
            lists = table.column("vector").combine_chunks()
            x = scaled(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1))
            ids, counts = table.column("rep").to_numpy(), table.column("n").to_numpy()
            i, j = block_pairs(x, split, threshold, projections)
            if len(i):
                total = np.zeros(len(table), np.int64)
                np.add.at(total, i, counts[j])
                np.add.at(total, j, counts[i])
                has = np.flatnonzero(total)
                a, b = forest(ids[i], ids[j])
                u, v, n = np.concatenate([ids[has], a]), np.concatenate([np.zeros(len(has), np.int64), b]), np.concatenate([total[has], np.zeros(len(a), np.int64)])
        # rows with n: links of a class; rows with n = 0: forest links
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def link(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, projections: int = PROJECTIONS) -> DataFrame:
    """One row per input row: key, ``n_links``, ``component_id``, ``kept``, ``copy_of``."""
    rows = clean(df, key, label, vector).toDF("vec_id", "label", "vector")
    numbers = F.transform("vector", lambda x: F.abs(x.cast("double")))
    sound = F.aggregate(numbers, F.lit(0.0), lambda s, x: F.when(s.isNull() | x.isNull() | F.isnan(x), F.lit(None)).otherwise(F.greatest(s, x)))
    fine = F.col("label").isNotNull() & sound.isNotNull() & (sound > 0) & (sound < float("inf"))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    reps = settle(rows.where("fine and vec_id is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    placed = settle(reps.select("label", "rep", "n", "vector").mapInArrow(_first_projection(projections, threshold), reps.select("label", "rep", "n", "vector").schema.add("slab", "long")).withColumn("dim", F.size("vector")), "slabs")
    cells = placed.groupBy("label", "dim", "slab").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).drop("m")
    after = cells.select("label", "dim", (F.col("slab") - 1).alias("slab"), F.col("blocks").alias("next"))
    before = cells.select("label", "dim", (F.col("slab") + 1).alias("slab"), F.col("blocks").alias("last"))
    cells = cells.join(after, ["label", "dim", "slab"], "left").join(before, ["label", "dim", "slab"], "left")
    dealt = placed.join(cells, ["label", "dim", "slab"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    numbers_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda slab, other, a, b: F.struct(slab.alias("slab"), other.alias("other"), a.alias("a"), b.alias("b"))
    mine = F.transform(numbers_to(F.col("blocks")), lambda o: F.struct(task(F.col("slab"), F.col("slab"), F.least(F.col("block"), o), F.greatest(F.col("block"), o)).alias("task"), (F.col("block") > o).alias("late"), (F.col("block") == o).alias("same")))
    up = F.transform(numbers_to(F.coalesce("next", F.lit(0))), lambda o: F.struct(task(F.col("slab"), F.col("slab") + 1, F.col("block"), o).alias("task"), F.lit(False).alias("late"), F.lit(False).alias("same")))
    down = F.transform(numbers_to(F.coalesce("last", F.lit(0))), lambda o: F.struct(task(F.col("slab") - 1, F.col("slab"), o, F.col("block")).alias("task"), F.lit(True).alias("late"), F.lit(False).alias("same")))
    dealt = dealt.select("label", "dim", "rep", "n", "vector", F.explode(F.concat(mine, up, down)).alias("t")).select("label", "dim", "t.task", "t.late", "t.same", "rep", "n", "vector")
    links = settle(dealt.groupBy("label", "dim", "task").applyInArrow(_links(threshold, projections), "u long, v long, n long"), "links")
    degree = links.where("n > 0").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    comps = components(links.where("n = 0").select("u", "v"))
    classes = reps.select("label", "vector", "rep", "n").join(degree, "rep", "left").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    members = rows.where("fine and vec_id is not null").join(classes, ["label", "vector"])
    linked = members.select("vec_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), F.col("rep").alias("copy_of"))
    alone = rows.where("not fine or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").alias("copy_of"))
    out = linked.union(alone)
    return out.select(F.col("vec_id").alias(key), "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"), "copy_of")
