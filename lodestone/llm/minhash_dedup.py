"""MinHash near-dedup with weighted DartMinHash signatures.

A document is a weighted set of word shingles. Darts are thrown into the region of
every element (its weight times the axis of ranks): their ranks form a Poisson
process that hashes of the element alone decide, and a hash deals each dart to one
of the signature's coordinates. A coordinate keeps its earliest dart, so two
documents agree there with the probability of their weighted Jaccard similarity. Only
the first ``ln t + 4`` darts a coordinate are thrown; a document left with an empty
coordinate throws twice as many.

Bands of coordinates are joined. Documents with equal weighted sets are one class
from the start and share a representative; representatives that share a band are
candidates, and every link is verified on the full sets:

1. each candidate is verified against the smallest document of its bands and
   against the first documents that most of its bands name (stars, not pairs);
2. components of these links are found;
3. what is left are bands whose documents lie in different components. A document
   of which less than the threshold occurs in other components can have no link and
   goes. The rest is compared within each band, block against block as matrix
   products inside a task, between components only.

So every pair that shares a band ends up in one component or has been verified not
to be a link, though no group is expanded into rows of pairs.

Defined results: null text, or text without words, is a class of its own; a text
shorter than a shingle is one shingle; repeated rows share a class; a row with a null
id gets null columns; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._components import components, forest
from ._spark import broadcast_if_small, clean, measured_bytes, settle, unused

WIDTH = 5
THRESHOLD = 0.8
#: 32 bands of 4: a pair at 0.8 is missed with probability 5e-8.
BANDS, ROWS = 32, 4
_DOCS_AT_ONCE = 256
#: Documents of a block, and cells of all its documents (in expectation).
BLOCK, BLOCK_CELLS = 1024, 1 << 20
#: Parts that a band's documents are dealt to where they meet the band's size.
SALTS = 16
#: Distinct cells that a block's matrix product takes at once.
COLUMNS = 1 << 12
_ONE = np.uint64(1)


def weighted_cells(data: np.ndarray, offsets: np.ndarray, width: int, weighting: str, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted unit cells of each document's elements, and each document's first.

    ``count`` gives an element as many cells as the document has copies of the shingle, so
    overlap of cells is the weighted Jaccard similarity; ``set`` gives it one.
    """
    values, firsts = _text.shingles(data, offsets, width, family)
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    order = np.lexsort((values, owner))
    values = values[order]
    new = np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])]) if len(values) else np.zeros(0, bool)
    if weighting == "set":
        values, owner = values[new], owner[new]
    else:
        heads = np.flatnonzero(new)
        copy = _text.ranks(np.diff(np.append(heads, len(values)))).astype(np.uint64)
        values = np.where(copy > 0, _text.mix64(values + copy * np.uint64(0x9E3779B97F4A7C15)), values)
        order = np.lexsort((values, owner))
        values = values[order]
    return values, np.searchsorted(owner, np.arange(len(offsets)))


def signatures(cells: np.ndarray, firsts: np.ndarray, size: int) -> np.ndarray:
    """DartMinHash of unit cells: ``(documents, size)`` hashes of the earliest darts; a document without cells gives zeros."""
    n = len(firsts) - 1
    out = np.zeros((n, size), dtype=np.uint64)
    for a in range(0, n, _DOCS_AT_ONCE):
        b = min(a + _DOCS_AT_ONCE, n)
        out[a:b] = _throw(cells[firsts[a] : firsts[b]], firsts[a : b + 1] - firsts[a], size)
    return out


def _throw(cells: np.ndarray, firsts: np.ndarray, size: int) -> np.ndarray:
    weight = np.diff(firsts)
    n = len(weight)
    earliest = np.full(n * size, np.inf)
    dart = np.zeros(n * size, dtype=np.uint64)
    reach, open_ = (math.log(size) + 4) / np.maximum(weight, 1), np.flatnonzero(weight)
    while len(open_):
        expected = size * reach[open_]
        group = np.maximum(np.ceil(np.log2(expected)), 0).astype(np.int64)
        for g in np.unique(group).tolist():
            docs = open_[group == g]
            sizes = weight[docs]
            owner = np.repeat(docs, sizes)
            cell = cells[np.repeat(firsts[docs], sizes) + _text.ranks(sizes)]
            limit, base, step = reach[owner], np.zeros(len(owner)), 0
            block = 1 << g
            while len(cell):
                number = np.arange(step + 1, step + 1 + block, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
                ids = _text.mix64(cell[:, None] + number)
                gaps = np.log((ids >> np.uint64(11)).astype(np.float64) + 0.5) - 53 * math.log(2)
                ranks = base[:, None] - np.cumsum(gaps, axis=1) / size
                hit, which = np.nonzero(ranks <= limit[:, None])
                ids, rank = _text.mix64(ids[hit, which]), ranks[hit, which]
                at = owner[hit] * size + (ids % np.uint64(size)).astype(np.int64)
                np.minimum.at(earliest, at, rank)
                first = rank == earliest[at]
                dart[at[first]] = ids[first] | _ONE
                more = ranks[:, -1] <= limit
                cell, owner, limit, base = cell[more], owner[more], limit[more], ranks[more, -1]
                step += block
        full = np.isfinite(earliest.reshape(n, size)[open_]).all(axis=1)
        open_ = open_[~full]
        reach[open_] *= 2
        earliest.reshape(n, size)[open_] = np.inf
    return dart.reshape(n, size)


_MULTIPLIERS = _text.mix64(np.arange(1, 1 + 64, dtype=np.uint64)) | _ONE


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """``(documents, bands)``: a hash of each band's coordinates and its number."""
    parts = signature.reshape(len(signature), bands, rows)
    return _text.mix64((parts * _MULTIPLIERS[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def _cells_of(batch: pa.RecordBatch, width: int, weighting: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = _text.utf8(batch.column(1))
    for a, b in _text.chunks(offsets):
        yield a, b, *weighted_cells(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, weighting)


def _sum(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return total[firsts[1:]] - total[firsts[:-1]]


def sign(df: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, weighting: str = "count") -> DataFrame:
    """``(doc_id, size, k1, k2, bands)`` of ``df(doc_id, text)``; k1 and k2 are a 128-bit digest of the weighted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.utf8(batch.column(1))
            for a, b, cells, firsts in _cells_of(batch, width, weighting):
                hashes = band_hashes(signatures(cells, firsts, bands * rows), bands, rows)
                # the second half of the digest comes from hashes that share nothing with the first
                again = weighted_cells(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, weighting, 1)
                keys = [_sum(_text.mix64(x), f).view(np.int64) for x, f in ((cells, firsts), again)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(hashes.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(firsts).astype(np.int64)), *map(pa.array, keys), lists], names=["doc_id", "size", "k1", "k2", "bands"])

    return df.mapInArrow(run, "doc_id long, size long, k1 long, k2 long, bands array<long>")


def _with_cells(df: DataFrame, width: int, weighting: str) -> DataFrame:
    """``(doc_id, size, cells)``; cells packed as sorted 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, cells, firsts in _cells_of(batch, width, weighting):
                packed = [cells[x:y].tobytes() for x, y in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
                for i in range(0, b - a, 256):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a + i, min(256, b - a - i)), pa.array(np.diff(firsts)[i : i + 256].astype(np.int64)), pa.array(packed[i : i + 256], pa.binary())], names=["doc_id", "size", "cells"])

    return df.mapInArrow(run, "doc_id long, size long, cells binary")


def _verified(pairs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(u, v)`` whose similarity reaches the threshold."""
    side = lambda n: cells.select(F.col("doc_id").alias(n), F.col("size").alias(f"{n}_size"), F.col("cells").alias(f"{n}_cells"))
    joined = pairs.join(side("v"), "v").join(side("u"), "u").where(F.least("u_size", "v_size") >= threshold * F.greatest("u_size", "v_size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.searchsorted(x, y, side="right") - np.searchsorted(x, y, side="left")
                shared = int(both.sum())
                keep.append(shared >= threshold * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("u", "v", "u_cells", "v_cells").mapInArrow(run, "u long, v long")


def block_links(ids: np.ndarray, comps: np.ndarray, cells: list[np.ndarray], split: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between components among these documents; with ``split``, only across it."""
    sizes = np.array([len(c) for c in cells])
    owner = np.repeat(np.arange(len(cells)), sizes)
    values, column = np.unique(np.concatenate(cells), return_inverse=True)
    counts = np.bincount(column)
    column, owner = column[counts[column] > 1], owner[counts[column] > 1]
    shared = np.zeros((len(cells), len(cells)), np.float32)
    number = np.cumsum(counts > 1) - 1
    n = int((counts > 1).sum())
    at = number[column]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for a in range(0, n, COLUMNS):  # bounded memory whatever the texts
        lo, hi = np.searchsorted(at, [a, a + COLUMNS])
        part = np.zeros((len(cells), min(COLUMNS, n - a)), np.float32)
        part[owner[lo:hi], at[lo:hi] - a] = 1
        shared += part @ part.T
    ok = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-6
    ok &= comps[:, None] != comps[None, :]
    i, j = np.nonzero(np.triu(ok, 1))
    if split:
        cross = (i < split) & (j >= split)
        i, j = i[cross], j[cross]
    return forest(ids[i], ids[j]) if len(i) else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _between(members: DataFrame, comps: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Links between components among the documents of each band, as pairs of components."""
    placed = members.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select("band")
    placed = settle(placed.join(mixed, "band"), "mixed")
    # a document needs the threshold's share of its cells in other components
    docs = placed.select(F.col("rep").alias("doc_id"), "component").distinct().join(cells, "doc_id")
    numbers = _numbers(docs)
    several = numbers.groupBy("cell").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select("cell")
    able = numbers.join(several, "cell").groupBy("doc_id", "size").count().where(F.col("count") >= F.col("size") * threshold).select(F.col("doc_id").alias("rep"))
    able = settle(able.join(cells.select(F.col("doc_id").alias("rep"), "size"), "rep"), "able")
    placed = placed.join(able, "rep")
    sizes = placed.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("cells"), F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.ceil(F.col("cells") / BLOCK_CELLS), F.col("n"))).cast("int")
    sizes = sizes.select("band", blocks.alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = placed.withColumn("salt", F.pmod(F.shiftright(F.xxhash64("rep"), 40), F.lit(SALTS)).cast("int")).join(sizes, ["band", "salt"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    # a block meets itself and every later block
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other")).alias("task"), (F.col("block") > F.col("other")).alias("late"), (F.col("block") == F.col("other")).alias("same"), "rep", "component")
    full = dealt.join(cells.select(F.col("doc_id").alias("rep"), "cells"), "rep")

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("late").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        late = int((~table.column("late").to_numpy()).sum())
        packed = [np.frombuffer(x, np.uint64) for x in table.column("cells").to_pylist()]
        split = 0 if table.column("same")[0].as_py() else late
        comps = table.column("component").to_numpy()
        u, v = block_links(np.arange(len(packed)), comps, packed, split, threshold) if len(packed) > 1 else (np.zeros(0, np.int64),) * 2
        return pa.table({"u": comps[v], "v": comps[u]})

    return full.groupBy("task").applyInArrow(run, "u long, v long").where("u <> v")


def _numbers(docs: DataFrame) -> DataFrame:
    """``(doc_id, component, size, cell)``: the packed cells as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                values = np.frombuffer(batch.column(3)[i].as_buffer(), np.int64)
                for a in range(0, len(values), 1 << 16):
                    part = values[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(part), batch.column(c)[i].as_py(), np.int64)) for c in range(3)), pa.array(part)], names=["doc_id", "component", "size", "cell"])

    return docs.select("doc_id", "component", "size", "cells").mapInArrow(run, "doc_id long, component long, size long, cell long")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weighting: str = "count") -> DataFrame:
    """One row per input row: key, ``copy_of`` (smallest id with an equal set), ``class_id`` (smallest id of its component), ``kept``."""
    docs = clean(df, key, text).toDF("doc_id", "text")
    known = docs.withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id is not null")
    signed = settle(sign(known, width, bands, rows, weighting), "signed")
    reps = settle(signed.where("size > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "reps")
    rows_ = reps.select("rep", F.explode("bands").alias("band"))
    shared = rows_.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("center")).where("n > 1").select("band", "center")
    members = settle(rows_.join(shared, "band"), "members")
    wanted = settle(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    chosen = known.join(broadcast_if_small(wanted, measured_bytes(wanted)), "doc_id", "left_semi")
    cells = settle(_with_cells(chosen, width, weighting).groupBy("doc_id").agg(F.first("size").alias("size"), F.first("cells").alias("cells")), "cells")
    votes = members.where("center < rep").groupBy("rep", "center").agg(F.count("*").alias("n")).groupBy("rep").agg(F.min("center").alias("a"), F.max_by("center", F.struct("n", -F.col("center"))).alias("b"))
    stars = votes.select(F.col("a").alias("u"), F.col("rep").alias("v")).union(votes.where("a <> b").select("b", "rep"))
    links = settle(_verified(stars, cells, threshold), "links")
    comps = settle(components(links), "components")
    between = settle(_between(members, comps, cells, threshold), "between")
    if not between.isEmpty():  # components of components
        top = components(between).select(F.col("node").alias("component"), F.col("component").alias("_top"))
        # a document that no star links is a component without a row
        nodes = comps.select("node", "component").union(between.select("u").union(between.select("v")).distinct().join(comps.select(F.col("node").alias("u")), "u", "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component")))
        comps = settle(nodes.join(top, "component", "left").select("node", F.coalesce("_top", "component").alias("component")), "classes")
    copies = signed.where("size > 0").join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).select("doc_id", "rep")
    classes = copies.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", F.col("rep").alias("copy_of"), F.coalesce("component", "rep").alias("class_id"))
    alone = signed.where("size = 0").select("doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"))
    nulls = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("copy_of"), F.lit(None).cast("long").alias("class_id"))
    return classes.union(alone).union(nulls).select(F.col("doc_id").alias(key), "copy_of", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``df`` with one document of each class, the one with the smallest id; rows of a null id stay.

    Of repeated rows of one id one stays: the first by their text.
    """
    removed, again = unused(df, "gone", "again")
    gone = settle(near_duplicates(df, text, key, **options).where("not kept").select(F.col(key).alias(removed)).distinct(), "gone")
    left = df.join(broadcast_if_small(gone, measured_bytes(gone)), F.col(f"`{key}`") == F.col(removed), "left_anti")
    repeated = settle(left.select(F.col(f"`{key}`").alias(again)).where(F.col(again).isNotNull()).groupBy(again).count().where("count > 1").select(again), "repeated")
    if repeated.isEmpty():
        return left
    same = F.col(f"`{key}`") == F.col(again)
    (rank,) = unused(df, "rank")
    once = left.join(repeated, same, "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy(f"`{key}`").orderBy(F.col(f"`{text}`")))).where(F.col(rank) == 1).drop(rank)
    return left.join(repeated, same, "left_anti").unionByName(once)
