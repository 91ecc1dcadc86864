"""Substring dedup: Rabin-Karp hashes of every fixed-length word window.

A window goes when its word sequence also starts in a document with a smaller
id. All windows of all documents are hashed, and what Spark counts for a hash is
the smallest document that has it:

1. A scan hashes every window of a batch of documents. Of the windows that share
   a hash in a batch, only those of the smallest document travel on; the others
   are decided on the spot. So a passage that a third of all documents hold
   sends one entry a batch. Entries are dealt to buckets by a second, independent
   hash and travel as packed arrays.
2. Each bucket takes the minimum document per hash and names the windows that
   start in a larger document.
3. The windows of a document, regrouped by parts of all documents, are merged into
   maximal removal intervals, and these are joined with its text.

Two windows count as equal when 78 bits of two hashes that share no base and their bucket, of 3 bits
or more of the second, agree; so the number of compared bits grows with the
number of buckets, that is, with the input: 103 at 100 TB, where some 1e13 windows meet, for an expected
1e-5 pairs taken for equal that aren't. The hashes are polynomials modulo a prime, with bases
that the driver draws for each call, so no text can be made to collide. Windows are judged on the input, not on what is left.

Defined results: null text has no words; a document of fewer words than a
window keeps all; repeated rows of one id are one document for the comparison
and each get their result; a null id is smaller than any other and each such row is
removed from nothing; ids are whole numbers (others raise an error); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import clean, plan_bytes, settle

WINDOW = 50
#: Compressed input bytes for which one bucket of window hashes is made.
BUCKET_BYTES = 4 << 20
#: Windows gathered before a scan deals them out.
FLUSH_WINDOWS = 1 << 20

_PACKED = "bucket int, hashes binary, docs binary, counts binary, starts binary"
_GONE = "part int, docs binary, counts binary, starts binary"
_SPANS = "doc_id long, spans binary"
#: Bytes of a window's two hashes that travel; its bucket adds bits.
HASH_BYTES, SECOND_BYTES = 10, 2
#: Most partitions that the buckets are dealt to.
MOST_PARTITIONS = 1 << 15


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers, mostly small, in a few bits each: zigzag, byte planes, zstd."""
    values = values.astype(np.int64)
    planes = ((values << 1) ^ (values >> 63)).view(np.uint8).reshape(-1, 8).T
    used = int(np.flatnonzero(planes.any(axis=1)).max(initial=0)) + 1
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def expand(packed: bytes) -> np.ndarray:
    """The numbers that :func:`squeeze` took."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8).reshape(packed[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : packed[0]] = raw.T
    values = out.view(np.uint64)[:, 0]
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def bucket_count(df: DataFrame) -> int:
    """A power of two in proportion to the size of ``df(doc_id, text)``: the optimizer's estimate, or measured where it has none."""
    size = plan_bytes(df)
    if size > 1 << 58:
        size = df.agg(F.coalesce(F.sum(F.octet_length(df.columns[1]).cast("long")), F.lit(0))).head()[0] // 2
    return 1 << max(3, (size // BUCKET_BYTES).bit_length())


def _in_groups(first: np.ndarray, second: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which windows with equal hashes stand together, smallest document first, and where each group starts."""
    order = np.lexsort((doc, first))
    a, b = first[order], second[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # the first hash alone doesn't part them
        order = np.lexsort((doc, second, first))
        a, b = first[order], second[order]
        same = a[1:] == a[:-1]
    return order, np.flatnonzero(np.concatenate([[True], ~(same & (b[1:] == b[:-1]))]))


def _scan(width: int, buckets: int, key: int):
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def deal(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        hashes, second, bucket, doc, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, first = _in_groups(hashes, second, doc)
        d = doc[order]
        least = np.repeat(d[first], np.diff(np.append(first, len(d))))
        here = d > least  # a smaller document of this batch has the window
        bucket[order[here]] = buckets + _deal(d[here], buckets)
        order = np.lexsort((start, doc, bucket))
        bucket, doc, start = bucket[order], doc[order], start[order]
        wide = np.empty((len(order), HASH_BYTES), np.uint8)
        wide[:, :8], wide[:, 8:] = hashes[order].view(np.uint8).reshape(-1, 8), second[order].view(np.uint8).reshape(-1, SECOND_BYTES)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        rows: list[list] = [[], [], [], [], []]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            heads = np.flatnonzero(np.concatenate([[True], doc[a + 1 : b] != doc[a : b - 1]]))
            known = bucket[a] >= buckets
            for column, value in zip(
                rows,
                (
                    int(bucket[a]) % buckets,
                    None if known else wide[a:b].tobytes(),
                    squeeze(np.diff(doc[a:b][heads], prepend=0)),
                    squeeze(np.diff(np.append(heads, b - a))),
                    squeeze(np.diff(start[a:b], prepend=0)),
                ),
                strict=True,
            ):
                column.append(value)
        for a in range(0, len(rows[0]), 64):
            yield pa.RecordBatch.from_arrays([pa.array(rows[0][a : a + 64], pa.int32()), *(pa.array(c[a : a + 64], pa.binary()) for c in rows[1:])], names=["bucket", "hashes", "docs", "counts", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = _text.utf8(batch.column(1))
            for a, b in _text.chunks(offsets):
                part = data[offsets[a] : offsets[b]]
                starts, ends, firsts = _text.words(part, offsets[a : b + 1] - offsets[a])
                at, owner = _text.window_starts(firsts, width)
                if not len(at):
                    continue
                hashes, second = (_text.window_hashes(_text.span_hashes(part, starts, ends, f, key), at, width, f, key) for f in (0, 1))
                parts.append((hashes, second.astype(np.uint16), (second >> shift).astype(np.int32), ids[a:b][owner], (at - firsts[owner]).astype(np.int32)))
                held += len(at)
                if held >= FLUSH_WINDOWS:
                    yield from deal(parts)
                    parts, held = [], 0
        if parts:
            yield from deal(parts)

    return run


def _deal(ids: np.ndarray, n: int) -> np.ndarray:
    """A bucket of ``n`` for each id."""
    return (_text.mix64(ids.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _both(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of all windows of these rows."""
    wide = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, HASH_BYTES)
    return np.ascontiguousarray(wide[:, :8]).view(np.uint64)[:, 0], np.ascontiguousarray(wide[:, 8:]).view(np.uint16)[:, 0]


def _unpacked(table: pa.Table) -> Iterator[tuple[bytes | None, np.ndarray, np.ndarray]]:
    """Hashes if there are any, document and start of the windows of each row."""
    hashes = table.column("hashes").to_pylist() if "hashes" in table.column_names else [None] * len(table)
    for h, d, c, s in zip(hashes, *(table.column(n).to_pylist() for n in ("docs", "counts", "starts")), strict=True):
        yield h, np.repeat(np.cumsum(expand(d)), expand(c)), np.cumsum(expand(s))


def _decide(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """One bucket: the windows whose hash a smaller document has, dealt to parts of the documents."""
        hashes, docs, starts, gone_doc, gone_start = [], [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for h, doc, start in _unpacked(table):
            if h is None:
                gone_doc.append(doc)
                gone_start.append(start)
            else:
                hashes.append(h)
                docs.append(doc)
                starts.append(start.astype(np.int32))
        if hashes:
            doc, start = np.concatenate(docs), np.concatenate(starts)
            order, cuts = _in_groups(*_both(hashes), doc)
            del hashes, docs, starts
            d = doc[order]
            gone = order[d > np.repeat(d[cuts], np.diff(np.append(cuts, len(d))))]
            gone_doc.append(doc[gone])
            gone_start.append(start[gone])
        doc, start = np.concatenate(gone_doc), np.concatenate(gone_start)
        part = _deal(doc, buckets)
        order = np.lexsort((start, doc, part))
        part, doc, start = part[order], doc[order], start[order]
        rows: list[list] = [[], [], [], []]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            heads = np.flatnonzero(np.concatenate([[True], doc[a + 1 : b] != doc[a : b - 1]]))
            values = int(part[a]), squeeze(np.diff(doc[a:b][heads], prepend=0)), squeeze(np.diff(np.append(heads, b - a))), squeeze(np.diff(start[a:b], prepend=0))
            for column, value in zip(rows, values, strict=True):
                column.append(value)
        return pa.table({"part": pa.array(rows[0], pa.int32()), **{n: pa.array(c, pa.binary()) for n, c in zip(("docs", "counts", "starts"), rows[1:], strict=True)}})

    return run


def _merge(width: int):
    def run(table: pa.Table) -> pa.Table:
        """One part of the documents: each one's maximal intervals."""
        parts = [(d, s) for _, d, s in _unpacked(table)]
        doc, start = np.concatenate([d for d, _ in parts]), np.concatenate([s for _, s in parts])
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
        spans = [squeeze(covered(start[a:b], width).ravel()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.table({"doc_id": pa.array(doc[cuts[:-1]], pa.int64()), "spans": pa.array(spans, pa.binary())})

    return run


def removals(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WINDOW) -> DataFrame:
    """``(doc_id, spans)``: the packed maximal removal intervals of every document that has any."""
    kept = clean(df, key, text).where(F.col(f"`{key}`").isNotNull())
    buckets = bucket_count(kept)
    packed = kept.mapInArrow(_scan(width, buckets, secrets.randbits(63)), _PACKED)
    gone = _spread(packed, "bucket", buckets).groupBy("bucket").applyInArrow(_decide(buckets), _GONE)
    return _spread(gone, "part", buckets).groupBy("part").applyInArrow(_merge(width), _SPANS)


def _spread(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """One partition a bucket, so that no task's share grows with the input; beyond the bound, buckets share partitions."""
    return df.repartitionById(buckets, F.col(column)) if buckets <= MOST_PARTITIONS else df.repartition(MOST_PARTITIONS, column)


def covered(starts: np.ndarray, width: int) -> np.ndarray:
    """Maximal intervals ``[start, end)`` of the words that any window at these sorted starts covers, as rows."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(starts) > width)
    return np.stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + width], axis=1).astype(np.int64)


def dedup(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WINDOW) -> DataFrame:
    """``(key, n_words, n_removed, kept_text, removed)``, one row per input row.

    ``removed`` lists the maximal removal intervals as word indices, end
    exclusive; ``kept_text`` joins the kept words by one space.
    """
    return _apply(df, text, key, width, "kept_text string, removed array<struct<start: long, end: long>>", lambda kept, spans: [kept.decode(), [{"start": a, "end": b} for a, b in spans.tolist()]])


def digest(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WINDOW) -> DataFrame:
    """``(key, n_words, n_removed, kept_sha256, n_intervals)``, one row per input row."""
    return _apply(df, text, key, width, "kept_sha256 string, n_intervals long", lambda kept, spans: [hashlib.sha256(kept).hexdigest(), len(spans)])


def _apply(df: DataFrame, text: str, key: str, width: int, columns: str, make) -> DataFrame:
    kept = clean(df, key, text).toDF("doc_id", "text")
    gone = settle(removals(kept, width=width), "repeats")
    # the same join at every size: what is removed grows with the input
    joined = kept.join(gone.hint("merge"), "doc_id", "left")
    schema = f"`{key}` {kept.schema[0].dataType.simpleString()}, n_words long, n_removed long, {columns}"
    names = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.utf8(batch.column(1))
            packed = batch.column(2).to_pylist()
            rows = []
            for i in range(len(batch)):
                part = data[offsets[i] : offsets[i + 1]]
                whole = part.tobytes().split()  # at the six ASCII separators
                spans = expand(packed[i]).reshape(-1, 2) if packed[i] is not None else _NONE
                spans = spans[spans[:, 1] <= len(whole)]  # rows of one id can differ in text
                removed = int((spans[:, 1] - spans[:, 0]).sum())
                if len(spans):
                    edges = [0, *spans.ravel().tolist(), len(whole)]
                    left = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in whole[a:b]]
                else:
                    left = whole
                rows.append([len(whole), removed, *make(b" ".join(left), spans)])
            table = pa.Table.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names) if rows else None
            if table is not None:
                yield from table.to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names, types = arrow.names, [f.type for f in arrow][1:]
    return joined.mapInArrow(run, schema)


_NONE = np.zeros((0, 2), np.int64)
