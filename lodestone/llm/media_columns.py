"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded with blanks to a multiple of 192, become the samples
of an 8-bit grey PNG image of width 192 (lossless, so the payload comes back
unchanged). Every task appends its images to tar shards in a folder that all nodes
share; a member is named by the SHA-256 of its bytes and stored once a task. Rows
carry digest, shard, offset and length: where several tasks stored a member, all rows with its digest carry the
first address (by shard and offset), so equal contents have one address in the whole table. The others stay in their
shards unread: finding them before writing would mean to shuffle all texts. Metadata columns are then filled from range
reads of the header alone, and features from range reads of the member.

Shards are written whole under a temporary name and renamed, and their names follow
from the task, so a task that is run again leaves the same files. Shards reach the
shared folder through pyarrow's file systems (file, S3, GCS, HDFS).

Defined results: null text is empty, a payload of 192 blanks; equal texts give equal
values; rows with a null or repeated id each keep their own; long texts are one member whatever their size; an empty table gives no rows
and no shards; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import broadcast_if_small, clean, measured_bytes, qualified, scratch_path, settle

UNIT = 192
SHARD_BYTES = 32 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
_BLOCK = 512


def payload_of(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` padded with byte 32 to a positive multiple of ``unit``."""
    return data + b" " * ((-len(data)) % unit or (0 if data else unit))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes, width: int = UNIT, level: int = 6) -> bytes:
    """A grey 8-bit PNG whose samples are the payload, row by row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def image_header(head: bytes) -> dict:
    """Width, height and bit depth from the first 33 bytes of an image."""
    if len(head) < HEADER_BYTES or head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    if zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("the PNG header is damaged")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour": colour}


def decode_image(media: bytes) -> bytes:
    """The samples of an image that :func:`encode_image` made."""
    shape, at, data = image_header(media[:HEADER_BYTES]), 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape["height"], shape["width"] + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Height, mean, distinct values and entropy of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    mean = float(counts @ np.arange(256)) / len(payload)
    return f"rows={len(payload) // UNIT};mean={mean:.4f};values={len(share)};entropy={float(-(share * np.log2(share)).sum()):.4f}"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@dataclass
class _Shard:
    """A tar file being filled; member offsets are known before it is written."""

    root: str
    task: int
    number: int = 0
    parts: list[bytes] = field(default_factory=list)
    size: int = 0
    members: dict[str, tuple[str, int, int]] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"{self.root}/shard-{self.task:06d}-{self.number:06d}.tar"

    def add(self, digest: str, media: bytes) -> tuple[str, int, int]:
        """Shard, offset and length of a member."""
        if digest not in self.members:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.GNU_FORMAT)
            self.members[digest] = self.name, self.size + len(head), len(media)
            pad = -len(media) % _BLOCK
            self.parts += [head, media, b"\0" * pad]
            self.size += len(head) + len(media) + pad
        return self.members[digest]

    def close(self) -> None:
        if self.parts:
            fs, path = _filesystem(self.name)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            attempt = f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
            with fs.open_output_stream(attempt) as out:
                for part in self.parts:
                    out.write(part)
                out.write(b"\0" * (2 * _BLOCK))
            fs.move(attempt, path)
        self.number += 1
        self.parts, self.size = [], 0


_ROW = "digest string, shard string, offset long, length long, n_bytes long"


def write_shards(df: DataFrame, root: str, text: str = "text", key: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store every text; rows ``(key, digest, shard, offset, length, n_bytes)``, read from a settled table."""
    kept = clean(df, key, text)
    names = [key, "digest", "shard", "offset", "length", "n_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(root, TaskContext.get().partitionId())
        for batch in batches:
            rows = []
            for t in batch.column(1):
                data = (t.as_py() or "").encode()
                media = encode_image(payload_of(data))
                digest = hashlib.sha256(media).hexdigest()
                rows.append((digest, *shard.add(digest, media), len(data)))
                if shard.size >= shard_bytes:
                    shard.close()
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=names)
        shard.close()

    return _one_address(settle(kept.mapInArrow(run, f"`{key}` {kept.schema[0].dataType.simpleString()}, {_ROW}"), "media"))


def _one_address(rows: DataFrame) -> DataFrame:
    """``rows`` with the first address of each digest."""
    address = F.struct("shard", "offset")
    several = rows.groupBy("digest").agg(F.min(address).alias("_first"), F.max(address).alias("_last")).where("_first <> _last").select("digest", "_first")
    several = settle(several, "addresses")
    joined = rows.join(broadcast_if_small(several, measured_bytes(several)), "digest", "left")
    moved = {c: F.coalesce(f"_first.{c}", c).alias(c) for c in ("shard", "offset")}
    return joined.select(*(moved.get(c, F.col(f"`{c}`")) for c in rows.columns))


class _Reader:
    """Range reads; keeps one shard open."""

    def __init__(self) -> None:
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            fs, path = _filesystem(shard)
            self.name, self.file = shard, fs.open_input_file(path)
        got = self.file.read_at(length, offset)
        if len(got) != length:
            raise OSError(f"{shard} ends before byte {offset + length}")
        return got


def with_metadata(rows: DataFrame) -> DataFrame:
    """``rows`` with width, height, bit depth and payload bytes; reads 33 bytes a row."""
    schema = rows.schema
    extra = ["width", "height", "bit_depth", "payload_bytes"]
    at = {c: rows.columns.index(c) for c in ("shard", "offset")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            found = [image_header(reader.read(s, o, HEADER_BYTES)) for s, o in zip(batch.column(at["shard"]).to_pylist(), batch.column(at["offset"]).to_pylist(), strict=True)]
            columns = [[x[c] for x in found] for c in extra[:3]] + [[x["width"] * x["height"] * x["bit_depth"] // 8 for x in found]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], names=[*schema.names, *extra])

    from pyspark.sql.types import LongType, StructField, StructType

    return rows.mapInArrow(run, StructType([*schema.fields, *(StructField(c, LongType()) for c in extra)]))


_FEATURES = "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def with_features(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, sizes, digests and features, computed from the stored bytes; checks them against the digest."""
    rows = rows.select(key, "digest", "shard", "offset", "length", "n_bytes", "payload_bytes")
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            out = []
            for digest, shard, offset, length, n_bytes, payload_bytes in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                media = reader.read(shard, offset, length)
                if hashlib.sha256(media).hexdigest() != digest:
                    raise OSError(f"{shard}: the member at {offset} is not {digest}")
                payload = decode_image(media)
                if len(payload) != payload_bytes:
                    raise OSError(f"{shard}: the header at {offset} belies its samples")
                out.append((n_bytes, payload_bytes, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), length, digest, feature_of(payload)))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_bytes long, payload_bytes long, {_FEATURES}")


def store_and_describe(df: DataFrame, text: str = "text", key: str = "doc_id", root: str | None = None) -> DataFrame:
    """Shards under ``root`` (the shared folder by default), metadata, then features of each row."""
    root = qualified(df.sparkSession, root or scratch_path(df.sparkSession, "shards"))
    return with_features(with_metadata(write_shards(df, root, text, key)), key)
