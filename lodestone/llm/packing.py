"""Packing token pieces into fixed windows by minimum bin slack.

A document's ids are cut at multiples of the window; full pieces are sequences of
their own. The remainders of a task are pooled by length. For each window the
largest remaining length is placed, and a subset-sum dynamic program over bitsets
(one bit per fill level, one layer per length and power-of-two multiple) finds the
multiset of remaining lengths that fills the rest closest to capacity; the layers
are walked back to counts, and the pattern is used as often as the counts last.

Slack that no remaining length fits into is filled by cutting the shortest
remaining piece, whose rest goes back to the pool; so only the last window of a task
can have slack, and that one is cut at powers of two, which need no padding. Nothing
is shuffled: every task packs what it reads, so a hot source or length is spread like
any other.

``sequence_id`` is the task's number times 2**36 plus a counter, so results are
equal for equal partitions, also after a lost executor.

Defined results: null text is empty and gives the single id 0; long texts are
tokenized whole; rows with a null or repeated id are packed each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._spark import clean

WINDOW = 1024
END = 0
#: Remainders that a task holds before it packs.
POOL = 8192
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write bytes that don't print as signs from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def encoder(path: str):
    """A function from text to ids, equal to ``tokenizers`` with ``add_special_tokens=False``.

    A plain byte-level BPE file is run by the faster of the two public BPE
    libraries, from the same vocabulary; other files, and texts with the name of an
    added token, are left to ``tokenizers`` itself.
    """

    def plainly(text: str) -> np.ndarray:
        return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    added = [t["content"] for t in spec.get("added_tokens", [])]
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
        return plainly
    import public_tokenizers
    import tiktoken

    byte = _byte_of_sign()
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    fast = tiktoken.Encoding("from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(t in text for t in added):
            return plainly(text)
        try:
            return np.array(fast.encode_ordinary(text), dtype=np.uint32)
        except BaseException as e:
            # its pattern engine gives up on very long runs of blanks with a panic, which can't be imported
            if type(e).__name__ != "PanicException":
                raise
            return plainly(text)

    return encode


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length fill ``capacity`` with the least slack; larger lengths first."""
    mask = (1 << capacity + 1) - 1
    layers: list[tuple[int, int, int]] = []
    reach = 1
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, step = min(counts[length], capacity // length), 1
        while left > 0:
            used = min(step, left)
            layers.append((length, used, reach))
            reach |= reach << used * length & mask
            left -= used
            step *= 2
        if reach >> capacity & 1:
            break
    level, out = reach.bit_length() - 1, defaultdict(int)
    for length, used, earlier in reversed(layers):
        if not earlier >> level & 1:
            out[length] += used
            level -= used * length
    return dict(out)


class _Packer:
    def __init__(self, window: int, first: int) -> None:
        self.window, self.next = window, first
        self.pool: dict[int, list[tuple]] = defaultdict(list)
        self.held = 0
        self.rows: list[list] = [[] for _ in range(7)]

    def put(self, key, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> None:
        for column, value in zip(self.rows, (key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset), strict=True):
            column.append(value)

    def add(self, key, ids: np.ndarray) -> None:
        total = len(ids)
        for start in range(0, total - self.window + 1, self.window):
            self.put(key, start, ids[start : start + self.window], total, self.next, 0)
            self.next += 1
        start = total // self.window * self.window
        if start < total:
            self.pool[total - start].append((key, start, ids[start:].copy(), total))
            self.held += 1
            if self.held >= POOL:
                self.pack(last=False)

    def pack(self, last: bool) -> None:
        counts = {k: len(v) for k, v in self.pool.items() if v}
        while counts:
            seed = max(counts)
            rest = counts | {seed: counts[seed] - 1}
            pattern = best_fill({k: n for k, n in rest.items() if n}, self.window - seed)
            pattern[seed] = pattern.get(seed, 0) + 1
            slack = self.window - sum(k * n for k, n in pattern.items())
            # what is left is longer than the slack: else it would have been taken
            donor = min((k for k, n in counts.items() if n > pattern.get(k, 0) and k > slack), default=0) if slack else 0
            if slack and not donor and not last:
                break
            times = 1 if slack else min(counts[k] // n for k, n in pattern.items())
            for _ in range(times):
                pieces = [self.pool[k].pop() for k, n in sorted(pattern.items(), reverse=True) for _ in range(n)]
                self.held -= len(pieces)
                if donor:
                    key, start, ids, whole = self.pool[donor].pop()
                    pieces.append((key, start, ids[:slack], whole))
                    self.pool[donor - slack].append((key, start + slack, ids[slack:], whole))
                self.place(pieces)
            for k, n in pattern.items():
                counts[k] -= n * times
            if donor:
                counts[donor] -= 1
                counts[donor - slack] = counts.get(donor - slack, 0) + 1
            counts = {k: n for k, n in counts.items() if n}
        self.pool = defaultdict(list, {k: v for k, v in self.pool.items() if v})

    def place(self, pieces: list[tuple]) -> None:
        """One window; a window with slack is cut at powers of two."""
        total = sum(len(p[2]) for p in pieces)
        sizes = [total] if total == self.window else [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        room, offset = sizes.pop(0), 0
        for key, start, ids, whole in pieces:
            while len(ids):
                if not room:
                    self.next += 1
                    room, offset = sizes.pop(0), 0
                take = ids[:room]
                self.put(key, start, take, whole, self.next, offset)
                start, ids, room, offset = start + len(take), ids[room:], room - len(take), offset + len(take)
        self.next += 1

    def take(self) -> list[list]:
        rows, self.rows = self.rows, [[] for _ in range(7)]
        return rows


def pack(df: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: key, start, length, CRC of its ids, the document's ids, sequence and offset there."""
    path = tokenizer or default_tokenizer()
    kept = clean(df, key, text)
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        packer = _Packer(window, TaskContext.get().partitionId() << 36)
        kind = None
        end = np.array([END], dtype=np.uint32)

        def out() -> pa.RecordBatch:
            keys, *rest = packer.take()
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(c, pa.int64()) for c in rest)], names=names)

        for batch in batches:
            kind = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(k, np.concatenate([encode(t.as_py() or ""), end]))
                if len(packer.rows[0]) >= 16384:
                    yield out()
        packer.pack(last=True)
        if packer.rows[0]:
            yield out()

    return kept.mapInArrow(run, f"`{key}` {kept.schema[0].dataType.simpleString()}, {SCHEMA}")
