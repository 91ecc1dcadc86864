"""Language identification by multilingual mixture inference.

Per language a model of hashed character trigrams (of the lower-cased UTF-8
text, other ASCII signs than letters counting as blanks) is counted over the
labelled rows. A document is taken as a mixture of languages: expectation-
maximisation estimates the proportions from the trigram likelihoods. Then
languages enter the document's set, largest proportion first, as long as the
log-likelihood, with proportions re-estimated for the set, grows by more than a
penalty of ``penalty * log(trigrams)``. All languages of the model are open to a
document; it is done when the next one doesn't pay, or when no mixture of all of them
could (the log-likelihood is concave, so its slope bounds what is left to gain). The
prediction is the largest language of the set; the score is its proportion in the full mixture.

Defined results: null text, or text without a letter: language ``und``, score 0,
no set. Of equal proportions the language that sorts first counts as larger. Rows with a null id are predicted as others. No labelled row at all: every document is ``und``. Very long texts are
used whole. Repeated rows get equal results. Extra columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import clean

UNKNOWN = "und"
BUCKETS = 1 << 16
#: Labelled rows that a model is counted over; beyond, a hash of the text decides which.
TRAIN_ROWS = 1_000_000
#: Languages that a model may hold; more are an error.
MOST_LANGUAGES = 512
#: A document's proportions are settled when a round of EM moves none of them by this; rounds at most.
TOLERANCE, MOST_ROUNDS = 1e-3, 200
_SLICES = 16

_LETTER = np.full(256, 0x20, dtype=np.uint8)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of documents: first, last, each trigram's document in the range, and its bucket."""
    lowered = pc.utf8_lower(pc.fill_null(column, ""))
    padded = pc.binary_join_element_wise(pa.scalar(" "), lowered, pa.scalar(" "), pa.scalar(""))
    data, offsets = _text.utf8(padded)
    for a, b in _text.chunks(offsets):
        part = _LETTER[data[offsets[a] : offsets[b]]]
        cuts = offsets[a : b + 1] - offsets[a]
        blank = part == 0x20
        keep = ~(blank[1:-1] & (blank[:-2] | blank[2:]))
        keep[cuts[1:-1] - 1] = False
        keep[cuts[1:-1] - 2] = False
        at = np.flatnonzero(keep)
        code = part[at].astype(np.uint32) << 16 | part[at + 1].astype(np.uint32) << 8 | part[at + 2]
        bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
        yield a, b, np.searchsorted(cuts, at, side="right") - 1, bucket


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).dictionary_encode()
        names, which = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        for a, b, doc, bucket in trigrams(batch.column(0)):
            key = which[a:b].astype(np.int64)[doc] * BUCKETS + bucket
            counts = np.bincount(key, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for i in np.unique(which[a:b]).tolist():
                total[names[i]] = total.get(names[i], 0) + counts[i]
    for name, counts in total.items():
        parts = counts.astype(np.int64).reshape(_SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array([name] * _SLICES), pa.array(range(_SLICES), pa.int32()), pa.array([p.tobytes() for p in parts])], names=["lang", "slice", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"lang": table.column("lang")[:1], "slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()])})


@dataclass
class Model:
    """``table[bucket, language]``: probability of a trigram bucket in a language."""

    languages: list[str]
    table: np.ndarray


def train(rows: DataFrame, text: str = "text", lang: str = "lang", bound: int = TRAIN_ROWS, smoothing: float = 0.1) -> Model:
    """Counts trigrams per language over the labelled rows, ``bound`` of them at most (in expectation)."""
    labelled = clean(rows, text, lang).toDF("text", "lang").where("text is not null and lang is not null")
    n = labelled.select("lang").count()
    if n > bound:
        labelled = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
    counted = labelled.mapInArrow(_count, "lang string, slice int, counts binary").groupBy("lang", "slice").applyInArrow(_add, "lang string, slice int, counts binary")
    found: dict[str, list] = {}
    for row in counted.limit(MOST_LANGUAGES * _SLICES + 1).collect():
        found.setdefault(row[0], [b""] * _SLICES)[row[1]] = bytes(row[2])
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = sorted(found)
    table = np.empty((BUCKETS, len(names)), dtype=np.float32)
    for i, name in enumerate(names):
        counts = np.frombuffer(b"".join(found[name]), np.int64) + smoothing
        table[:, i] = counts / counts.sum()
    return Model(names, table)


def _mixture(likelihood: np.ndarray, counts: np.ndarray, firsts: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over many documents at once: proportions and log-likelihoods. Languages that start at 0 stay there.

    A document is done when a round moves none of its proportions by ``TOLERANCE``, or after ``rounds``.
    """
    share = start
    sizes = np.diff(np.append(firsts, len(counts)))
    total = np.add.reduceat(counts, firsts)[:, None]
    for done in range(1, rounds + 1):
        each = likelihood * np.repeat(share, sizes, axis=0)
        each *= (counts / np.maximum(each.sum(axis=1), 1e-30))[:, None]
        now = np.add.reduceat(each, firsts, axis=0) / total
        moving = np.flatnonzero(np.abs(now - share).max(axis=1) >= TOLERANCE)
        share = now
        if 2 * len(moving) <= len(firsts):  # the others are done
            if len(moving):
                entries, starts = _some(firsts, len(counts), moving)
                share[moving] = _mixture(likelihood[entries], counts[entries], starts, share[moving], rounds - done)[0]
            break
    mixed = np.maximum((likelihood * np.repeat(share, sizes, axis=0)).sum(axis=1), 1e-30)
    return share, np.add.reduceat(counts * np.log(mixed, dtype=np.float64), firsts)


def _most(likelihood: np.ndarray, counts: np.ndarray, firsts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Per document, a log-likelihood that no mixture exceeds: that of ``share`` and ``trigrams * log`` of its largest slope."""
    mixed = np.maximum((likelihood * np.repeat(share, np.diff(np.append(firsts, len(counts))), axis=0)).sum(axis=1), 1e-30)
    total = np.add.reduceat(counts, firsts).astype(np.float64)
    slope = np.add.reduceat(likelihood * (counts / mixed)[:, None], firsts, axis=0).max(axis=1) / total
    return np.add.reduceat(counts * np.log(mixed, dtype=np.float64), firsts) + total * np.log(np.maximum(slope, 1))


def _some(firsts: np.ndarray, n: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the chosen documents, and where each of these starts."""
    sizes = np.diff(np.append(firsts, n))[docs]
    return np.repeat(firsts[docs], sizes) + _text.ranks(sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])


def infer(model: Model, column: pa.Array, rounds: int = MOST_ROUNDS, most: int | None = None, penalty: float = 4.0) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """Language, score, comma-joined language set (of ``most`` languages, if given) and gain of each text.

    The gain is the log-likelihood of the set less that of noise, in which all buckets are as likely.
    """
    n, size = len(column), len(model.languages)
    names, scores, sets, gains = [UNKNOWN] * n, np.zeros(n), [""] * n, np.zeros(n)
    if not size or not n:
        return names, scores, sets, gains
    letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    for a, b, doc, bucket in trigrams(column):
        keys = np.sort((doc.astype(np.uint64) << np.uint64(16) | bucket).astype(np.uint32) if b - a < 1 << 16 else doc.astype(np.uint64) << np.uint64(16) | bucket)
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        if not len(heads):
            continue
        counts = np.diff(np.append(heads, len(keys))).astype(np.float32)
        keys = keys[heads]
        owner = (keys >> type(keys[0])(16)).astype(np.int64)
        likelihood = model.table[(keys & type(keys[0])(0xFFFF)).astype(np.int64)]
        firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        docs = owner[firsts]
        share, _ = _mixture(likelihood, counts, firsts, np.full((len(docs), size), 1 / size, np.float32), rounds)
        order = np.argsort(-share, axis=1, kind="stable")
        chosen = np.zeros_like(share)
        chosen[np.arange(len(docs)), order[:, 0]] = 1
        best = chosen.copy()
        _, score = _mixture(likelihood, counts, firsts, chosen, 0)
        charge = penalty * np.log1p(np.add.reduceat(counts, firsts).astype(np.float64))
        limit = _most(likelihood, counts, firsts, share)
        open_ = np.arange(len(docs))
        for k in range(1, size if most is None else min(most, size)):
            # no mixture can pay for one language more, or it has died out
            open_ = open_[(limit[open_] > score[open_] + charge[open_]) & (share[open_, order[open_, k]] > 0)]
            if not len(open_):
                break
            entries, starts = _some(firsts, len(counts), open_)
            begin = np.where(chosen[open_] > 0, share[open_], 0)
            begin[np.arange(len(open_)), order[open_, k]] = share[open_, order[open_, k]]
            begin /= begin.sum(axis=1, keepdims=True)
            now, better = _mixture(likelihood[entries], counts[entries], starts, begin, rounds)
            won = better > score[open_] + charge[open_]
            open_, now, better = open_[won], now[won], better[won]
            chosen[open_, order[open_, k]] = 1
            best[open_], score[open_] = now, better
        top = best.argmax(axis=1)
        for i, d in enumerate((docs + a).tolist()):
            if letters[d]:
                names[d] = model.languages[top[i]]
                sets[d] = ",".join(model.languages[j] for j in order[i] if chosen[i, j])
        seen = docs + a
        gains[seen] = np.where(letters[seen], score + np.add.reduceat(counts, firsts).astype(np.float64) * np.log(BUCKETS), 0)
        scores[seen] = np.where(letters[seen], np.clip(share[np.arange(len(docs)), top], 0, 1), 0)
    return names, scores, sets, gains


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """The kept columns with ``lang_pred``, ``score`` and ``languages``, one row per input row."""
    kept = clean(df, *keep, text)
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most MOST_LANGUAGES * 256 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, sets, _ = infer(shared.value, batch.column(len(keep)), **options)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores), pa.array(sets, pa.string())], names=[*keep, "lang_pred", "score", "languages"])

    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double, languages string")


def accept(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` that are in known languages, however many; columns stay.

    Rejected are texts without a letter, and those that the languages chosen for them explain no better than noise
    does (all buckets as likely): random letters, encoded data, languages without a model.
    """
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gains = infer(shared.value, batch.column(at))[3]
            yield batch.filter(pa.array(gains > 0))

    return df.mapInArrow(run, df.schema)
