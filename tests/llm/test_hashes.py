"""Hashes: equal to plain polynomials, and not misled by texts made to collide."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import _text, minhash_dedup, substring_dedup


def thue_morse(n, flip=False):
    """Words that collide in every polynomial hash modulo a power of two."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def polynomial(values, base):
    return sum(v * pow(base, i, _text.PRIME) for i, v in enumerate(values)) % _text.PRIME


def test_spans_are_polynomials_over_a_prime():
    texts = ["ab cde f a ab cde", "cde f", "z" * 300 + " é"]
    data, offsets = _text.utf8(pa.array(texts))
    starts, ends, firsts = _text.words(data, offsets)
    for family in (0, 1):
        bases = _text._bases("bytes", family, 5)
        got = _text.span_hashes(data, starts, ends, family, 5)
        want = [polynomial([c + 1 for c in w.encode()], bases[0].base) << 31 | polynomial([c + 1 for c in w.encode()], bases[1].base) for t in texts for w in t.split()]
        assert got.tolist() == want
        at, _ = _text.window_starts(firsts, 2)
        hashes = _text.window_hashes(got, at, 2, family, 5)
        assert hashes[0] == hashes[4] and hashes[1] == hashes[5] and len(set(hashes.tolist())) == 5


def test_long_words_and_many_slices(monkeypatch):
    long = "x" * (_text._LONG_WORD + 5)
    data, offsets = _text.utf8(pa.array([f"a {long} b", f"q {long}", long[:-1]]))
    starts, ends, firsts = _text.words(data, offsets)
    h = _text.span_hashes(data, starts, ends)
    assert h[1] == h[4] != h[5] and len(set(h.tolist())) == 5
    values = np.arange(1000, dtype=np.uint64) % np.uint64(37)
    at = np.arange(900)
    whole = _text.window_hashes(values, at, 50)
    monkeypatch.setattr(_text, "_STEP", 7)
    assert (_text.window_hashes(values, at, 50) == whole).all()
    assert (whole[37:] == whole[:-37]).all() and len(set(whole.tolist())) == 37


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_made_to_collide_do_not(spark, n):
    mine, other = thue_morse(n), thue_morse(n, True)
    assert mine != other
    filler = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([mine, *filler])), (2, " ".join([other, *filler[:49]])), (3, mine), (4, other)]
    rows += [(5, " ".join([mine] * 60)), (6, " ".join([other] * 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in substring_dedup.digest(df).collect()}
    # documents 5 and 6 repeat their own windows only
    assert removed == dict.fromkeys(range(1, 7), 0)
    classes = {r.doc_id: (r.copy_of, r.class_id) for r in minhash_dedup.near_duplicates(df).collect()}
    assert classes[3] == (3, 3) and classes[4] == (4, 4)
    assert classes[5] == (5, 5) and classes[6] == (6, 6)


def test_word_orders_made_to_collide_do_not(spark):
    order = [bin(i).count("1") % 2 for i in range(2048)]
    rows = [(1, " ".join("ab"[x] for x in order)), (2, " ".join("ab"[1 - x] for x in order))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert substring_dedup.digest(df, width=2048).agg(F.sum("n_removed")).head()[0] == 0


def test_windows_with_one_equal_hash_are_parted():
    first = np.array([7, 7, 7, 3, 7], np.uint64)
    second = np.array([1, 2, 1, 9, 2], np.uint16)
    doc = np.array([5, 4, 3, 2, 1])
    order, cuts = substring_dedup._in_groups(first, second, doc)
    groups = [doc[order][a:b].tolist() for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
    assert sorted(groups) == [[1, 4], [2], [3, 5]]
