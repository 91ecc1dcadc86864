"""Models of text against plain versions: quality weights, language mixtures, what is noise."""

import base64
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import _text, embedding_dedup, language_id, media_columns, packing, quality_resampling

# --- quality ------------------------------------------------------------------------------


def buckets_of(text):
    """Each word's and word pair's bucket, one by one."""
    out, words = [], (text or "").split()
    for i in range(len(words)):
        for n in (1, 2):
            if i + n <= len(words):
                data, offsets = _text.utf8(pa.array([" ".join(words[i : i + n])]))
                starts, ends, _ = _text.words(data, offsets)
                values = _text.span_hashes(data, starts, ends)
                value = _text.mix64(values)[0] if n == 1 else _text.window_hashes(values, np.array([0]), 2)[0]
                out.append(int(value) >> 48)
    return out


def quality_rows():
    rng = random.Random(2)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad) for _ in range(rng.randrange(0, 40)))) for i in range(90)]
    return [*rows, (90, None), (91, " \t"), (None, "g1 b1"), (5, "g2 g2")]


def test_log_weights_are_those_of_two_plain_models(spark):
    rows = quality_rows()
    targets = {i for i, _ in rows if i is not None and i % 3 and i % 2 and i < 90}
    counts = np.ones((2, quality_resampling.BUCKETS))
    for i, text in rows:
        for b in buckets_of(text):
            counts[0, b] += 1
            counts[1, b] += i in targets
    log = np.log(counts / counts.sum(axis=1, keepdims=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(i,) for i in targets], "doc_id long")
    for temperature in (1.0, 4.0):
        got = quality_resampling.resample(df, marks, 0.5, temperature=temperature).collect()
        want = sorted((str(i), round(sum(log[1, b] - log[0, b] for b in buckets_of(t)) / temperature, 6)) for i, t in rows)
        assert sorted((str(r.doc_id), round(r.log_weight, 6)) for r in got) == want
        limit = sorted((r.noisy for r in got), reverse=True)[round(0.5 * len(rows)) - 1]
        assert all(r.kept == (r.noisy >= limit) for r in got)


def test_noise_is_gumbel(spark):
    zero = np.zeros(quality_resampling.BUCKETS)
    noise = np.array([r.noisy for r in quality_resampling.score(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), zero).collect()])
    assert np.isfinite(noise).all()
    assert abs(noise.mean() - 0.5772) < 0.03 and abs(noise.var() - math.pi**2 / 6) < 0.08


# --- languages ----------------------------------------------------------------------------


def model_of(spark):
    rng = random.Random(4)
    alphabets = {"aa": "abcdef", "bb": "efghij", "cc": "ijklma", "dd": "äöüßabe"}
    make = lambda lang, n: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    return language_id.train(spark.createDataFrame([(make(x, 40), x) for x in alphabets for _ in range(30)], "text string, lang string")), make


def plain_em(model, text):
    """Proportions, and the penalised set, from one text's trigrams, one round at a time."""
    bucket = next(b for *_, b in language_id.trigrams(pa.array([text])))
    p = model.table[bucket].astype(float)

    def em(start):
        share = start
        for _ in range(2000):
            each = p * share
            now = (each / each.sum(axis=1, keepdims=True)).mean(axis=0)
            if np.abs(now - share).max() < 1e-7:
                break
            share = now
        return share, np.log((p * share).sum(axis=1)).sum()

    n = len(model.languages)
    share, _ = em(np.full(n, 1 / n))
    order = np.argsort(-share, kind="stable")
    chosen, best = [order[0]], np.log(p[:, order[0]]).sum()
    for k in order[1:]:
        start = np.zeros(n)
        start[[*chosen, k]] = share[[*chosen, k]]
        _, now = em(start / start.sum())
        if now <= best + 4.0 * math.log1p(len(p)):
            break
        chosen.append(k)
        best = now
    return share, {model.languages[i] for i in chosen}, best + len(p) * math.log(language_id.BUCKETS)


def test_mixtures_are_those_of_plain_em(spark):
    model, make = model_of(spark)
    rng = random.Random(5)
    texts = [" ".join(make(x, rng.randrange(1, 120)) for x in rng.sample(model.languages, rng.randint(1, 4))) for _ in range(60)]
    names, scores, sets, gains = language_id.infer(model, pa.array(texts))
    for i, text in enumerate(texts):
        share, chosen, gain = plain_em(model, text)
        assert set(sets[i].split(",")) == chosen
        assert scores[i] == pytest.approx(share[model.languages.index(names[i])], abs=0.02)
        assert gains[i] == pytest.approx(gain, abs=0.02 * len(text))


def test_noise_is_rejected_and_mixtures_stay(spark):
    model, make = model_of(spark)
    rng = random.Random(6)
    noise = ["".join(rng.choice("qrstuvwxyz") for _ in range(200)), base64.b64encode(rng.randbytes(200)).decode(), "日本語" * 30, "привет " * 20]
    texts = [make("aa", 3), " ".join(make(x, 50) for x in model.languages), f"{make('bb', 100)} {noise[0]}"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate([*texts, *noise, None, "", "12 %"])], "doc_id long, text string, score int")
    left = language_id.accept(df, model)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 2]


# --- tokens -------------------------------------------------------------------------------


def test_long_blank_runs_are_tokenized():
    encode = packing.encoder(packing.default_tokenizer())
    for text in (" " * 1_200_000 + "x", " \n" * 600_000, "a" * 200_000):
        assert encode(text).tolist() == packing._tokenizer(packing.default_tokenizer()).encode(text, add_special_tokens=False).ids


# --- media and vectors --------------------------------------------------------------------


def test_equal_contents_have_one_address(spark, tmp_path):
    rows = [(i, f"text {i % 7} " * 30) for i in range(60)] + [(None, "text 3 " * 30), (5, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    stored = media_columns.write_shards(df, f"file://{tmp_path}/shards", shard_bytes=1500)
    found = stored.groupBy("digest").agg(F.count_distinct("shard", "offset").alias("n")).collect()
    assert len(found) == 8 and all(r.n == 1 for r in found)
    assert stored.count() == len(rows)
    features = media_columns.with_features(media_columns.with_metadata(stored)).collect()
    assert len({r.media_sha256 for r in features}) == 8


def test_vectors_of_any_size_link(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(8)
    rows = [(i, [float(x) for x in scale * base], 0) for i, scale in enumerate((1e300, 1.0, 1e-300, 5e-324, -1e200))]
    rows += [(10, [0.0] * 8, 0), (11, [float("inf")] + [1.0] * 7, 0), (12, [None] + [1.0] * 7, 0), (13, [float("nan")] + [1.0] * 7, 0), (14, None, 0), (15, [1e308] * 8, 1), (16, [1e-308] * 8, 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got[0] == got[1] == got[2] == (2, 0) and got[4] == (0, 4)
    assert got[15] == got[16] == (1, 15)
    assert all(got[i] == (0, i) for i in (10, 11, 12, 13, 14))
