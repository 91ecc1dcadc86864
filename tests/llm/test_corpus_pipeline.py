"""The pipeline's stages on a small table, and the queries on the smallest test tables."""

import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_id, minhash_dedup, packing, secret_scan
from lodestone.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_keep_the_columns(stages):
    names = list(stages)
    for name in names[1:-1]:
        assert stages[name].columns == stages["input"].columns


def test_rejected_languages_go(spark, stages):
    docs = stages["input"]
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, model)
    want = {r.doc_id for r in found.where("lang_pred <> 'und'").collect()}
    assert {r.doc_id for r in stages["language_id"].collect()} == want
    assert len(want) >= 0.99 * docs.count()


def test_one_of_each_class_stays(stages):
    classes = minhash_dedup.near_duplicates(stages["language_id"])
    assert sorted(r.doc_id for r in stages["minhash_near_dedup"].collect()) == sorted(r.class_id for r in classes.select("class_id").distinct().collect())


def test_no_secret_is_left(stages):
    before, after = stages["minhash_near_dedup"], stages["secret_scan"]
    assert before.count() == after.count()
    found = secret_scan.digest(after)
    assert found.agg(F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex"))).head()[0] == 0
    changed = before.join(after.select("doc_id", F.col("text").alias("new")), "doc_id").where("text <> new")
    assert changed.count() == secret_scan.scan(before).where(F.size("spans") > 0).count()


def test_packing_holds_what_the_mixture_took(stages):
    encode = packing.encoder(packing.default_tokenizer())
    total = sum(len(encode(r.text or "")) + 1 for r in stages["mixing"].select("text").collect())
    assert stages["packing"].agg(F.sum("length")).head()[0] == total
    row = stages["packing"].where("start = 0 and length = doc_tokens").head()
    text = stages["mixing"].where(F.col("doc_id") == row.doc_id).head().text
    assert row.ids_crc32 == zlib.crc32(bytes().join(int(i).to_bytes(4, "little") for i in [*encode(text), 0]))


def test_run_is_all_stages(spark, stages):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SMALL)
    assert got.agg(F.sum("length")).head()[0] == stages["packing"].agg(F.sum("length")).head()[0]


@pytest.mark.parametrize("name", QUERIES)
def test_queries_run_whole(spark, name):
    table = {"op1": "embeddings", "op3": "pages"}.get(name.split("_")[0], "documents")
    rows = QUERIES[name](spark, SMALL)
    n = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    assert rows.count() >= n if name.startswith("op4_") else rows.count() == n


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    assert found.where("lang = lang_pred").count() / found.count() > 0.97


def odd_table(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, ties, and extra columns with operators' inner names."""
    english = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(12).collect()
    texts = [r.text for r in english]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(100, None, "en", "s0"), (101, "", "en", "s0"), (102, " \t\n", None, None), (103, "12 % 34", "en", "s1"), (104, "qzx jvk wqz " * 50, None, "s1")]
    rows += [(0, texts[0], "en", "s0"), (105, texts[1], "en", "s0"), (None, texts[2], "en", "s1"), (None, texts[2], "en", None), (106, " ".join(texts * 20), None, None)]
    rows += [(107, f"{texts[3]} password = hunter2hunter2", "en", "s2"), (3, texts[4], "en", "s2")]
    full = [(*r, len(r[1] or ""), "a", 1, "b", 2.0, "c", "d") for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, band string, rep int, component string, size double, copies string, __lodestone_rank string").repartition(3)


def test_stages_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    before = docs = odd_table(spark)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns
    ids = lambda rows: sorted((r.doc_id is None, r.doc_id) for r in rows)
    found = [i for _, i in ids(left["language_id"])]
    assert not {100, 101, 102, 103, 104} & set(found)
    assert found == sorted([*range(12), 0, 3, 105, 106, 107]) + [None, None]
    kept = [i for _, i in ids(left["minhash_near_dedup"])]
    assert kept.count(0) == kept.count(3) == 1 and kept.count(None) == 2 and 105 not in kept and 106 in kept
    assert all("hunter2" not in (r.text or "") for r in left["secret_scan"])
    assert len(left["secret_scan"]) == len(left["minhash_near_dedup"])
    copies = [(r.doc_id, r.text) for r in left["mixing"]]
    assert set(copies) <= {(r.doc_id, r.text) for r in left["secret_scan"]}
    assert max(copies.count(c) for c in set(copies) if c[0] is not None) <= 3
    starts = [r for r in left["packing"] if r.start == 0]
    assert len(starts) == len(copies) and sum(r.length for r in left["packing"]) == sum(r.doc_tokens for r in starts)


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline

    docs = odd_table(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
