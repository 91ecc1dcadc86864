import datetime
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import session
from lodestone.operators import chunking, lifecycle, resolution, retrieval, rollup, search, timeline
from lodestone.plans.queries import ORACLES, QUERIES


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# --- chunking -------------------------------------------------------------------------


def chunks(spark, text, size, overlap, separator="\n\n"):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.chunk_text, r.token_count) for r in chunking.chunk(df, "text", size, overlap, separator).orderBy("chunk_index").collect()]


def plain_chunks(text, size, overlap):
    """The same packing in plain Python."""
    flat = []
    for p in (p.strip() for p in text.split("\n\n")):
        words = p.split()
        if words:
            flat += [p] if len(words) <= size else [" ".join(words[i : i + size]) for i in range(0, len(words), size)]
    out, parts, n, tail = [], [], 0, []
    for p in [*flat, None]:
        if parts and (p is None or n + len(p.split()) > size):
            body = "\n\n".join(parts)
            words = tail + body.split()
            out.append((" ".join(words) if tail else body, len(words)))
            tail = words[-overlap:] if overlap and len(words) > overlap else []
            parts, n = [], 0
        if p is not None:
            parts.append(p)
            n += len(p.split())
    return out


@pytest.mark.parametrize(("size", "overlap"), [(800, 120), (5, 2), (4, 0), (3, 1)])
@pytest.mark.parametrize("text", ["", "  \n\n ", "short", "a b c\n\nd e f\n\ng h i j k l m n", "one two three four five six seven\n\neight"])
def test_packing(spark, text, size, overlap):
    assert chunks(spark, text, size, overlap) == plain_chunks(text, size, overlap)


def test_null_text_has_no_chunks(spark):
    assert chunks(spark, None, 5, 1) == []


def test_windows(spark):
    df = spark.createDataFrame([("a b c d e",), ("a b",), ("",)], "t string").select(chunking.windows("t", 3, 1))
    assert [r[0] for r in df.collect()] == [["a b c", "c d e", "e"], ["a b"], []]


def test_section_split_loses_nothing(spark):
    text = "intro words here\n# CLAIMS\none two three four\n# DATES\nfive six\n"
    got = spark.createDataFrame([(text,)], "t string").select(chunking.split_on_sections("t", 6)).head()[0]
    assert " ".join(got).split() == text.split()
    assert all(len(p.split()) <= 6 for p in got)
    assert spark.createDataFrame([(" x ",)], "t string").select(chunking.split_on_sections("t", 6)).head()[0] == ["x"]


def test_truncate_and_gate(spark):
    df = spark.createDataFrame([("a b c",), ("  ",)], "t string").select(chunking.truncate("t", 2), chunking.summarize_if_long("t", lambda c: F.upper(c), 2))
    assert [tuple(r) for r in df.collect()] == [("a b", "A B C"), (" ", "  ")]


# --- time -----------------------------------------------------------------------------

MENTIONS = [
    ("on 2024-01-05 and January 5, 2024", ["DAY_2024_01_05"]),
    ("2024-02-30 is none", []),
    ("May 5, 2024", ["DAY_2024_05_05"]),
    ("Q3-2024 and 2024 Q1", ["Q1_2024", "Q3_2024"]),
    ("in 1999, not 2040", ["YEAR_1999"]),
    ("2024-01 then Mar. 2023", ["MONTH_2023_03", "MONTH_2024_01"]),
    ("Sept 3rd 2021", ["DAY_2021_09_03"]),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize(("text", "expected"), MENTIONS)
def test_mentions(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert timeline.find_mentions(text) == expected
    assert df.select(timeline.masked_mentions("t")).head()[0] == expected
    assert df.select(timeline.mentions("t")).head()[0] == expected


def test_claimed_spans_differ_from_masking(spark):
    text = "Jan 2024 Q3 2025"
    assert timeline.find_mentions(text) == ["MONTH_2024_01", "YEAR_2025"]
    assert spark.createDataFrame([(text,)], "t string").select(timeline.masked_mentions("t")).head()[0] == ["MONTH_2024_01", "Q3_2025"]


def test_hierarchy_fills_months_between(spark):
    ids = spark.createDataFrame([("DAY_2023_11_30",), ("MONTH_2024_02",), ("bad",)], "time_identifier string")
    got = {r.time_identifier: r.parent_identifier for r in timeline.hierarchy(ids).collect()}
    assert set(got) == {"DAY_2023_11_30", "MONTH_2023_11", "MONTH_2023_12", "MONTH_2024_01", "MONTH_2024_02", "Q4_2023", "Q1_2024", "YEAR_2023", "YEAR_2024"}
    assert got["MONTH_2024_01"] == "Q1_2024"
    assert set(rows(timeline.hierarchy(ids, "quarter"), "time_identifier")) == set()


def test_containing(spark):
    events = spark.createDataFrame([(1, datetime.datetime(2024, 1, 5, 3))], "id long, ts timestamp")
    ids = timeline.hierarchy(spark.createDataFrame([("DAY_2024_01_05",)], "time_identifier string"))
    assert {r.time_level for r in timeline.containing(events, ids).collect()} == {"day", "month", "quarter", "year"}


# --- search ---------------------------------------------------------------------------


def test_knn_and_rerank(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [3.0, 0.0]), (4, None)], "id long, embedding array<float>")
    assert [r.id for r in search.knn(df, search.literal_vector([0.9, 0.0]), 2).collect()] == [2, 1]
    probes = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 0.0])], "probe int, probe_vector array<double>")
    assert rows(search.rerank(df, probes, 1), "probe", "id") == [(0, 1), (1, 3)]


@pytest.mark.parametrize("block", [1024, 2])
def test_neighbours_are_k_first_then_threshold(spark, block):
    df = spark.createDataFrame([(i, "t", [float(x), 0.0]) for i, x in enumerate([0, 1, 2, 10])] + [(9, "u", [0.0, 0.0])], "id long, type string, embedding array<float>")
    got = rows(search.neighbour_join(df, 1, 1.5, "type", block=block), "id", "other")
    assert got == [(0, 1), (1, 0), (2, 1)]


@pytest.mark.parametrize("block", [1024, 7])
def test_neighbours_equal_all_pairs(spark, block):
    import random

    rng = random.Random(3)
    data = [(i, "tu"[i % 2], [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame(data, "id long, type string, embedding array<float>")
    want = set()
    for i, g, v in data:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) ** 0.5, j) for j, h, w in data if h == g and j != i)[:4]
        want |= {(i, j, n + 1) for n, (d, j) in enumerate(near) if d <= 1.2}
    assert set(rows(search.neighbour_join(df, 4, 1.2, "type", block=block), "id", "other", "rank")) == want
    some = df.where("id < 5").select("id")
    assert set(rows(search.neighbour_join(df, 4, 1.2, "type", block=block, queries=some), "id", "other", "rank")) == {w for w in want if w[0] < 5}


def test_global_rank(spark):
    from lodestone.operators.ranking import global_rank

    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(200)], "a long, b long").repartition(5)
    got = {r.b: r.rank for r in global_rank(df, [("a", True), ("b", False)]).collect()}
    assert [b for b, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(200), key=lambda i: (-(i * 7 % 50), i))
    assert sorted(got.values()) == list(range(1, 201))
    assert global_rank(df.limit(0), [("a", True)]).count() == 0


def test_rrf_ties_keep_the_first_list(spark):
    lists = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "b", 1), (1, "a", 2), (2, "c", 1)], "list_no int, id string, rank int")
    got = search.rrf(lists).collect()
    assert [r.id for r in got] == ["a", "b", "c"]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62)


def test_trigram_join_equals_all_pairs(spark):
    from lodestone.functions.text import trigram_similarity

    names = ["acme corp", "acme corporation", "acme", "globex", "globex inc", "initech", "acme corp x", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for threshold in (0.3, 0.6, 0.85):
        brute = df.crossJoin(df.withColumnRenamed("n", "m")).where(trigram_similarity("n", "m") >= threshold)
        joined = search.trigram_join(df, df, threshold, "n", "n").select("_l.n", F.col("_r.n").alias("m"))
        assert rows(joined) == rows(brute)


def test_label_matching(spark):
    labels = spark.createDataFrame([("i1", "revenue growth", None), ("i2", "Washington DC", "p"), ("i3", "net income", None)], "iri string, label string, parent string")
    cands = spark.createDataFrame([("revenue growht",), ("zzz",), ("net income",)], "candidate string")
    assert rows(search.fuzzy_label_match(cands, labels), "candidate", "iri") == [("net income", "i3"), ("revenue growht", "i1")]
    named = spark.createDataFrame([("washington d.c.", "p"), ("Washington", "p"), ("Washington", "q"), ("NET INCOME", None)], "candidate string, parent string")
    assert rows(search.token_set_match(named, labels), "candidate", "iri", "how") == [("NET INCOME", "i3", "exact"), ("Washington", "i2", "containment"), ("washington d.c.", "i2", "tokens")]


# --- resolution -----------------------------------------------------------------------


def test_dedup(spark):
    docs = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.first_id, r.is_duplicate) for r in resolution.dedup_documents(docs).collect()}
    assert got[3] == (1, True)
    assert got[1] == (1, False)
    stored = resolution.dedup_documents(docs.where("doc_id = 2")).select("content_hash")
    assert {r.doc_id for r in resolution.dedup_documents(docs, stored=stored).where("is_duplicate").collect()} == {2, 3}
    first = resolution.first_wins(docs, ["text"], ["doc_id"])
    assert rows(first.where("text is not null"), "text", "doc_id") == [("x", 1), ("y", 2)]


def test_resolve(spark):
    store = spark.createDataFrame([("e1", "acme corporation", "org"), ("e2", "berlin", "city")], "entity_id string, normalized string, class_iri string")
    mentions = spark.createDataFrame([("Acme Corporation", "org"), ("Acme Corporations", "org"), ("Berlin", "org"), ("!!", "org")], "name string, class_iri string")
    got = {r.name: (r.entity_id, r.how) for r in resolution.resolve(mentions, store, 0.8).collect()}
    assert got["Acme Corporation"] == ("e1", "exact")
    assert got["Acme Corporations"] == ("e1", "fuzzy")
    assert got["Berlin"][1] == "new"
    assert "!!" not in got


def test_name_dictionary_drops_what_is_ambiguous(spark):
    entities = spark.createDataFrame([("e1", "byd company ltd"), ("e2", "byd"), ("e3", "ford inc"), ("e4", "ford ltd")], "entity_id string, normalized string")
    got = dict(rows(resolution.name_dictionary(entities)))
    assert got["byd"] == "e2"
    assert "ford" not in got
    assert got["ford inc"] == "e3"


def test_suggestions_and_links(spark):
    a = spark.createDataFrame([("Dog",)], "label string")
    b = spark.createDataFrame([("dog",), ("Cat",), ("CAT",)], "label string")
    assert rows(resolution.merge_suggestions(a, b)) == [("CAT",), ("Dog",)]
    text = spark.createDataFrame([(1, "The ACME plant"), (1, "none")], "c int, t string")
    names = spark.createDataFrame([(1, "Acme"), (1, "")], "c int, n string")
    assert rows(resolution.link_by_substring(text, names, "c", "t", "n"), "t", "n") == [("The ACME plant", "Acme")]


# --- rollups and retrieval --------------------------------------------------------------


def test_clusters_layers_and_batches(spark):
    items = spark.createDataFrame([(str(i), "t", f"text {i}", float(i), [x, 0.0]) for i, x in enumerate([0.0, 0.1, 0.2, 5.0, 5.1, 9.0])], "id string, type string, text string, confidence double, embedding array<float>")
    got = {}
    for key, cluster in rows(rollup.clusters(items, 0.15, 5)):
        got.setdefault(cluster, []).append(key)
    assert got == {"0": ["0", "1", "2"], "3": ["3", "4"]}
    made = rollup.layers(items, lambda t: F.array(F.lit(0.0), F.lit(0.0)), 2, threshold=0.15)
    assert rows(made, "layer", "members") == [(1, ["0", "1", "2"]), (1, ["3", "4"]), (2, sorted(r.id for r in made.where("layer = 1").collect()))]
    members = spark.createDataFrame([("c", str(i), float(i % 2)) for i in range(7)], "cluster string, id string, confidence double")
    cut = rollup.batches(members, 3, 2)
    assert sorted(r["count"] for r in cut.groupBy("batch").count().collect()) == [3, 3]
    assert rollup.layers(items.limit(0), lambda t: F.array(F.lit(0.0)), 1).count() == 0


def test_recommendations_need_two(spark):
    insights = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "id string, confidence double")
    assert [r.id for r in rollup.recommendation_inputs(insights, spark.createDataFrame([("a",)], "insight_id string")).collect()] == ["c", "b"]
    assert rollup.recommendation_inputs(insights, insights.where("id <> 'a'").select(F.col("id").alias("insight_id"))).count() == 0


def test_bridge_and_groups(spark):
    ch = spark.createDataFrame([(1, "d", "summary"), (2, "d", "fulltext"), (3, "e", "summary")], "chunk_id int, document_id string, kind string")
    cands = spark.createDataFrame([(1, 5), (3, 2)], "chunk_id int, hits long")
    assert rows(retrieval.fulltext_bridge(cands, ch)) == [(2, 5, "fulltext"), (3, 2, "summary")]
    assert rows(retrieval.prefer_fulltext(ch), "chunk_id") == [(2,)]
    assert rows(retrieval.prefer_fulltext(ch.where("kind = 'summary'")), "chunk_id") == [(1,), (3,)]
    edges = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "source_id int, target_id string")
    groups = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "group_no int, target_id string")
    assert rows(retrieval.in_every_group(edges, groups)) == [(1,)]
    assert retrieval.wants_probes("comparison", 3)
    assert not retrieval.wants_probes("factoid", 5)


def test_tables_of_documents_in_bounded_tasks(spark, monkeypatch):
    chunks = spark.range(600).select((F.col("id") % 400).alias("chunk_id"), F.format_string("d%02d", F.col("id") % 40).alias("document_id"))
    candidates = spark.range(1000).select((F.col("id") % 250 * 2).alias("chunk_id"))
    tables = spark.createDataFrame([(7, "d02"), (7, "d00"), (5, "d04"), (1, "d01"), (2, "x")], "table_id int, document_id string")
    want = [(5, "d04", 10), (7, "d00", 10), (7, "d02", 10)]
    got = retrieval.tables_of_documents(chunks, candidates, tables)
    assert [tuple(r) for r in got.collect()] == want
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    for times, parts in ((1, 12), (3, 36)):
        more = chunks.crossJoin(spark.range(times)).drop("id")
        got = retrieval.tables_of_documents(more, candidates, tables)
        assert [tuple(r) for r in got.collect()] == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert re.findall(r"RepartitionByExpression \[chunk_id#\d+L?\], (\d+)", plan) == [str(parts)] * 2
    assert rows(retrieval.tables_of_documents(chunks.limit(0), candidates, tables)) == []


def test_mediated_query_aggregates_matched_chunks_only(spark):
    sf = "/root/testdata/sf0.001"
    plan = QUERIES["doc_mediated_tables"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "first(" not in plan
    with duckdb.connect() as db:
        for t in ("lineitem", "orders"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = db.sql(ORACLES["doc_mediated_tables"]).fetchall()
    assert [tuple(r) for r in QUERIES["doc_mediated_tables"](spark, sf).collect()] == want


def test_probe_texts(spark):
    q = spark.createDataFrame([("Who?",)], "text string")
    e = spark.createDataFrame([(0, "who?"), (1, "more")], "n int, text string")
    n = spark.createDataFrame([(0, "Acme"), (1, "MORE"), (9, "late")], "n int, text string")
    assert rows(retrieval.probe_texts(q, e, n)) == [(1, "Who?"), (2, "more"), (3, "Acme")]
    both = retrieval.append_absent([spark.createDataFrame([("a", 0), ("b", 1)], "k string, position int"), spark.createDataFrame([("b", 0), ("c", 1)], "k string, position int")], "k")
    assert rows(both) == [("a", 0, 0), ("b", 0, 1), ("c", 1, 1)]


# --- lifecycle --------------------------------------------------------------------------


def test_stale_only_when_all_sources_go(spark):
    arts = spark.createDataFrame([("x", "ACTIVE"), ("y", "ACTIVE"), ("z", "ACTIVE")], "artifact_id string, status string")
    src = spark.createDataFrame([("x", 1), ("y", 1), ("y", 2)], "artifact_id string, document_id int")
    assert rows(lifecycle.mark_stale(arts, src, spark.createDataFrame([(1,)], "document_id int"))) == [("x", "STALE"), ("y", "ACTIVE"), ("z", "ACTIVE")]


def test_versions_and_upserts(spark):
    stored = spark.createDataFrame([("a", "h1", 1, "ACTIVE", None), ("b", "h2", 1, "ACTIVE", None)], "name string, content_hash string, version long, status string, supersedes string")
    fresh = spark.createDataFrame([("a", "h1"), ("b", "h9"), ("c", "h3")], "name string, content_hash string")
    got = rows(lifecycle.new_versions(stored, fresh), "name", "version", "status")
    assert got == [("a", 1, "ACTIVE"), ("b", 1, "STALE"), ("b", 2, "ACTIVE"), ("c", 1, "ACTIVE")]
    kv = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, n int")
    put = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, n int")
    assert rows(lifecycle.upsert(kv, put, ["k"], "n"), "k", "v") == [(1, "a"), (2, "y"), (3, "z")]


def test_guards(spark):
    t = {"documents": spark.range(3)}
    edges = spark.createDataFrame([("ONTOLOGY",), ("X",)], "relationship_source string")
    with pytest.raises(ValueError):
        lifecycle.wipe_corpus(t, edges, 5, False)
    with pytest.raises(ValueError):
        lifecycle.wipe_corpus(t, edges, 0, True)
    left, kept = lifecycle.wipe_corpus(t, edges, 5, True)
    assert left["documents"].count() == 0
    assert kept.count() == 1
    with pytest.raises(ValueError):
        lifecycle.wipe_ontology(t, {"chunks": spark.range(1)})


def test_conversations_and_scores(spark):
    turns = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(5)], "conv_id long, turn long, role string, text string")
    assert [r.turn for r in lifecycle.history(turns).orderBy("turn").collect()] == [2, 3, 4]
    assert lifecycle.replay(turns).head().transcript.startswith("user: t0\nuser: t1")
    assert lifecycle.next_turn(turns).head().next_turn == 5
    scores = spark.createDataFrame([("m", 0.5), ("m", 1.0)], "metric string, value double")
    assert tuple(lifecycle.evaluation(scores).head()) == ("m", 0.75, 0.5, 1.0, 2, 1)


def test_p95_is_the_exclusive_quantile(spark):
    import statistics

    values = [float(v * v % 37) for v in range(25)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 9.0)], "g string, v double")
    got = dict(rows(lifecycle.p95(df, "v", "g")))
    assert got["a"] == pytest.approx(statistics.quantiles(values, n=20)[-1])
    assert got["b"] == 9.0
