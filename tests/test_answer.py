from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lodestone.hooks import Hooks
from lodestone.plans import answer as a
from lodestone.plans import summaries

EDGE = "source_type string, source_id string, target_type string, target_id string"


def vec(x, y):
    return [float(x), float(y)]


@pytest.fixture(scope="module")
def corpus(spark):
    t = spark.createDataFrame
    return a.Corpus(
        t([("k1", "x#Firm", "Firm", vec(1, 0))], "class_id string, iri string, label string, embedding array<double>"),
        t([("e1", "Acme", vec(1, 0)), ("e2", "Acme Ox", vec(0, 1)), ("e3", "Zebra", vec(0, 1))], "entity_id string, name string, embedding array<double>"),
        t([("YEAR_2024",), ("YEAR_2023",)], "time_identifier string"),
        t(
            [("c1", "d1", "summary", "ACTIVE", "Acme grew", vec(1, 0)), ("c2", "d1", "fulltext", "ACTIVE", "Acme grew in full", vec(1, 0.1)), ("c3", "d2", "summary", "ACTIVE", "in 2024", vec(0.5, 0.5)),
             ("c4", "d3", "summary", "DELETED", "old", vec(1, 0)), ("c5", "d4", "summary", "ACTIVE", "far", vec(0, 9))],
            "chunk_id string, document_id string, kind string, status string, text string, embedding array<double>",
        ),
        t([("a1", "d1", "Finding", "Acme finding", vec(1, 0)), ("t1", "d1", "StructuredTable", "a table", vec(0.9, 0)), ("a9", "d9", "Insight", "unlinked", vec(0, 1))], "artifact_id string, document_id string, artifact_type string, text string, embedding array<double>"),
        t([("chunk", "c1", "entity", "e1"), ("chunk", "c3", "time", "YEAR_2024"), ("chunk", "c4", "entity", "e1"), ("artifact", "a1", "entity", "e1")], EDGE),
    )


HOOKS = Hooks(embed=lambda t: F.array(F.lit(1.0), F.lit(0.0)))


def kinds(said):
    return {(r.kind, r.id) for r in said.evidence.collect()}


def test_full_text_tables_and_times_are_evidence(spark, corpus):
    said = a.answer(corpus, "How did Acme do in 2024?", "simple_qa", hops=1, hooks=HOOKS)
    # the summary c1 gives way to the full text c2 of its document; c4 is deleted; c5 isn't linked; t1 comes by its document
    assert kinds(said) == {("chunk", "c2"), ("chunk", "c3"), ("artifact", "a1"), ("artifact", "t1")}
    assert said.parsed == {"entities": ["Acme"], "time_terms": ["2024"], "intent": "factoid"}
    assert said.matched == {"class": ["Firm"], "entity": ["Acme", "Acme Ox"], "time": ["YEAR_2024"]}
    assert said.text.startswith("[1] ") and "Acme grew in full" in said.text
    assert [r.rank for r in said.evidence.orderBy("rank").collect()] == [1, 2, 3, 4]
    runs, rows = a.record(said, "turn", 7)
    assert runs.head().graph_version == 7 and rows.count() == 4 and rows.select("run_id").distinct().count() == 1


def test_artifacts_alone(spark, corpus):
    said = a.answer(corpus, "How did Acme do in 2024?", "artifact_only", hops=1, hooks=HOOKS)
    assert kinds(said) == {("artifact", "a1"), ("artifact", "t1"), ("artifact", "a9")}


def test_without_a_match_the_nearest_chunks(spark, corpus):
    bare = replace(corpus, classes=corpus.classes.limit(0), entities=corpus.entities.limit(0))
    said = a.answer(bare, "why?", "simple_qa", hooks=HOOKS)
    assert kinds(said) == {("chunk", "c2")}  # full text alone, where there is any
    nothing = replace(bare, chunks=corpus.chunks.limit(0), artifacts=corpus.artifacts.limit(0), edges=corpus.edges.limit(0))
    assert a.answer(nothing, "why?", "deep_research", hooks=HOOKS).evidence.count() == 0
    with pytest.raises(ValueError):
        a.answer(corpus, "x", "summarize")


def test_two_rounds(spark, corpus):
    plan = lambda q: F.struct(F.lit("How did Acme do in 2024?").alias("bridge"), F.lit("Then Zebra?").alias("final"))
    hooks = replace(HOOKS, plan_rounds=plan, answer=lambda texts: F.lit("see [viao:Chunk_1] there"))
    said = a.answer(corpus, "both", "deep_research", hops=1, hooks=hooks)
    assert said.rounds == ["How did Acme do in 2024?", "Then Zebra?"] and said.question == "both"
    assert {"c2", "c3"} <= {i for _, i in kinds(said)}
    assert all(k == "artifact" for k, _ in kinds(a.answer(corpus, "both", "artifact_only", hops=1, hooks=hooks)))
    same = replace(hooks, plan_rounds=lambda q: F.struct(F.lit("BOTH").alias("bridge"), F.lit("x").alias("final")))
    assert a.answer(corpus, "both", "deep_research", hops=1, hooks=same).rounds == []


def test_probes(spark):
    compare = {"intent": "comparison", "entities": ["A", "B", "C"]}
    assert a.probes_for(spark, "q", compare, HOOKS) == ["q", "q A", "q B", "q C"]
    assert a.probes_for(spark, "one? two? three? four", {"intent": "factoid", "entities": []}, HOOKS) == ["one? two? three? four", "one", "two"]
    parsed = a.parse(spark, "Compare Acme Corp, ACME CORP and Bolt", HOOKS)
    assert parsed == {"entities": ["Acme Corp", "Bolt"], "time_terms": [], "intent": "comparison"}


def text_of(n):
    return " ".join(f"Plain sentence here. Number {i} counts." for i in range(n))


def test_summaries_are_revised_until_they_pass(spark):
    docs = spark.createDataFrame([("short", "A few words."), ("long", text_of(40)), ("none", None), ("blank", " ")], "document_id string, text string")
    settings = {"threshold": 50, "window": 100, "overlap": 10, "piece": 60, "n_questions": 4}
    stored, audit, fresh = summaries.evaluated_summaries(docs, **settings)
    got = sorted((r.document_id, r.n, r.summarized, r.text) for r in stored.collect())
    assert ("short", 0, False, "A few words.") in got and {d for d, *_ in got} == {"short", "long"}
    assert [n for d, n, *_ in got if d == "long"] == list(range(sum(d == "long" for d, *_ in got)))
    assert all(r.passed and r.rounds == 2 and r.missing_items > 0 for r in audit.collect())
    assert all("CLAIMS".lower() not in m.lower() or m for r in audit.collect() for m in r.missing_sections)
    again, nothing, none = summaries.evaluated_summaries(docs, replace(Hooks(), summarize=lambda t: F.lit("other")), cache=fresh, **settings)
    assert sorted((r.document_id, r.n, r.summarized, r.text) for r in again.collect()) == got
    assert nothing.count() == 0 and none.count() == 0


def test_rounds_are_bounded_and_failed_windows_are_not_cached(spark):
    docs = spark.createDataFrame([("long", text_of(40))], "document_id string, text string")
    settings = {"threshold": 50, "window": 100, "overlap": 10, "piece": 60, "rounds": 2}
    stubborn = replace(Hooks(), revise=lambda s, m, t: s)
    _, audit, _ = summaries.evaluated_summaries(docs, stubborn, **settings)
    assert {(r.passed, r.rounds) for r in audit.collect()} == {(False, 3)}
    partly = replace(Hooks(), summarize=lambda t: F.when(t.contains("Number 0 "), F.lit("good 1")).otherwise(F.lit("")), revise=lambda s, m, t: F.lit(""))
    stored, _, fresh = summaries.evaluated_summaries(docs, partly, **settings)
    assert [r.text for r in stored.collect()] == ["good 1"] and fresh.count() == 0
    failed = replace(partly, summarize=lambda t: F.lit(""))
    stored, _, _ = summaries.evaluated_summaries(docs, failed, **settings)
    assert stored.where("not summarized").count() == stored.count() > 0
