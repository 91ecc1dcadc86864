import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.plans import browse, conversation, ingest
from lodestone.sources import web


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_search_results(spark):
    hit = '<div class="result x"><a rel="n" class="result__a" href="{0}">A <b>title</b></a><a class="result__snippet" href=x>Some  text</a></div>'
    page = "<html>" + hit.format("//e.org/l/?uddg=https%3A%2F%2Fa.org%2Fx&amp;rut=1") + hit.format("https://b.org") + hit.format("https://b.org") + hit.format("ftp://c") + "</html>"
    got = web.search_results(spark.createDataFrame([(1, page)], "page_id long, html string"))
    assert rows(got, "position", "title", "url", "snippet") == [(0, "A title", "https://a.org/x", "Some text"), (1, "A title", "https://b.org", "Some text")]
    df = spark.createDataFrame([("text/html", b"%PDF-1.4", "https://a/x"), ("text/html", b"<html>", "https://a/x.PDF?y"), ("text/html", b"<", "https://a/x")], "t string, b binary, u string")
    assert [r[0] for r in df.select(web.is_pdf("t", "b", "u")).collect()] == [True, True, False]


def test_filings(spark):
    index = json.dumps({"directory": {"item": [{"name": "x-index.html"}, {"name": "R1.htm"}, {"name": "exhibit1.htm"}, {"name": "acme-2024.htm"}, {"name": "a.pdf"}, {"name": "b", "description": "PDF copy"}]}})
    df = spark.createDataFrame([(index, "0000320193", "0000320193-24-000123"), (None, "1", "2")], "i string, cik string, a string")
    got = df.select(web.primary_document("i"), web.pdf_items("i"), web.filing_index_url("https://h/", "cik", "a"), web.filing_document_url("https://h", "cik", "a", F.lit("d.htm"))).collect()
    assert tuple(got[0]) == ("acme-2024.htm", ["a.pdf", "b"], "https://h/320193/000032019324000123/index.json", "https://h/320193/000032019324000123/d.htm")
    assert tuple(got[1])[:2] == (None, [])
    html = "<p>Sales <ix:nonFraction name='x'>5</ix:nonFraction></p><div style='Display: none'>hidden</div><link href='a.xsd'>"
    assert spark.createDataFrame([(html,)], "h string").select(web.without_inline_facts("h")).head()[0] == "<p>Sales 5</p>"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "o.zip", "w") as z:
        z.writestr("d/a.ttl", "x")
        z.writestr("b.owl", "y")
    df = spark.createDataFrame([("o.zip", (tmp_path / "o.zip").read_bytes()), ("c.owl", b"z")], "name string, content binary")
    assert rows(web.unzipped(df)) == [("a.ttl", b"x"), ("b.owl", b"y"), ("c.owl", b"z")]


def test_browsing(spark):
    docs = spark.createDataFrame([("d1", "One", "ACTIVE"), ("d2", "Two", "DELETED")], "document_id string, title string, status string")
    chunks = spark.createDataFrame([("c1", "d1", 0, "x" * 300), ("c2", "d1", 1, "y")], "chunk_id string, document_id string, chunk_index int, text string")
    edges = spark.createDataFrame([("chunk", "c1", "assertsAbout", "entity", "e1", "DOCUMENT_EXTRACTION"), ("artifact", "a1", "assertsAbout", "entity", "e1", "LLM_INFERENCE")], "source_type string, source_id string, predicate string, target_type string, target_id string, relationship_source string")
    entities = spark.createDataFrame([("e1", "Acme", "k")], "entity_id string, name string, class_iri string")
    classes = spark.createDataFrame([("k2", "Sub", [("k",)])], "iri string, label string, superclasses array<struct<iri: string>>")
    assert rows(browse.list_documents(docs, chunks), "document_id", "n_chunks") == [("d1", 2)]
    assert [r.snippet for r in browse.document(docs, chunks, "d1").collect()] == ["x" * 200 + "...", "y..."]
    assert rows(browse.entity("e1", edges, chunks, docs), "chunk_id", "title") == [("c1", "One")]
    assert rows(browse.ontology_class("k", classes, entities), "kind", "id") == [("entity", "e1"), ("subclass", "k2")]
    sources = spark.createDataFrame([("a1", "c2")], "artifact_id string, chunk_id string")
    assert rows(browse.artifact("a1", sources, chunks, docs, edges, entities), "kind", "id") == [("entity", "e1"), ("source", "c2")]


def test_conversations(spark):
    new = conversation.start(spark, 'A "quoted" title', 1).head()
    assert json.loads(new.metadata) == {"title": 'A "quoted" title'}
    turns = spark.createDataFrame([], conversation.TURN)
    evidence = spark.createDataFrame([(1, 0.5, "second"), (2, 0.9, "first")], "id long, score double, text string")
    turns = conversation.add_turn(turns, new.conv_id, "Why?", evidence)
    turns = conversation.add_turn(turns, new.conv_id, "And?", evidence)
    got = rows(turns, "turn", "role", "text")
    assert got[1] == (1, "assistant", "[1] first\n[2] second")
    assert [r[0] for r in got] == [0, 1, 2, 3]
    assert [r.turn for r in conversation.context(turns, new.conv_id).collect()] == [1, 2, 3]


def test_reports(spark):
    answers = spark.createDataFrame([("who is acme", "acme is a firm", "acme is a firm", False), ("what", "", "", True)], "question string, answer string, evidence string, expected_gap boolean")
    scores = conversation.judge(answers)
    assert scores.count() == 6
    assert scores.where("metric = 'gap_detection'").agg(F.min("value")).head()[0] == 1.0
    lines = [r.line for r in conversation.report(scores, spark.createDataFrame([(3.0,)], "seconds double")).orderBy("part").collect()]
    assert "| wall seconds | p95 3.0 | |" in lines
    assert any(x.startswith("- `what`") for x in lines)


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "o").mkdir()
    (tmp_path / "o/a.ttl").write_text("@prefix e: <http://e#> . @prefix o: <http://www.w3.org/2002/07/owl#> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> . e:A a o:Class . e:B a o:Class ; r:subClassOf e:A . e:C a o:Class .")
    run = lambda *a: cli.parser().parse_args([str(x) for x in a])
    for command in (("merge", tmp_path / "o", tmp_path / "v1"), ("prune", tmp_path / "v1", tmp_path / "v2", "--keep", "http://e#B"), ("export", tmp_path / "v2", tmp_path / "owl")):
        args = run(*command)
        args.run(spark, args)
    assert rows(spark.read.parquet(str(tmp_path / "v2/classes")), "iri") == [("http://e#A",), ("http://e#B",)]
    assert "http://e#B" in "".join(p.read_text() for p in (tmp_path / "owl").glob("part-*"))
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.txt").write_text("Acme grew in 2024.")
    (tmp_path / "e.csv").write_text("entity_id,name\ne1,Acme\n")
    for command in (("register", tmp_path / "d", tmp_path / "g", "--entities", tmp_path / "e.csv"), ("status", tmp_path / "g"), ("query", tmp_path / "g", "acme 2024")):
        args = run(*command)
        args.run(spark, args)
    out = capsys.readouterr().out
    assert "Acme grew in 2024." in out


def test_names_of_many_words_are_linked(spark):
    long = "International Bank for Reconstruction and Development of Rural Areas"
    chunks = spark.createDataFrame([("c1", f"In May the {long} lent."), ("c2", "Acme sold it."), ("c3", "")], "chunk_id string, text string")
    entities = spark.createDataFrame([("e1", long), ("e2", "Acme")], "entity_id string, name string")
    linked = lambda *a: sorted((r.source_id, r.target_id) for r in ingest.link_entities(chunks, *a).collect())
    assert linked(entities) == [("c1", "e1"), ("c2", "e2")]
    assert linked(entities.limit(0)) == []


def test_version_counter_never_gives_a_number_twice(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from lodestone.plans.ontology_import import VersionCounter

    counter = VersionCounter(spark, f"file://{tmp_path}/version")
    with pytest.raises(RuntimeError):
        counter.current()
    counter.start()
    counter.start()
    assert counter.current() == 0
    with ThreadPoolExecutor(4) as pool:
        given = list(pool.map(lambda _: counter.bump(), range(24)))
    assert sorted(given) == list(range(1, 25))
    assert counter.current() == 24


def test_ontology_import_again_changes_nothing(spark):
    from pyspark.sql import functions as F

    from lodestone.plans import ontology_import as o

    entity = "array<struct<iri: string>>"
    classes = spark.createDataFrame([("x#a", "a", ["Alpha"], ["first\x00"], [("x#b",), ("x#a",), ("far#z",)], []), ("x#b", "b", [], [], [], [("x#a",)]), ("x#c", "c", ["Gone"], [], [], [])], f"iri string, name string, labels array<string>, descriptions array<string>, superclasses {entity}, equivalent_to {entity}")
    five = "iri string, label string, description string, namespace string, source string"
    stored = spark.createDataFrame([("x#c", "Old", None, "x#", None, [0.5])], five + ", embedding array<double>")
    edges = spark.createDataFrame([], ", ".join(f"{c} string" for c in o.EDGE[:-1]) + ", graph_version long")
    instances = spark.createDataFrame([("x#i", "i", [("x#a",)])], f"iri string, name string, types {entity}")
    store = o.Store(stored, spark.createDataFrame([], five + ", kind string"), spark.createDataFrame([], five + ", type_iri string"), edges)
    embed = lambda t: F.array(F.length(t).cast("double"))
    once = o.import_ontology(store, classes, {}, instances, 4, embed)
    twice = o.import_ontology(once, classes, {}, instances, 5, lambda t: F.array(F.lit(-1.0)))
    assert {r.iri: (r.label, r.description, r.embedding) for r in once.classes.collect()} == {"x#a": ("Alpha", "first", [13.0]), "x#b": ("b", None, [1.0]), "x#c": ("Old", None, [0.5])}
    assert sorted(map(str, once.classes.collect())) == sorted(map(str, twice.classes.collect()))
    assert sorted((r.source_id, r.predicate, r.target_id, r.graph_version) for r in once.edges.collect()) == [("x#a", "subClassOf", "x#b", 4), ("x#b", "equivalentClass", "x#a", 4)]
    assert twice.edges.count() == 2 and o.as_of(twice.edges, 4).count() == 0
    assert [(r.iri, r.type_iri) for r in twice.instances.collect()] == [("x#i", "x#a")]
