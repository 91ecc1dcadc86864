import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions.vectors import hashed_embedding
from lodestone.plans import ingest, retrieve, versions
from lodestone.sources import documents, ontology, tables
from lodestone.streaming import incremental, tumbling

RDFXML = """<?xml version="1.0"?>
<!DOCTYPE rdf:RDF [ <!ENTITY ex "http://ex.org/o#"> <!ENTITY dog "&ex;Dog"> ]>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xml:base="http://ex.org/o">
  <owl:Ontology rdf:about="http://ex.org/o"><owl:imports rdf:resource="http://far.org/base.owl"/></owl:Ontology>
  <owl:Class rdf:about="#Animal"><rdfs:label xml:lang="en">Animal</rdfs:label></owl:Class>
  <owl:Class rdf:about="&dog;"><rdfs:subClassOf rdf:resource="&ex;Animal"/>
    <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="&ex;eats"/><owl:someValuesFrom rdf:resource="&ex;Food"/></owl:Restriction></rdfs:subClassOf></owl:Class>
  <owl:ObjectProperty rdf:about="&ex;eats"><rdfs:domain rdf:resource="&ex;Animal"/><rdfs:range rdf:resource="&ex;Food"/><rdf:type rdf:resource="http://www.w3.org/2002/07/owl#TransitiveProperty"/></owl:ObjectProperty>
  <owl:NamedIndividual rdf:about="&ex;rex"><rdf:type rdf:resource="&ex;Dog"/></owl:NamedIndividual>
</rdf:RDF>"""

TURTLE = """@prefix ex: <http://ex.org/o#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
# comment
ex:Dog a owl:Class ; rdfs:label "Dog"@en, "Hund"@de ; rdfs:subClassOf ex:Animal , [ a owl:Restriction ; owl:onProperty ex:eats ; owl:someValuesFrom ex:Food ] .
ex:Food a owl:Class ; rdfs:comment "what \\"is\\" eaten" . ex:n ex:size 4.5 .
"""


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("a.owl", RDFXML.encode()), ("b.ttl", TURTLE.encode()), ("bad.owl", b"<rdf:RDF")], "name string, content binary")


@pytest.fixture(scope="module")
def triples(spark, files):
    return ontology.triples(files).cache()


def test_a_bad_file_is_one_error_row(triples):
    bad = triples.where("error is not null").collect()
    assert [r.source for r in bad] == ["bad.owl"]


def test_records(triples):
    classes = {r.iri: r for r in ontology.classes(triples).collect()}
    dog = classes["http://ex.org/o#Dog"]
    assert dog.labels == ["Dog", "Hund"]
    assert [s.iri for s in dog.superclasses] == ["http://ex.org/o#Animal"]
    assert dog.sources == ["a.owl", "b.ttl"]
    assert classes["http://ex.org/o#Animal"].label == "Animal"
    prop = ontology.properties(triples).head()
    assert (prop.domain[0].iri, prop.range[0].iri, prop.characteristics) == ("http://ex.org/o#Animal", "http://ex.org/o#Food", ["TransitiveProperty"])
    assert [t.iri for t in ontology.instances(triples).where("name = 'rex'").head().types] == ["http://ex.org/o#Dog"]
    assert {tuple(r) for r in ontology.restrictions(triples).collect()} == {("http://ex.org/o#Dog", "http://ex.org/o#eats", "http://ex.org/o#Food", "someValuesFrom")}


def test_blank_axioms_can_go(triples):
    left = ontology.named_only(triples.where("source = 'b.ttl'")).where("predicate like '%subClassOf'")
    assert [r.object for r in left.collect()] == ["http://ex.org/o#Animal"]


def test_merge_and_rewrite(spark, triples):
    classes = ontology.classes(triples)
    merged = ontology.merge([classes, classes.where("name = 'Dog'")])
    assert merged.count() == classes.count()
    moved = ontology.rewrite(triples, spark.createDataFrame([("http://ex.org/o#Dog", "http://new#Dog")], "old string, new string"))
    assert moved.where("subject = 'http://ex.org/o#Dog' or object = 'http://ex.org/o#Dog'").count() == 0
    assert {r.label for r in ontology.label_index(classes).collect()} == {"animal", "dog", "hund", "food"}


def test_export_round_trip(spark, triples, tmp_path):
    classes, props = ontology.classes(triples), ontology.properties(triples)
    wanted = {tuple(r) for r in ontology.to_triples(classes, props).collect()}
    ontology.write_owl(ontology.to_triples(classes, props), str(tmp_path / "owl"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "owl").glob("part-*")))
    assert {(s, p, o, lit) for s, p, o, lit, _ in ontology.parse_rdfxml(text)} == wanted


def test_imports(spark, files):
    local = spark.createDataFrame([("base.owl",), ("a.owl",)], "name string")
    found = ontology.resolvable(ontology.imports(files), local)
    assert [tuple(r) for r in found.collect()] == [("a.owl", "http://far.org/base.owl", "base.owl")]
    assert [r[0] for r in ontology.root_files(local, found.select("name", "url")).collect()] == ["a.owl"]
    left = spark.createDataFrame([(RDFXML,)], "x string").select(ontology.without_imports(F.col("x"), F.array(F.lit("http://far.org/base.owl")))).head()[0]
    assert "imports" not in left
    xml = '<catalog><uri name="http://x/y" uri="y.owl"/></catalog>'
    assert spark.createDataFrame([(xml,)], "x string").select(ontology.catalog(F.col("x"))).head()[0] == {"http://x/y": "y.owl"}


def test_unknown_suffix_is_an_error(spark, tmp_path):
    (tmp_path / "a.doc").write_text("x")
    with pytest.raises(ValueError):
        ontology.load(spark, str(tmp_path))


def test_document_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \x00 ok \xff")
    (tmp_path / "sub/b.TXT").write_text("the and of " * 30)
    (tmp_path / "empty.txt").write_text("  ")
    (tmp_path / "x.bin").write_text("no")
    got = {r.name: r for r in documents.load_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "b.TXT"}
    assert got["a.txt"].text.startswith("café  ok")
    assert documents.preflight(documents.load_documents(spark, str(tmp_path))).where("readable").count() == 2
    assert documents.provenance(documents.read_files(spark, str(tmp_path))).count() == 4
    (tmp_path / "x.pdf").write_bytes(b"not a PDF file")
    (tmp_path / "odd.txt").write_text("zzxq vvkj " * 60)
    left = {r.name: r.reason for r in documents.skipped(spark, str(tmp_path)).collect()}
    assert set(left) == {"empty.txt", "x.pdf", "odd.txt"} and "PDF" in left["x.pdf"]
    assert (left["empty.txt"], left["odd.txt"]) == ("blank", "does not look like language")


def test_questions_and_suggestions(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# note\n\nWho?\n[GAP] What?\n[gap]\n")
    assert [tuple(r) for r in documents.read_questions(spark, str(tmp_path / "q.txt")).collect()] == [("Who?", False), ("What?", True), ("[gap]", False)]
    (tmp_path / "s.json").write_text(json.dumps([{"CLASS_TYPE": "Dog", "PARENT_CLASS_TYPE": ""}]))
    assert tuple(documents.read_suggestions(spark, str(tmp_path / "s.json")).head()) == ("Dog", "", None)
    (tmp_path / "t.json").write_text(json.dumps([{"CLASS_DESCRIPTION": "x"}]))
    with pytest.raises(ValueError):
        documents.read_suggestions(spark, str(tmp_path / "t.json"))


def test_tables(spark):
    grid = [["Metric", "2023", "2024"], ["BYD", "1,000", "2"], ["Total", "3", "BYD Co"]]
    df = spark.createDataFrame([(1, "ab" * 32, 0, "Sales", 3, grid)], "table_id int, content_hash string, table_index int, caption string, page_number int, grid array<array<string>>")
    made = tables.from_grid(df)
    table = made.head().table
    assert [c.columnLabel for c in table.columns] == ["2023", "2024"]
    assert [r.rowLabel for r in table.rows] == ["BYD", "Total"]
    assert [r.value for r in tables.candidates(made).orderBy("position").collect()] == ["Sales", "BYD", "BYD Co"]
    assert made.select(tables.summary("table", 2)).head()[0] == "Sales\nColumns: 2023 | 2024\nBYD: 1,000 | 2"
    assert made.select(tables.problems("table")).head()[0] == []
    assert made.select(tables.problems(F.col("table").withField("columns", F.slice("table.columns", 1, 1)))).head()[0] == ["a cell of an unknown column"]


def test_versions(spark, tmp_path):
    taken = {versions.version_name(set())}
    assert versions.version_name({"v1"}) not in {"v1"}
    assert versions.version_name(taken).startswith("v")
    versions.write_version({"classes": spark.range(3)}, str(tmp_path / "v"), {"stage": "merge"})
    found, manifest = versions.read_version(spark, str(tmp_path / "v"), ["classes"])
    assert found["classes"].count() == 3
    assert manifest == {"stage": "merge", "counts": {"classes": 3}}


def test_graph_from_documents(spark):
    docs = spark.createDataFrame([(1, "Acme grew 5 percent in Q1 2024.\n\nNothing else."), (2, "Acme grew 5 percent in Q1 2024.\n\nNothing else."), (3, "Globex was born in March 2023.")], "doc_id long, text string")
    entities = spark.createDataFrame([("e1", "Acme Inc"), ("e2", "Globex")], "entity_id string, name string")
    built = ingest.build_graph(docs, entities)
    assert built.documents.count() == 2
    kinds = {r[0]: r[1] for r in built.edges.groupBy("predicate").count().collect()}
    assert kinds["chunkOf"] == 2
    assert kinds["hasTime"] == 2
    assert built.edges.where("predicate = 'assertsAbout' and source_type = 'chunk'").count() == 2
    assert built.times.where("time_level = 'month'").count() == 1
    with pytest.raises(ValueError):
        ingest.edge(docs, "a", "doc_id", "unknown", "b", "doc_id", "X")


def test_retrieve(spark):
    items = spark.createDataFrame([(1, "chunk", "about dogs"), (2, "chunk", "about cats"), (3, "chunk", "far away")], "id long, node_type string, text string").withColumn("embedding", hashed_embedding("text", 16))
    edges = spark.createDataFrame([("chunk", 1, "entity", 10), ("chunk", 2, "entity", 10), ("chunk", 3, "entity", 11)], "source_type string, source_id long, target_type string, target_id long")
    probes = spark.createDataFrame([(0, "dogs")], "probe int, q string").select("probe", hashed_embedding("q", 16).cast("array<double>").alias("probe_vector"))
    got = retrieve.retrieve(retrieve.Store(edges, items), spark.createDataFrame([("entity", 10)], "node_type string, node_id long"), probes, max_hops=1)
    assert [r.id for r in got.collect()] == [1, 2]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    for _ in range(2):
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
        incremental(stream, lambda df: df.withColumn("n", F.length("text")), out, checkpoint, "doc_id").awaitTermination()
    assert spark.read.parquet(out).count() == 2
    events = spark.sql("select timestamp '2024-01-01 00:10:00' ts, 'a' event_type, 2.0D value union all select timestamp '2024-01-01 00:50:00', 'a', 3.0D")
    assert [(r.n, r.total) for r in tumbling(events).collect()] == [(2, 5.0)]
