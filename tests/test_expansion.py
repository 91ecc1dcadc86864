import pytest
from pyspark.sql import functions as F

from lodestone.functions.shapes import entity_shape
from lodestone.functions.text import OWL_THING
from lodestone.operators import expansion as X

BASE, GEO = "http://me#", "http://x/ontology/geography#"
SCHEMA = "iri string, label string, parent string, descriptions array<string>, origin string"


@pytest.fixture(scope="module")
def classes(spark):
    rows = [(GEO + "Country", "Country"), (GEO + "Strait", "Strait"), (GEO + "Place", "Place"), ("http://org#Organization", "Organization"), ("http://org#Person", "Person")]
    return spark.createDataFrame([(i, l, OWL_THING, [], "source") for i, l in rows], SCHEMA)


def by_label(df):
    return {r.label: r for r in df.collect()}


def test_chains_of_proposals_and_folding(spark, classes):
    proposals = spark.createDataFrame(
        [
            ("Sub Company", "leaf", "Company"), ("Company", "mid", "Organization"), ("Lost", "", "Nowhere"), ("organization", "an old one", "NONE"),
            ("Washington D.C.", "a", "NONE"), ("Washington DC", "b", None), ("EV bus", "x", "Country"), ("Bering Strait", "", "Strait"), ("", "", None),
        ],
        "label string, description string, parent_label string",
    )
    got = by_label(X.add_classes(classes, proposals, BASE))
    assert got["Company"].parent == "http://org#Organization"
    assert got["Company"].iri == "http://org#company"
    assert got["Sub Company"].parent == "http://org#company"
    assert got["Lost"].parent is None
    assert got["Organization"].descriptions == ["an old one"]
    assert got["Washington D.C."].descriptions == ["a", "b"]
    assert "Washington DC" not in got
    assert got["EV bus"].iri == BASE + "ev_bus"
    assert got["Bering Strait"].iri == GEO + "bering_strait"
    assert len(got) == 5 + 6


def test_instances_and_relations(spark, classes):
    inst = X.add_instances(classes, spark.createDataFrame([("Acme", "organization"), ("Bob", "Alien")], "label string, type_label string"), BASE)
    assert [tuple(r) for r in inst.collect()] == [(BASE + "acme", "Acme", "http://org#Organization")]
    props = spark.createDataFrame([("http://org#worksFor", "works for")], "iri string, label string")
    rel = spark.createDataFrame([("works for", "Person", "Organization"), ("makes", "Organization", "Helium"), ("bad", "x" * 90, "Person"), ("bad", "a\nb", "Person")], "label string, domain string, range string")
    more, relations = X.add_relations(classes, props, rel, BASE)
    assert {tuple(r) for r in relations.collect()} == {("http://org#worksFor", "works for", "http://org#Person", "http://org#Organization"), (BASE + "makes", "makes", "http://org#Organization", BASE + "helium")}
    assert by_label(more)["Helium"].origin == "relation"


def test_grouping(spark, classes):
    extra = classes.union(spark.createDataFrame([(BASE + "bus", "Bus", OWL_THING, [], "proposal"), (BASE + "tram", "Tram", GEO + "Place", [], "proposal")], SCHEMA))
    assert [r.label for r in X.orphans(extra, BASE).collect()] == ["Bus"]
    concepts = spark.createDataFrame([("Vehicle", "moves")], "label string, description string")
    assign = spark.createDataFrame([("bus", "vehicle"), ("Tram", "Vehicle"), ("Vehicle", "Vehicle"), ("none", "Vehicle")], "class_label string, concept_label string")
    got = by_label(X.apply_grouping(extra, concepts, assign, BASE))
    assert got["Bus"].parent == BASE + "vehicle"
    assert got["Tram"].parent == GEO + "Place"
    assert got["Vehicle"].origin == "concept"


def test_landforms(spark, classes):
    extra = classes.union(
        spark.createDataFrame(
            [(BASE + "strait_of_hormuz", "Strait of Hormuz", OWL_THING, [], "p"), (BASE + "hormuz_crisis", "Strait of Hormuz crisis", OWL_THING, [], "p"), (BASE + "big_river", "Big River", None, [], "p"), (BASE + "child", "Child", BASE + "big_river", [], "p")], SCHEMA
        )
    )
    moves = X.place_landforms(extra)
    got = {r.old: (r.new, r.parent) for r in moves.collect()}
    assert got == {BASE + "strait_of_hormuz": (GEO + "strait_of_hormuz", GEO + "Strait"), BASE + "big_river": (GEO + "big_river", GEO + "Place")}
    moved = by_label(X.move(extra, moves))
    assert moved["Child"].parent == GEO + "big_river"


def test_audit_and_promotion(spark, classes):
    extra = classes.union(spark.createDataFrame([(BASE + "anna", "Anna Smith", "http://org#Person", [], "p"), (BASE + "gulf_war", "Gulf war", OWL_THING, [], "p"), (BASE + "oil", "Oil", OWL_THING, [], "p")], SCHEMA))
    decisions = spark.createDataFrame([(BASE + "anna", "KEEP", None), (BASE + "gulf_war", "RE_HOME", "Event"), (BASE + "oil", "RE_HOME", "")], "iri string, action string, new_parent string")
    left, made = X.apply_audit(extra, decisions, BASE)
    got = by_label(left)
    assert got["Gulf war"].parent == BASE + "event"
    assert got["Event"].origin == "audit"
    assert got["Oil"].parent == OWL_THING
    assert [tuple(r) for r in made.collect()] == [(BASE + "anna", "Anna Smith", "http://org#Person")]
    keep, entities = X.promote_entities(spark.createDataFrame([("Acme Ltd",), ("Dog",)], "label string"), entity_shape("label"))
    assert [r.label for r in keep.collect()] == ["Dog"]
    assert [r.reason for r in entities.collect()] == ["corporate-suffix"]


def test_coercion_and_cache(spark, classes):
    rows = spark.createDataFrame([("PERSON ",), ("Robot",), ("role",)], "parent_label string")
    got = X.coerce_labels(rows, "parent_label", {"person": "http://org#Person", "role": "http://org#Role"}, classes)
    assert sorted(r[0] for r in got.collect()) == ["Robot", "http://org#Person", "role"]
    store = spark.createDataFrame([("a", "1")], "key string, value string")
    both, made = X.cached(spark.createDataFrame([("a",), ("b",)], "key string"), store, lambda k: k.withColumn("value", F.upper("key")))
    assert {tuple(r) for r in both.collect()} == {("a", "1"), ("b", "B")}
    assert made.count() == 1
    assert [r.batch for r in X.batches_of(store.union(both), 2, "key").orderBy("batch").collect()] == [0, 0, 1]
