import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph

NS = "http://t#"
PARENTS = {"Mammal": "Animal", "Bird": "Animal", "Dog": "Mammal", "Cat": "Mammal", "Beagle": "Dog", "Labrador": "Dog", "ChocolateLab": "Labrador"}
REF = "array<struct<kind: string, iri: string>>"


@pytest.fixture(scope="module")
def taxonomy(spark):
    names = ["Animal", *PARENTS, "Person", "Habitat"]
    classes = spark.createDataFrame([(NS + n, n, [("entity", NS + PARENTS[n])] if n in PARENTS else []) for n in names], f"iri string, label string, superclasses {REF}")
    props = spark.createDataFrame(
        [(NS + "owns", [("entity", NS + "Person")], [("entity", NS + "Dog")]), (NS + "livesIn", [("entity", NS + "Animal")], [("entity", NS + "Habitat")]), (NS + "flies", [("entity", NS + "Bird")], [("entity", NS + "Bird")])],
        f"iri string, domain {REF}, range {REF}",
    )
    return classes, props


def names(df, column="node"):
    return sorted(r[0].removeprefix(NS) for r in df.select(column).collect())


def seeds(spark, *n):
    return spark.createDataFrame([(NS + x,) for x in n], "node string")


def test_closure_leaves_siblings_out(spark, taxonomy):
    isa = graph.isa_index(taxonomy[0])
    assert names(graph.closure(isa, seeds(spark, "Beagle"))) == ["Animal", "Beagle", "Dog", "Mammal"]
    assert names(graph.closure(isa, seeds(spark, "Dog"))) == ["Animal", "Beagle", "ChocolateLab", "Dog", "Labrador", "Mammal"]


def test_subtree_depth(spark, taxonomy):
    isa = graph.isa_index(taxonomy[0])
    got = {r[0].removeprefix(NS): r[1] for r in graph.subtree(isa, seeds(spark, "Dog"), 1).collect()}
    assert got == {"Dog": 0, "Beagle": 1, "Labrador": 1}


def test_keep_set_pulls_partners_in_and_protects(spark, taxonomy):
    got = names(graph.keep_set(*taxonomy, seeds(spark, "Beagle")))
    assert got == ["Animal", "Beagle", "Dog", "Habitat", "Mammal", "Person"]
    assert "Bird" in names(graph.keep_set(*taxonomy, seeds(spark, "Beagle"), (NS + "Bi",)))


def test_prune(spark, taxonomy):
    classes, props = graph.prune(*taxonomy, seeds(spark, "Beagle"))
    assert names(classes, "iri") == ["Animal", "Beagle", "Dog", "Habitat", "Mammal", "Person"]
    assert names(props, "iri") == ["livesIn", "owns"]
    assert classes.where(f"iri = '{NS}Dog'").select("superclasses.iri").head()[0] == [NS + "Mammal"]


def test_nothing_detected_changes_nothing(spark, taxonomy):
    classes, props = graph.prune(*taxonomy, spark.createDataFrame([], "node string"))
    assert classes.count() == taxonomy[0].count()
    assert props.count() == 3


def test_prune_instances_needs_a_kept_type(spark):
    rows = spark.createDataFrame([("a", [("e", "k")]), ("b", [("e", "x")])], f"iri string, types {REF}")
    assert [r[0] for r in graph.prune_instances(rows, spark.createDataFrame([("k",)], "node string")).collect()] == ["a"]


def test_top_level_branches(taxonomy):
    assert [r.label for r in graph.top_level_branches(taxonomy[0]).collect()] == ["Animal", "Habitat", "Person"]


def test_immediate_edges_and_properties(taxonomy):
    rows = {tuple(r) for r in graph.immediate_edges(*taxonomy).where(f"node = '{NS}Dog'").collect()}
    assert (NS + "Dog", "parent", NS + "Mammal", None) in rows
    assert (NS + "Dog", "range_of", NS + "Person", NS + "owns") in rows
    by = {(r[0], r[1]): r[2] for r in graph.properties_by_class(taxonomy[1]).collect()}
    assert by[NS + "Animal", "domain"] == [NS + "livesIn"]


def test_known_places_and_slices(spark):
    classes = spark.createDataFrame([("c", "Country", []), ("f", "France", [("e", "c")]), ("p", "Paris", [("e", "f")]), ("d", "Dog", [])], f"iri string, label string, superclasses {REF}")
    assert sorted(r[0] for r in graph.known_places(classes, ("Country",)).collect()) == ["country", "france", "paris"]
    edges = graph.isa_index(classes).select(F.col("child").alias("a"), F.col("parent").alias("b"))
    hit = graph.slice_for(classes, edges, spark.createDataFrame([("p",)], "node string"), ("d",))
    assert sorted(r[0] for r in hit.select("iri").collect()) == ["d", "f", "p"]
    assert graph.slice_for(classes, edges, spark.createDataFrame([], "node string"), ("d",)).count() == 0


def test_negative_hops_are_an_error(spark):
    edges = spark.createDataFrame([("a", "b")], "a string, b string")
    with pytest.raises(ValueError):
        graph.neighbourhood(edges, spark.createDataFrame([("a",)], "node string"), -1)


@pytest.mark.parametrize("seed", [1, 2])
def test_bfs_matches_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(14), rng.randrange(14)) for _ in range(18)]
    edges = spark.createDataFrame([("n", a, "n", b) for a, b in pairs], "source_type string, source_id long, target_type string, target_id long")
    around = {}
    for a, b in pairs:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    want, frontier = {0: 0}, {0}
    for hop in range(1, 4):
        frontier = {y for x in frontier for y in around.get(x, ())} - set(want)
        want |= dict.fromkeys(frontier, hop)
    got = graph.bfs(edges, spark.createDataFrame([("n", 0)], "node_type string, node_id long"), 3, 0.5)
    assert {(r.node_id, r.hop, r.score) for r in got.collect()} == {(n, h, 0.5**h) for n, h in want.items()}


def test_components(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("f", "f")], "a string, b string")
    assert {r[0]: r[1] for r in graph.components(links).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r[1] for r in graph.components(chain).collect()} == {0}


def test_visible_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "b")], "a string, b string")
    assert [tuple(r) for r in graph.visible_edges(edges, spark.createDataFrame([("a",), ("b",)], "node string")).collect()] == [("a", "b")]
