"""Ontology tables into the store: upserts, embeddings where they lack, ontology edges anew, and the graph's version counter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import embed_text, first_nonblank, namespace_of, strip_nul
from ..operators.lifecycle import upsert

CLASS, PROPERTY = ["iri", "label", "description", "namespace", "source", "embedding"], ["iri", "label", "description", "namespace", "source"]
EDGE = ["source_type", "source_id", "predicate", "target_type", "target_id", "relationship_source", "graph_version"]


@dataclass
class Store:
    """``classes`` (columns CLASS), ``properties`` (PROPERTY and kind), ``instances`` (PROPERTY and type_iri), ``edges`` (EDGE)."""

    classes: DataFrame
    properties: DataFrame
    instances: DataFrame
    edges: DataFrame


def _first(df: DataFrame, *columns: str) -> Column:
    """The first value of the first list that has one that isn't blank; lists that a table lacks count as empty."""
    return F.coalesce(*[first_nonblank(c) for c in columns if c in df.columns], F.lit(None).cast("string"))


def _records(df: DataFrame) -> DataFrame:
    """``df(iri, name, labels, descriptions, comments, sources, ...)`` with the columns PROPERTY, free of NUL characters."""
    label = F.coalesce(_first(df, "labels"), F.col("label") if "label" in df.columns else F.col("name"))
    own = df.withColumn("_label", strip_nul(label)).withColumn("_description", strip_nul(_first(df, "compact_description", "descriptions", "comments")))
    return own.withColumns({"label": F.col("_label"), "description": F.col("_description"), "namespace": namespace_of("iri"), "source": _first(df, "sources")}).drop("_label", "_description")


def import_classes(stored: DataFrame, incoming: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Classes after an import: those stored with an embedding stay, others are embedded and replace theirs; blank ones are left out."""
    done = stored.where("embedding is not null").select("iri")
    rows = _records(incoming).join(done, "iri", "left_anti").withColumn("_text", embed_text("label", "description")).where(F.col("_text") != "")
    return upsert(stored, rows.withColumn("embedding", embed(F.col("_text"))).select(*CLASS), ["iri"])


def ontology_edges(classes: DataFrame, known: DataFrame, version: int) -> DataFrame:
    """``subClassOf`` and ``equivalentClass`` edges of ``classes(iri, superclasses, equivalent_to)`` between different ``known(iri)``."""
    pairs = [classes.select(F.col("iri").alias("source_id"), F.lit(p).alias("predicate"), F.explode(F.transform(c, lambda x: x["iri"])).alias("target_id")) for p, c in (("subClassOf", "superclasses"), ("equivalentClass", "equivalent_to")) if c in classes.columns]
    both = pairs[0] if len(pairs) == 1 else pairs[0].union(pairs[1])
    ends = known.select("iri").distinct()
    met = both.where("source_id <> target_id").join(ends.withColumnRenamed("iri", "source_id"), "source_id", "left_semi").join(ends.withColumnRenamed("iri", "target_id"), "target_id", "left_semi").distinct()
    kind = F.lit("ontology_class")
    return met.select(kind.alias("source_type"), "source_id", "predicate", kind.alias("target_type"), "target_id", F.lit("ONTOLOGY").alias("relationship_source"), F.lit(version).cast("long").alias("graph_version"))


def import_ontology(store: Store, classes: DataFrame, properties: dict[str, DataFrame], instances: DataFrame, version: int, embed: Callable[[Column], Column]) -> Store:
    """The store after an import of ontology tables as :mod:`lodestone.sources.ontology` reads them.

    ``properties`` maps a kind to its table. Ontology edges are made anew, so that importing again changes nothing;
    other edges stay. ``version`` stamps the new edges; bump the counter afterwards.
    """
    kept = import_classes(store.classes, classes, embed)
    props = store.properties
    for kind, rows in properties.items():
        props = upsert(props, _records(rows).select(*PROPERTY, F.lit(kind).alias("kind")), ["iri"])
    typed = _records(instances).withColumn("type_iri", F.get(F.transform("types", lambda t: t["iri"]), F.lit(0)))
    edges = store.edges.where("relationship_source <> 'ONTOLOGY'").unionByName(ontology_edges(classes, kept, version))
    return Store(kept, props, upsert(store.instances, typed.select(*PROPERTY, "type_iri"), ["iri"]), edges)


def as_of(rows: DataFrame, version: int) -> DataFrame:
    """Rows that were there at a version of the graph."""
    return rows.where(F.col("graph_version") <= version)


class VersionCounter:
    """A number that only grows, as files in a folder that all nodes share; making a file that exists fails, so no number is given twice."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._path = lambda name="": spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}" if name else folder)
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def start(self) -> None:
        """Version 0, where there is none yet."""
        self._make(0)

    def current(self) -> int:
        if not self._fs.exists(self._path()):
            raise RuntimeError("the graph's version counter has not been started")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path())]
        found = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()]
        if not found:
            raise RuntimeError("the graph's version counter has not been started")
        return max(found)

    def bump(self) -> int:
        """The next version, which no other caller gets."""
        while True:
            version = self.current() + 1
            if self._make(version):
                return version

    def _make(self, version: int) -> bool:
        """Whether this call made the version's (empty) file."""
        path = self._path(f"v{version}")
        if self._fs.getScheme() == "file":  # Hadoop's local files look first and create then, which is two steps
            place = Path(path.toUri().getPath())
            place.parent.mkdir(parents=True, exist_ok=True)
            try:
                place.open("x").close()
            except FileExistsError:
                return False
            return True
        try:
            return bool(self._fs.createNewFile(path))
        except Py4JJavaError:
            if self._fs.exists(path):  # another caller was faster
                return False
            raise
