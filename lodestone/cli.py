"""Commands over tables in folders: ``python -m lodestone COMMAND ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def session() -> SparkSession:
    return SparkSession.builder.appName("lodestone").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def merge(spark: SparkSession, args: argparse.Namespace) -> None:
    """Ontology files of a folder into one version of classes, properties and instances."""
    from .plans.versions import write_version
    from .sources import ontology

    triples = ontology.load(spark, args.source)
    bad = [r[0] for r in triples.where("error is not null").select("source").distinct().collect()]
    good = triples.where("error is null")
    tables = {"classes": ontology.classes(good), "properties": ontology.properties(good), "instances": ontology.instances(good), "restrictions": ontology.restrictions(good)}
    write_version(tables, args.out, {"command": "merge", "source": args.source, "unreadable": bad})


def prune(spark: SparkSession, args: argparse.Namespace) -> None:
    """A version cut to the classes around the given ones."""
    from .operators import graph
    from .plans.versions import read_version, write_version

    tables, _ = read_version(spark, args.source, ["classes", "properties"])
    seeds = spark.createDataFrame([(i,) for i in args.keep], "node string")
    classes, properties = graph.prune(tables["classes"], tables["properties"], seeds, tuple(args.protect))
    write_version({"classes": classes, "properties": properties}, args.out, {"command": "prune", "keep": args.keep})


def export(spark: SparkSession, args: argparse.Namespace) -> None:
    """A version as RDF/XML."""
    from .plans.versions import read_version
    from .sources import ontology

    tables, _ = read_version(spark, args.source, ["classes", "properties"])
    ontology.write_owl(ontology.to_triples(tables["classes"], tables["properties"]), args.out)


def register(spark: SparkSession, args: argparse.Namespace) -> None:
    """Text files of a folder as documents, chunks, times, entities, findings and edges; files that give no text with the reason."""
    from .hooks import Hooks
    from .plans.ingest import build_graph
    from .sources.documents import load_documents, skipped

    docs = load_documents(spark, args.source).where("readable").select(F.xxhash64("path").alias("doc_id"), "text")
    entities = spark.read.option("header", "true").schema("entity_id string, name string").csv(args.entities) if args.entities else spark.createDataFrame([], "entity_id string, name string")
    built = build_graph(docs, entities, size=args.size, overlap=args.overlap)
    embed = Hooks().embed
    tables = {n: getattr(built, n) for n in ("documents", "chunks", "times", "findings", "edges")}
    tables["findings"] = built.findings.withColumn("embedding", embed(F.col("text")))
    tables["skipped"] = skipped(spark, args.source)
    tables["entities"] = entities.withColumn("embedding", embed(F.col("name")))
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{args.out}/{name}")


def query(spark: SparkSession, args: argparse.Namespace) -> None:
    """The answer to a question and its evidence, from a graph folder."""
    from .plans.answer import Corpus, answer, record

    read = lambda name: spark.read.parquet(f"{args.source}/{name}")
    text, vector = F.col("text"), F.col("embedding").cast("array<double>").alias("embedding")
    chunks = read("chunks").select("chunk_id", "document_id", F.lit("summary").alias("kind"), F.lit("ACTIVE").alias("status"), text, vector)
    artifacts = read("findings").select("artifact_id", "document_id", F.lit("Finding").alias("artifact_type"), text, vector)
    entities = read("entities").select("entity_id", "name", vector)
    classes = read("classes") if args.classes else spark.createDataFrame([], "class_id string, iri string, label string, embedding array<double>")
    said = answer(Corpus(classes, entities, read("times").select("time_identifier"), chunks, artifacts, read("edges")), args.question, args.mode, args.hops)
    print(said.text)
    said.evidence.orderBy("rank").select("rank", "kind", "score", "id", "snippet").show(args.show, False)
    if args.record:
        for name, rows in zip(("runs", "evidence"), record(said, "", 0), strict=True):
            rows.write.mode("append").parquet(f"{args.source}/{name}")


def status(spark: SparkSession, args: argparse.Namespace) -> None:
    """Rows of each table of a graph folder."""
    from .operators.lifecycle import count_tables

    count_tables({n: spark.read.parquet(f"{args.source}/{n}") for n in ("documents", "chunks", "times", "entities", "findings", "edges")}).show(truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for run, more in (
        (merge, [("source", {}), ("out", {})]),
        (prune, [("source", {}), ("out", {}), ("--keep", {"nargs": "+", "default": []}), ("--protect", {"nargs": "*", "default": []})]),
        (export, [("source", {}), ("out", {})]),
        (register, [("source", {}), ("out", {}), ("--entities", {}), ("--size", {"type": int, "default": 800}), ("--overlap", {"type": int, "default": 120})]),
        (query, [("source", {}), ("question", {}), ("--mode", {"default": "deep_research"}), ("--hops", {"type": int, "default": 3}), ("--show", {"type": int, "default": 10}), ("--classes", {"action": "store_true"}), ("--record", {"action": "store_true"})]),
        (status, [("source", {})]),
    ):
        sub = commands.add_parser(run.__name__, help=run.__doc__)
        sub.set_defaults(run=run)
        for name, options in more:
            sub.add_argument(name, **options)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(session(), args)
