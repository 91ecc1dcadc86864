"""A question answered end to end: parse, match, traverse, candidates, probes, fusion, answer, record.

What depends on the question alone (terms, probes, the answer) is one row and is handled on the driver; graph and
texts stay DataFrames, and every candidate list is cut by a limit that is a parameter of the feature.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import record_iri
from ..functions.text import normalize_name, scrub_citations, trigram_similarity, year_term
from ..hooks import Hooks
from ..operators.graph import bfs
from ..operators.retrieval import fulltext_bridge, hits, pack_evidence, prefer_fulltext, tables_of_documents, typed_edges, wants_probes
from ..operators.search import knn, literal_vector, ranked_list, rerank, rrf
from ..session import settle
from .retrieve import TOP_K

#: Limits of the lists that a question is answered from.
CLASSES, ENTITIES_A_TERM, ENTITIES_BY_VECTOR = 30, 10, 15
ENTITY_TERMS, TIME_TERMS, ENTITY_PROBES, PROBES = 10, 5, 8, 3
BY_ENTITY, BY_TIME, ARTIFACTS, TABLES, FULLTEXT = 500, 200, 200, 200, 500
LEAST_SIMILARITY, DECAY, HOPS = 0.4, 0.7, 3
EVIDENCE_ROWS, SNIPPET = 50, 500


@dataclass(frozen=True)
class Corpus:
    """Tables that a question is asked of; vectors are arrays of doubles, all ids strings.

    ``classes(class_id, iri, label, embedding)``, ``entities(entity_id, name, embedding)``, ``times(time_identifier)``,
    ``chunks(chunk_id, document_id, kind, status, text, embedding)``,
    ``artifacts(artifact_id, document_id, artifact_type, text, embedding)``, ``edges(source_type, source_id, target_type, target_id)``
    between nodes of the types ``class``, ``entity``, ``time``, ``chunk`` and ``artifact``.
    """

    classes: DataFrame
    entities: DataFrame
    times: DataFrame
    chunks: DataFrame
    artifacts: DataFrame
    edges: DataFrame


@dataclass
class Answer:
    """``evidence(rank, kind, id, score, snippet)`` and what was said, parsed and matched."""

    question: str
    mode: str
    text: str
    evidence: DataFrame
    parsed: dict
    matched: dict[str, list[str]]
    hops: int
    rounds: list[str] = field(default_factory=list)


def _one(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "q string")


def parse(spark: SparkSession, question: str, hooks: Hooks) -> dict:
    """Entities, time terms and intent of a question, the entities' first of equal names without case."""
    row = _one(spark, question).select(hooks.parse_question(F.col("q")).alias("p")).head().p
    first: dict[str, str] = {}
    for name in row.entities or []:
        if name and name.strip():
            first.setdefault(name.strip().lower(), name.strip())
    return {"entities": list(first.values()), "time_terms": [t for t in row.time_terms or [] if t], "intent": row.intent or "factoid"}


def embedded(spark: SparkSession, texts: list[str], hooks: Hooks) -> DataFrame:
    """``(probe, probe_vector)``, probes from 1."""
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "probe int, q string")
    return rows.select("probe", hooks.embed(F.col("q")).cast("array<double>").alias("probe_vector"))


def match(corpus: Corpus, parsed: dict, vector: list[float]) -> DataFrame:
    """``(node_type, node_id, label, related)``: the nearest classes, entities like the terms, and the years named.

    Entities are those with the most similar names of each term; if no term meets any, the nearest by vector.
    """
    probe, spark = literal_vector(vector), corpus.edges.sparkSession
    columns = lambda kind, df, key, label: df.select(F.lit(kind).alias("node_type"), F.col(key).alias("node_id"), F.col(label).alias("label"))
    classes = columns("class", knn(corpus.classes, probe, CLASSES, "class_id"), "class_id", "label")
    terms = parsed["entities"][:ENTITY_TERMS]
    entities = None
    if terms:
        likeness = F.array(*[F.struct(F.lit(i).alias("term"), trigram_similarity("_name", F.lit(t.lower())).alias("similarity")) for i, t in enumerate(terms)])
        near = corpus.entities.withColumn("_name", normalize_name("name")).select("entity_id", "name", F.explode(likeness).alias("m")).where(F.col("m.similarity") >= LEAST_SIMILARITY)
        best = [near.where(F.col("m.term") == i).orderBy(F.col("m.similarity").desc(), "entity_id").limit(ENTITIES_A_TERM) for i in range(len(terms))]
        entities = settle(columns("entity", reduce(DataFrame.union, best), "entity_id", "name").distinct(), "entities")
    if entities is None or entities.isEmpty():
        entities = columns("entity", knn(corpus.entities, probe, ENTITIES_BY_VECTOR, "entity_id"), "entity_id", "name")
    named = spark.createDataFrame([(t,) for t in parsed["time_terms"][:TIME_TERMS]], "t string").select(year_term("t").alias("time_identifier"))
    times = corpus.times.join(F.broadcast(named.distinct()), "time_identifier", "left_semi")
    return settle(classes.union(entities).union(columns("time", times, "time_identifier", "time_identifier")), "matched")


def _graph_chunks(corpus: Corpus, by_entity: DataFrame, by_time: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate chunks ``(id)`` and those that the graph ranks ``(id, hits)``, with full text where a document has it."""
    found = by_entity.select("source_id").union(by_time.select("source_id")).distinct().select(F.col("source_id").alias("chunk_id"), F.lit(1).alias("hits"))
    swapped = fulltext_bridge(found, corpus.chunks)
    full = swapped.where("kind = 'fulltext'").orderBy(F.col("hits").desc(), "chunk_id").limit(FULLTEXT)
    rest = swapped.where("kind <> 'fulltext'").drop("hits").join(by_entity.select(F.col("source_id").alias("chunk_id"), "hits"), "chunk_id", "left").select("chunk_id", "hits", "kind")
    pool = settle(full.unionByName(rest), "pool")
    score = F.coalesce("hits", F.lit(0)) if not pool.where("kind = 'fulltext'").isEmpty() else F.col("hits")
    ids = pool.select(F.col("chunk_id").alias("id"))
    return ids, pool.select(F.col("chunk_id").alias("id"), score.alias("hits")).where("hits is not null")


def _fused(items: DataFrame, candidates: DataFrame, ranked: DataFrame, probes: DataFrame, n: int, top: int) -> DataFrame:
    """``(id, score, text)``: candidates by fusion of one rerank a probe and the graph's ranking."""
    near = rerank(items.join(candidates, "id", "left_semi"), probes, n).select(F.col("probe").alias("list_no"), "id", "rank")
    best = rrf(near.unionByName(ranked_list(ranked, 1_000, [F.col("hits").desc()]))).limit(top)
    return best.join(items.select("id", "text"), "id")


def evidence_for(corpus: Corpus, seeds: DataFrame, probes: DataFrame, vector: list[float], mode: str, hops: int) -> DataFrame:
    """``(rank, kind, id, score, snippet)`` for seeds ``(node_type, node_id)`` and probes."""
    top, edges = TOP_K[mode], corpus.edges
    reached = bfs(edges, seeds, hops, DECAY)
    linked = lambda source, target, limit: settle(hits(typed_edges(edges, source_type=source, target_type=target), reached.where(F.col("node_type") == target).select(F.col("node_id").alias("target_id")), limit), "hits")
    by_entity, by_time, by_artifact = linked("chunk", "entity", BY_ENTITY), linked("chunk", "time", BY_TIME), linked("artifact", "entity", ARTIFACTS)
    active = corpus.chunks.where("status = 'ACTIVE'")
    chunk_items = active.select(F.col("chunk_id").alias("id"), "text", "embedding")
    artifact_items = corpus.artifacts.select(F.col("artifact_id").alias("id"), "text", "embedding")
    found = by_entity.select(F.col("source_id").alias("chunk_id")).union(by_time.select("source_id"))
    tables = corpus.artifacts.where("artifact_type = 'StructuredTable'").select(F.col("artifact_id").alias("table_id"), "document_id")
    artifacts = by_artifact.select(F.col("source_id").alias("id")).union(tables_of_documents(corpus.chunks, found, tables, TABLES).select("table_id"))
    if mode == "artifact_only":
        everywhere = knn(artifact_items, literal_vector(vector), max(3 * top, 120)).select("id")
        artifacts, chunks, ranked = artifacts.union(everywhere), None, None
    else:
        chunks, ranked = _graph_chunks(replace(corpus, chunks=active), by_entity, by_time)
    artifacts = settle(artifacts.distinct(), "artifacts")
    if (chunks is None or chunks.isEmpty()) and artifacts.isEmpty():
        chunks = settle(knn(prefer_fulltext(active).select(F.col("chunk_id").alias("id"), "embedding"), literal_vector(vector), 2 * top).select("id"), "fallback")
        ranked = chunks.select("id", F.lit(0).alias("hits")).limit(0)
    none = chunk_items.select("id", F.lit(0.0).alias("score"), "text").limit(0)
    from_chunks = none if chunks is None or mode == "artifact_only" else _fused(chunk_items, chunks, ranked, probes, 3 * top, top).select("id", "score", "text")
    linked_artifacts = by_artifact.select(F.col("source_id").alias("id"), "hits")
    from_artifacts = _fused(artifact_items, artifacts, linked_artifacts, probes, top, top if mode == "artifact_only" else top // 2)
    return settle(pack_evidence(from_chunks, from_artifacts.select("id", "score", "text")), "evidence")


def probes_for(spark: SparkSession, question: str, parsed: dict, hooks: Hooks) -> list[str]:
    """The question, then one probe an entity where it compares or lists several, else its parts, ``PROBES`` in all."""
    if wants_probes(parsed["intent"], len(parsed["entities"]), ENTITY_PROBES):
        more = _one(spark, question).select(hooks.entity_probes(F.col("q"), F.array(*map(F.lit, parsed["entities"][:ENTITY_PROBES])))).head()[0]
        most = None
    else:
        more, most = _one(spark, question).select(hooks.decompose(F.col("q"))).head()[0], PROBES
    kept = [p for p in more or [] if p and p.strip() and p.strip() != question.strip()]
    return [question, *kept][:most]


def once(corpus: Corpus, question: str, mode: str, hops: int, hooks: Hooks) -> Answer:
    """One round."""
    spark = corpus.edges.sparkSession
    parsed = parse(spark, question, hooks)
    probes = embedded(spark, probes_for(spark, question, parsed, hooks), hooks)
    vector = probes.where("probe = 1").head().probe_vector
    matched = match(corpus, parsed, vector)
    evidence = evidence_for(corpus, matched.select("node_type", "node_id"), probes, vector, mode, hops)
    texts = [r.snippet for r in evidence.orderBy("rank").collect()]  # one and a half times the mode's rows at most
    said = spark.createDataFrame([(question, texts)], "q string, texts array<string>").select(hooks.answer(F.col("texts"))).head()[0]
    names: dict[str, list[str]] = {"class": [], "entity": [], "time": []}
    for r in matched.orderBy("node_type", "node_id").collect():  # bounded by the limits above
        names[r.node_type].append(r.label or "")
    return Answer(question, mode, said or "", evidence, parsed, names, hops)


def answer(corpus: Corpus, question: str, mode: str = "deep_research", hops: int = HOPS, hooks: Hooks | None = None) -> Answer:
    """The answer in a mode: ``simple_qa``, ``deep_research``, or ``artifact_only``, which uses no chunks.

    Where the planner says that entities must be found first (not for ``simple_qa``), a bridge question is answered
    first and its answer is put below the final one; its evidence follows, of artifacts alone in ``artifact_only``.
    """
    if mode not in TOP_K:
        raise ValueError(f"unknown mode: {mode}")
    hooks, spark = hooks or Hooks(), corpus.edges.sparkSession
    if mode == "simple_qa":
        return once(corpus, question, mode, hops, hooks)
    plan = _one(spark, question).select(hooks.plan_rounds(F.col("q")).alias("p")).head().p
    bridge, final = ((getattr(plan, f, None) or "").strip() for f in ("bridge", "final"))
    if not bridge or not final or bridge.lower() == question.strip().lower():
        return once(corpus, question, mode, hops, hooks)
    first = once(corpus, bridge, "simple_qa", hops, hooks)
    prior = _one(spark, first.text).select(scrub_citations("q")).head()[0] if mode == "artifact_only" else first.text
    last = once(corpus, f"{final}\n\n[Prior research: {bridge}]\n{prior}", mode, hops, hooks)
    last.question, last.rounds = question, [bridge, final]
    more = first.evidence.join(last.evidence.select("id"), "id", "left_anti").select(*last.evidence.columns)
    if mode == "artifact_only":
        more = more.where("kind = 'artifact'")
    last.evidence = last.evidence.unionByName(more)
    return last


def record(said: Answer, turn: str, graph_version: int = 0) -> tuple[DataFrame, DataFrame]:
    """A run row ``(run_id, turn, question, mode, matched, hops, plan, graph_version)`` and its evidence rows, of the first ranks."""
    spark = said.evidence.sparkSession
    matched = {kind: names[: 10 if kind == "time" else 20] for kind, names in said.matched.items()}
    row = (turn, said.question, said.mode, json.dumps(matched, sort_keys=True), said.hops, json.dumps({"intent": said.parsed["intent"], "rounds": said.rounds}), graph_version)
    runs = spark.createDataFrame([row], "turn string, question string, mode string, matched string, hops int, plan string, graph_version long")
    runs = runs.select(record_iri(F.lit("Run"), "turn", "question").alias("run_id"), "*")
    rows = said.evidence.orderBy("rank", "id").limit(EVIDENCE_ROWS).select("rank", "kind", "id", "score", F.left("snippet", F.lit(SNIPPET)).alias("snippet"))
    return runs, rows.join(F.broadcast(runs.select("run_id")))
