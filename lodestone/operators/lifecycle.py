"""Incremental passes, upserts, deletes, versions, counts, conversations, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unprocessed(rows: DataFrame, done: DataFrame, key: str, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose key isn't in ``done``; optionally the first ``limit`` in order."""
    left = rows.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return left if limit is None else left.orderBy(*(order or [key]), key).limit(limit)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Incoming rows replace stored rows of their key; of several incoming ones the last by ``order``."""
    if order is not None:
        rest = [c for c in incoming.columns if c not in keys]
        latest = incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, F.to_json(F.struct(*rest)))).alias("_r"))
        incoming = latest.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in incoming.columns])
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def mark_stale(artifacts: DataFrame, sources: DataFrame, deleted: DataFrame) -> DataFrame:
    """``artifacts`` with status STALE where every source of ``sources(artifact_id, document_id)`` is of ``deleted(document_id)``."""
    gone = deleted.select("document_id").distinct().withColumn("_gone", F.lit(1))
    counted = sources.distinct().join(gone, "document_id", "left").groupBy("artifact_id").agg(F.count("*").alias("_n"), F.count("_gone").alias("_m")).where("_n = _m").select("artifact_id")
    flagged = artifacts.join(counted.withColumn("_stale", F.lit(True)), "artifact_id", "left")
    return flagged.withColumn("status", F.when(F.col("_stale") & (F.col("status") == "ACTIVE"), "STALE").otherwise(F.col("status"))).drop("_stale")


def soft_delete(documents: DataFrame, deleted: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents with status DELETED where their key is deleted."""
    flags = deleted.select(key).distinct().withColumn("_gone", F.lit(True))
    return documents.join(flags, key, "left").withColumn("status", F.when(F.col("_gone"), "DELETED").otherwise(F.col("status"))).drop("_gone")


def hard_delete(rows: DataFrame, deleted: DataFrame, key: str = "document_id") -> DataFrame:
    return rows.join(deleted.select(key).distinct(), key, "left_anti")


def new_versions(stored: DataFrame, incoming: DataFrame, key: str = "name", digest: str = "content_hash") -> DataFrame:
    """All versions after an update: an equal hash changes nothing; another makes the old row STALE and adds ``version + 1``.

    ``stored(name, content_hash, version, status, supersedes)``; ``incoming(name, content_hash)``.
    """
    active = stored.where("status = 'ACTIVE'").select(key, F.col(digest).alias("_old"), F.col("version").alias("_v"))
    met = incoming.select(key, digest).dropDuplicates([key]).join(active, key, "left").where(~F.col(digest).eqNullSafe(F.col("_old")))
    fresh = met.select(key, digest, (F.coalesce("_v", F.lit(0)) + 1).alias("version"), F.lit("ACTIVE").alias("status"), F.col("_old").alias("supersedes"))
    replaced = met.select(key, F.lit(True).alias("_new"))
    old = stored.join(replaced, key, "left").withColumn("status", F.when(F.col("_new") & (F.col("status") == "ACTIVE"), "STALE").otherwise(F.col("status"))).drop("_new")
    return old.unionByName(fresh.select(*old.columns))


def wipe_corpus(tables: dict[str, DataFrame], edges: DataFrame, n_classes: int, confirmed: bool) -> tuple[dict[str, DataFrame], DataFrame]:
    """Empty corpus tables and only the ontology's edges; refuses without confirmation or without an ontology."""
    if not confirmed:
        raise ValueError("a wipe must be confirmed")
    if n_classes == 0:
        raise ValueError("the ontology is empty")
    return {k: v.limit(0) for k, v in tables.items()}, edges.where("relationship_source = 'ONTOLOGY'")


def wipe_ontology(tables: dict[str, DataFrame], dependents: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Empty ontology tables; refuses while a dependent table has rows."""
    used = [k for k, v in dependents.items() if not v.isEmpty()]
    if used:
        raise ValueError(f"rows depend on the ontology: {', '.join(sorted(used))}")
    return {k: v.limit(0) for k, v in tables.items()}


def count_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, n_rows)`` of all tables in one job."""
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()])


def count_left(rows: DataFrame, parts: DataFrame, key: str, alias: str) -> DataFrame:
    """``rows`` with the number of ``parts`` of each; counted before they are joined."""
    counts = parts.groupBy(key).agg(F.count("*").alias(alias))
    return rows.join(counts, key, "left").withColumn(alias, F.coalesce(alias, F.lit(0)).cast("long"))


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def next_turn(turns: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``(key, next_turn)``: one more than the last, 0 for none."""
    return turns.groupBy(key).agg((F.coalesce(F.max(turn), F.lit(-1)) + 1).alias("next_turn"))


def history(turns: DataFrame, n: int = 3, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last ``n`` turns of each conversation."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(turn).desc()))
    return turns.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def replay(turns: DataFrame, key: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> DataFrame:
    """``(key, n_turns, transcript)``: turns in order, one line each."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x"))))
    joined = F.array_join(F.transform(lines, lambda s: F.concat(s["r"], F.lit(": "), s["x"])), "\n")
    return turns.groupBy(key).agg(F.count("*").alias("n_turns"), joined.alias("transcript"))


def trace(runs: DataFrame, evidence: DataFrame, most: int = 50, snippet: int = 500) -> DataFrame:
    """Runs with their first evidence rows, snippets cut."""
    first = evidence.where(F.col("rank") <= most).select("run_id", "rank", "kind", "score", F.left("snippet", F.lit(snippet)).alias("snippet"))
    return runs.join(first, "run_id", "left")


def evaluation(scores: DataFrame, group: str | None = None, low: float = 0.7) -> DataFrame:
    """``(metric, [group], mean, min, max, n, n_low)`` of ``scores(metric, value)``."""
    keys = ["metric", *([group] if group else [])]
    return scores.groupBy(*keys).agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"), F.count_if(F.col("value") < low).alias("n_low"))


def p95(df: DataFrame, value: str, group: str, least: int = 20) -> DataFrame:
    """``(group, p95)`` as the last of 20-quantiles by the exclusive method; under ``least`` values the maximum."""
    counted = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("_v")).agg(F.count("*").alias("_m"))  # equal values are one row from here
    ranked = counted.withColumn("_r", F.sum("_m").over(Window.partitionBy(group).orderBy("_v"))).withColumn("_n", F.sum("_m").over(Window.partitionBy(group)))
    at = 19 * (F.col("_n") + 1) / 20
    low = F.least(F.greatest(F.floor(at), F.lit(1)), F.col("_n") - 1)
    holds = lambda place: (F.col("_r") >= place) & (F.col("_r") - F.col("_m") < place)
    picked = ranked.groupBy(group).agg(
        F.first("_n").alias("n"), F.max("_v").alias("top"),
        F.max(F.when(holds(low), F.col("_v"))).alias("a"), F.max(F.when(holds(low + 1), F.col("_v"))).alias("b"), F.first(at - low).alias("w"),
    )
    return picked.select(group, F.when(F.col("n") < least, F.col("top")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("p95"))


def cost_by_task(log: DataFrame) -> DataFrame:
    """Calls, cost and share of cached tokens of each task of an audit log ``(task, cost, tokens, cached_tokens)``."""
    return log.groupBy("task").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"), (F.sum("cached_tokens") / F.sum("tokens")).alias("cache_rate"))


def merge_records(records: DataFrame, key: str, lists: list[str], scalars: list[str]) -> DataFrame:
    """One record a key: list fields united and sorted, scalar fields as the sorted distinct values."""
    plain = records.groupBy(key).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in scalars]) if scalars else records.select(key).distinct()
    for c in lists:  # distinct values first, so that what is gathered of a key is its result
        values = records.select(key, F.explode(c).alias("_v")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("_v")).alias(c))
        plain = plain.join(values, plain[key].eqNullSafe(values[key]), "left").drop(values[key])
        kind = dict(records.dtypes)[c]
        plain = plain.withColumn(c, F.coalesce(c, F.array().cast(kind)))
    return plain.select(key, *lists, *scalars)
