"""Conversations and evaluation runs on top of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import record_iri
from ..hooks import Hooks
from ..operators.lifecycle import evaluation, history, next_turn, p95

TURN = "conv_id string, turn long, role string, text string"


def start(spark: SparkSession, title: str, number: int) -> DataFrame:
    """``(conv_id, title, metadata)`` of a new conversation; the title goes into its metadata as JSON."""
    row = spark.createDataFrame([(title, number)], "title string, number int")
    return row.select(record_iri(F.lit("Conversation"), "title", "number").alias("conv_id"), "title", F.to_json(F.struct("title")).alias("metadata"))


def add_turn(turns: DataFrame, conv_id: str, question: str, evidence: DataFrame, hooks: Hooks | None = None) -> DataFrame:
    """``turns`` with the question and the answer from the evidence's texts appended."""
    hooks = hooks or Hooks()
    spark = turns.sparkSession
    ask = spark.createDataFrame([(conv_id, question)], "conv_id string, q string")
    at = ask.join(next_turn(turns), "conv_id", "left").select("conv_id", "q", F.coalesce("next_turn", F.lit(0)).cast("long").alias("turn"))
    said = evidence.agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("score"), F.col("id").cast("string"), "text"))), lambda s: s["text"]).alias("texts"))
    answer = at.join(F.broadcast(said)).select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), hooks.answer(F.col("texts")).alias("text"))
    return turns.unionByName(at.select("conv_id", "turn", F.lit("user").alias("role"), F.col("q").alias("text"))).unionByName(answer)


def context(turns: DataFrame, conv_id: str, n: int = 3) -> DataFrame:
    """The last turns that a follow-up question is read with."""
    return history(turns.where(F.col("conv_id") == conv_id), n).orderBy("turn")


def judge(answers: DataFrame, hooks: Hooks | None = None) -> DataFrame:
    """``(question, metric, value)`` of ``answers(question, answer, evidence, expected_gap)`` by the hook's judge."""
    hooks = hooks or Hooks()
    no_answer = F.coalesce(F.trim("answer"), F.lit("")) == ""
    scored = answers.select("question", hooks.judge(F.col("answer"), F.col("question")).alias("comprehensiveness"), hooks.judge(F.col("evidence"), F.col("answer")).alias("no_hallucination"), (no_answer == F.col("expected_gap")).cast("double").alias("gap_detection"))
    return scored.unpivot("question", ["comprehensiveness", "no_hallucination", "gap_detection"], "metric", "value")


def report(scores: DataFrame, seconds: DataFrame | None = None, low: float = 0.7) -> DataFrame:
    """``(part, line)``: a Markdown report of means, questions below the bar, and the 95th percentile of seconds."""
    table = evaluation(scores, low=low).select(F.lit(1).alias("part"), F.format_string("| %s | %.3f | %d below %.1f |", "metric", "mean", "n_low", F.lit(low)).alias("line"))
    head = scores.sparkSession.createDataFrame([(0, "| metric | mean | notes |"), (0, "|-|-|-|")], "part int, line string")
    means = scores.groupBy("question", "metric").agg(F.avg("value").alias("mean")).where(F.col("mean") < low)
    flagged = means.groupBy("question").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s=%.2f", "metric", "mean"))), ", ").alias("flags")).select(F.lit(3).alias("part"), F.format_string("- `%s`: %s", "question", "flags").alias("line"))
    out = head.union(table).union(flagged)
    if seconds is not None:
        out = out.union(p95(seconds.withColumn("_g", F.lit("all")), "seconds", "_g").select(F.lit(2), F.format_string("| wall seconds | p95 %.1f | |", "p95")))
    return out
