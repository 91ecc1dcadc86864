"""Long documents as summaries that are evaluated and revised until they hold what they should.

Rounds are unrolled into column expressions or settled between, so that a hook that calls a model runs once a round
and only for the windows that still lack something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import section_coverage
from ..hooks import Hooks
from ..operators.chunking import chunk, split_on_sections, token_count, windows
from ..session import settle

VERSION = "1"


def cache_key(text: Column | str, *settings: object) -> Column:
    """SHA-256 of the settings and the text."""
    return F.sha2(F.concat_ws("|", F.lit(VERSION), *[F.lit(str(s)) for s in settings], text), 256)


def evaluated(rows: DataFrame, hooks: Hooks, rounds: int = 3, n_questions: int = 12) -> DataFrame:
    """``rows(..., source)`` with ``summary, passed, rounds, missing_items, missing_sections``.

    Questions are asked once. Each round evaluates the summary and revises it where it lacks something; after the last
    revision one evaluation more tells whether it passed. ``missing_items`` counts over the rounds. A blank revision
    leaves the summary as it is.
    """
    start = rows.withColumn("summary", F.trim(hooks.summarize(F.col("source")))).withColumn("_questions", hooks.questions(F.col("source"), n_questions))
    open_ = settle(start.withColumns({"passed": F.lit(False), "rounds": F.lit(0), "missing_items": F.lit(0)}), "summaries")
    done = None
    for number in range(1, rounds + 2):
        seen = settle(open_.withColumn("_missing", hooks.evaluate(F.col("_questions"), F.col("summary"))), "evaluated")
        n = F.coalesce(F.size("_missing"), F.lit(0))
        n = F.when(n < 0, 0).otherwise(n)
        counted = seen.withColumns({"passed": n == 0, "rounds": F.lit(number), "missing_items": F.col("missing_items") + n})
        ready = counted if number > rounds else counted.where("passed")
        done = ready.drop("_missing") if done is None else done.unionByName(ready.drop("_missing"))
        left = counted.where("not passed")
        if number > rounds or left.isEmpty():
            break
        revised = F.trim(hooks.revise(F.col("summary"), F.col("_missing"), F.col("source")))
        open_ = settle(left.withColumn("summary", F.when(revised != "", revised).otherwise(F.col("summary"))).drop("_missing"), "summaries")
    cover = section_coverage("summary")
    names = done.select(cover.alias("c")).schema["c"].dataType.names
    lacking = F.filter(F.array(*[F.when(~cover[s], F.lit(s)) for s in names]), lambda s: s.isNotNull())
    return done.withColumn("missing_sections", lacking).drop("_questions")


def evaluated_summaries(
    documents: DataFrame, hooks: Hooks | None = None, threshold: int = 2000, rounds: int = 3, n_questions: int = 12, window: int = 12_000,
    overlap: int = 500, piece: int = 1200, chunk_size: int = 800, chunk_overlap: int = 120, cache: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored texts, audits and cache rows of ``documents(document_id, text)``.

    ``(document_id, n, text, summarized)``: documents of ``threshold`` tokens or fewer are chunked as they are; longer
    ones are cut into windows, each is summarized and evaluated, and summaries are split at section headers into pieces
    of ``piece`` tokens at most. ``(document_id, window, passed, rounds, missing_items, missing_sections)`` is the audit.
    ``cache(key, n, text)`` has pieces by the hash of text and settings; its documents aren't summarized again, and the
    third result is the rows to add to it, of documents whose windows all got a summary. A document none of whose
    windows got one is chunked as it is. Null and blank texts give nothing.
    """
    hooks = hooks or Hooks()
    keyed = documents.select("document_id", "text").where(F.coalesce(F.trim("text"), F.lit("")) != "").withColumn("key", cache_key("text", rounds, n_questions, window, overlap, piece))
    is_long = (token_count("text") > threshold) if threshold > 0 else F.lit(False)
    long, short = keyed.where(is_long), keyed.where(~is_long)
    if cache is not None:
        known = long.select("document_id", "key").join(cache, "key").select("document_id", "n", "text", F.lit(True).alias("summarized"))
        long = long.join(cache.select("key").distinct(), "key", "left_anti")
    cut = long.select("document_id", "key", F.posexplode(windows("text", window, overlap)).alias("window", "source"))
    found = settle(evaluated(cut, hooks, rounds, n_questions), "windows")
    good = found.where(F.coalesce(F.trim("summary"), F.lit("")) != "")
    pieces = good.select("document_id", "key", "window", F.posexplode(split_on_sections("summary", piece)).alias("at", "text"))
    # a piece's place follows from the counts of the windows before; only counts are gathered by document
    earlier = Window.partitionBy("document_id").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    counts = good.select("document_id", "window", F.size(split_on_sections("summary", piece)).alias("c"))
    later = counts.select("document_id", "window", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("skip"))
    placed = settle(pieces.join(later, ["document_id", "window"]).select("document_id", "key", (F.col("skip") + F.col("at")).alias("n"), "text"), "pieces")
    plain = short.select("document_id", "text").unionByName(long.join(good.select("document_id").distinct(), "document_id", "left_anti").select("document_id", "text"))
    stored = chunk(plain, "text", chunk_size, chunk_overlap).select("document_id", F.col("chunk_index").cast("long").alias("n"), F.col("chunk_text").alias("text"), F.lit(False).alias("summarized"))
    stored = stored.unionByName(placed.select("document_id", F.col("n").cast("long").alias("n"), "text", F.lit(True).alias("summarized")))
    if cache is not None:
        stored = stored.unionByName(known)
    whole = found.groupBy("document_id").agg(F.count("*").alias("w"), F.count_if(F.coalesce(F.trim("summary"), F.lit("")) != "").alias("g")).where("w = g").select("document_id")
    fresh = placed.join(whole, "document_id", "left_semi").select("key", "n", "text").distinct()
    return stored, found.select("document_id", "window", "passed", "rounds", "missing_items", "missing_sections"), fresh
