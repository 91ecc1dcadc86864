"""Calls to models as pluggable functions from columns to columns, with offline stand-ins.

A hook takes a text column and returns a column, so that a stand-in stays a built-in
expression and a real model can be a pandas UDF. The stand-ins are deterministic; they
give structure to work with, not a model's quality.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.text import clip, json_text
from .functions.vectors import hashed_embedding
from .operators.chunking import truncate
from .operators.rollup import merged_text


def first_sentences(text: Column, n: int = 3) -> Column:
    """The extractive summary: the first sentences."""
    return F.array_join(F.slice(F.split(F.trim(text), r"(?<=[.!?])\s+"), 1, n), " ")


def template_answer(evidence: Column) -> Column:
    """An answer that lists the evidence it is given, numbered."""
    return F.array_join(F.transform(evidence, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), clip(x, 200))), "\n")


def intent_of(question: Column) -> Column:
    """A keyword intent; ``factoid`` without a cue."""
    q = F.lower(question)
    return F.when(q.rlike(r"\b(?:compare|versus|vs|difference between)\b"), "comparison").when(q.rlike(r"\b(?:list|which|what are|enumerate)\b"), "enumeration").when(q.rlike(r"\bwhy\b"), "causal").otherwise("factoid")


#: Words that open a question and are no part of a name.
OPENING = r"(?i)^(?:who|what|when|where|which|why|how|is|are|was|were|do|does|did|can|compare|list|the|and|in)(?:\s+|$)"


def parsed_question(question: Column) -> Column:
    """Capitalized runs that don't open the question as entities, years as time terms, and the keyword intent."""
    runs = F.regexp_extract_all(question, F.lit(r"(?U)((?:\p{Lu}[\w&.-]*\w|\p{Lu})(?:\s+(?:\p{Lu}[\w&.-]*\w|\p{Lu}))*)"), F.lit(1))
    years = F.regexp_extract_all(question, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    names = F.filter(F.transform(runs, lambda n: F.regexp_replace(n, OPENING, "")), lambda n: n != "")
    return F.struct(names.alias("entities"), years.alias("time_terms"), intent_of(question).alias("intent"))


def question_parts(question: Column) -> Column:
    """Sub-questions: what stands between question marks and semicolons, if there are several."""
    parts = F.filter(F.transform(F.split(question, r"[?;]\s*"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def one_round(question: Column) -> Column:
    """The planner's stand-in: no bridge question."""
    return F.struct(F.lit(None).cast("string").alias("bridge"), F.lit(None).cast("string").alias("final"))


def probe_an_entity(question: Column, entities: Column) -> Column:
    """The question with each entity after it."""
    return F.transform(entities, lambda e: F.concat(question, F.lit(" "), e))


def checked_sentences(source: Column, n: int) -> Column:
    """Questions' stand-in: the first sentences with a number or a date, which a summary should hold."""
    return F.slice(sentences_with_cues(source), 1, n)


def missing_sentences(questions: Column, summary: Column) -> Column:
    """What the summary lacks of the questions' sentences."""
    return F.filter(questions, lambda q: ~F.contains(F.coalesce(summary, F.lit("")), q))


def with_missing(summary: Column, missing: Column, source: Column) -> Column:
    """The revised summary: the missing sentences after it."""
    return F.concat_ws(" ", summary, F.array_join(missing, " "))


def sentences_with_cues(text: Column) -> Column:
    """Candidate findings: sentences with a number or a date."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s.rlike(r"\d"))


def overlap_score(answer: Column, reference: Column) -> Column:
    """A judge's stand-in: share of the reference's words that the answer has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != ""))
    a, b = words(answer), words(reference)
    return F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(b)).otherwise(F.lit(1.0))


@dataclass(frozen=True)
class Hooks:
    """The model calls of the pipelines; replace any of them."""

    embed: Callable[[Column], Column] = lambda text: hashed_embedding(truncate(text))
    summarize: Callable[[Column], Column] = first_sentences
    merge: Callable[[Column], Column] = merged_text
    answer: Callable[[Column], Column] = template_answer
    intent: Callable[[Column], Column] = intent_of
    findings: Callable[[Column], Column] = sentences_with_cues
    judge: Callable[[Column, Column], Column] = overlap_score
    parse_question: Callable[[Column], Column] = parsed_question
    decompose: Callable[[Column], Column] = question_parts
    entity_probes: Callable[[Column, Column], Column] = probe_an_entity
    plan_rounds: Callable[[Column], Column] = one_round
    questions: Callable[[Column, int], Column] = checked_sentences
    evaluate: Callable[[Column, Column], Column] = missing_sentences
    revise: Callable[[Column, Column, Column], Column] = with_missing
    parse_json: Callable[[Column], Column] = json_text


def estimated_cost(input_tokens: Column, output_tokens: Column, cached_tokens: Column, price: tuple[float, float], cached_share: float = 0.1) -> Column:
    """Cost of a call at prices per million tokens, cached input at a share of the price."""
    fresh = input_tokens - cached_tokens
    return (fresh * price[0] + cached_tokens * price[0] * cached_share + output_tokens * price[1]) / 1e6
