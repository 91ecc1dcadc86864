"""Chunking as folds over arrays: packing with overlap, windows, section-aware splits.

A token is what the tokenizer pattern matches; the default is a run of signs that
aren't blank. Where a text needs no overlap or splitting its own characters are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SECTIONS, col, let


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), r"(?U)\s+"), lambda w: w != "")


def token_count(text: Column | str) -> Column:
    return F.size(tokens(text))


def paragraphs(text: Column | str, separator: str = "\n\n") -> Column:
    """Trimmed parts between separators, blank ones left out."""
    parts = F.split(F.coalesce(col(text), F.lit("")), "\\Q" + separator + "\\E")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def windows(text: Column | str, size: int, overlap: int = 0) -> Column:
    """Token windows every ``max(1, size - overlap)`` tokens, joined by blanks; a short text is one window."""
    step = max(1, size - overlap)

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(step))
        pieces = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) <= size, F.array(F.array_join(words, " "))).otherwise(pieces)

    return let(tokens(text), cut)


def split_long(text: Column | str, size: int) -> Column:
    """A text of more than ``size`` tokens in pieces of ``size``; otherwise itself."""

    def cut(words: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size)), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
        return F.when(F.size(words) <= size, F.array(col(text))).otherwise(pieces)

    return let(tokens(text), cut)


def pack(parts: Column, size: int, overlap: int, separator: str) -> Column:
    """Greedy packing: an array of ``struct<text, token_count>``.

    A chunk closes when the next part would take it over ``size`` tokens. The last ``overlap`` tokens of a closed
    chunk, its own overlap included, open the next one if the chunk is longer than that.

    One fold over the parts' token counts finds where chunks end; a second, over the chunks, carries the overlap.
    """
    bound = "struct<start: int, n: int>"
    zero = F.struct(F.array().cast(f"array<{bound}>").alias("done"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).alias("held"))

    def end(s: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["n"].alias("n"))))

    def add(s: Column, count: Column) -> Column:
        full = (s["held"] + count > size) & (s["n"] > 0)
        fresh = F.struct(end(s).alias("done"), (s["start"] + s["n"]).alias("start"), F.lit(1).alias("n"), count.alias("held"))
        grown = F.struct(s["done"].alias("done"), s["start"].alias("start"), (s["n"] + 1).alias("n"), (s["held"] + count).alias("held"))
        return F.when(full, fresh).otherwise(grown)

    def assemble(whole: Column) -> Column:
        counts = F.transform(whole, token_count)
        bounds = F.aggregate(counts, zero, add, lambda s: F.when(s["n"] > 0, end(s)).otherwise(s["done"]))
        bodies = F.transform(bounds, lambda b: F.array_join(F.slice(whole, b["start"] + 1, b["n"]), separator))
        if not overlap:
            return F.transform(bodies, lambda b: F.struct(b.alias("text"), token_count(b).alias("token_count")))
        none = F.array().cast("array<string>")
        start = F.struct(F.array().cast("array<struct<text: string, token_count: int>>").alias("done"), none.alias("tail"))

        def carry(s: Column, body: Column) -> Column:
            def one(words: Column) -> Column:
                text = F.when(F.size(s["tail"]) > 0, F.array_join(words, " ")).otherwise(body)
                tail = F.when(F.size(words) > overlap, F.slice(words, -overlap, overlap)).otherwise(none)
                return F.struct(F.concat(s["done"], F.array(F.struct(text.alias("text"), F.size(words).alias("token_count")))).alias("done"), tail.alias("tail"))

            return let(F.concat(s["tail"], tokens(body)), one)

        return F.aggregate(bodies, start, carry, lambda s: s["done"])

    return let(parts, assemble)


def chunk(df: DataFrame, text: str = "text", size: int = 800, overlap: int = 120, separator: str = "\n\n") -> DataFrame:
    """``df`` exploded to one row a chunk: ``chunk_index`` from 0, ``chunk_text``, ``token_count``; blank texts give none."""
    parts = F.flatten(F.transform(paragraphs(text, separator), lambda p: split_long(p, size)))
    exploded = df.withColumn("_parts", parts).select(*df.columns, F.posexplode(pack(F.col("_parts"), size, overlap, separator)).alias("chunk_index", "_chunk"))
    return exploded.select(*df.columns, "chunk_index", F.col("_chunk.text").alias("chunk_text"), F.col("_chunk.token_count").alias("token_count"))


_HEADER = r"(?mi)(?=^[ \t]*[#>*\-\s]*(?:" + "|".join(a for names in SECTIONS.values() for a in names) + r")\b)"


def split_on_sections(text: Column | str, size: int) -> Column:
    """Pieces of at most ``size`` tokens, cut at section headers where there are any, else by tokens. Nothing is lost."""
    whole = col(text)
    blocks = F.filter(F.transform(F.split(whole, _HEADER), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    pieces = F.flatten(F.transform(blocks, lambda b: split_long(b, size)))
    packed = F.transform(pack(pieces, size, 0, "\n\n"), lambda c: c["text"])
    trimmed = F.regexp_replace(whole, r"^\s+|\s+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(tokens(whole)) <= size, F.array(trimmed)).otherwise(packed)


def truncate(text: Column | str, most: int = 8000) -> Column:
    """The first ``most`` tokens: what an embedding model is given. Shorter texts stay as they are; blank becomes one blank."""
    words = tokens(text)
    return F.when(F.size(words) == 0, F.lit(" ")).when(F.size(words) <= most, col(text)).otherwise(F.array_join(F.slice(words, 1, most), " "))


def summarize_if_long(text: Column | str, summarizer, threshold: int = 2000) -> Column:
    """The summarizer's column where the text has more tokens than the threshold, else the text."""
    return F.when(F.size(tokens(text)) <= threshold, col(text)).otherwise(summarizer(col(text)))
