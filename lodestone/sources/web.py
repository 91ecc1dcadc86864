"""Pages of search engines and filing archives, as columns; fetching them is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col, unwrap_redirect

INDEX = T.StructType([T.StructField("directory", T.StructType([T.StructField("item", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("description", T.StringType())])))]))])


def plain(html: Column) -> Column:
    """Text of a fragment: no tags, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))


def search_results(pages: DataFrame, html: str = "html", key: str = "page_id", most: int = 10) -> DataFrame:
    """``(key, position, title, url, snippet)``: results of pages that list them as ``result__a`` links; each URL once."""
    blocks = F.split(col(html), r"(?i)<div[^>]*class=[\"'](?:[^\"']*\s)?result(?:\s[^\"']*)?[\"'][^>]*>")
    rows = pages.select(key, F.posexplode(F.slice(blocks, 2, 1 << 20)).alias("position", "block"))
    link = r"(?is)<a\b(?=[^>]*class=[\"'][^\"']*result__a)[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
    href = F.replace(F.trim(F.regexp_extract("block", link, 1)), F.lit("&amp;"), F.lit("&"))
    url = unwrap_redirect(href)
    url = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    snippet = plain(F.regexp_extract("block", r"(?is)class=[\"'][^\"']*result__snippet[^>]*>(.*?)</(?:a|div|span)>", 1))
    rows = rows.select(key, "position", plain(F.regexp_extract("block", link, 2)).alias("title"), url.alias("url"), snippet.alias("snippet")).where(F.col("url").rlike(r"^https?://"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "url").orderBy("position"))).where("_n = 1")
    kept = first.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("position"))).where(F.col("_r") <= most)
    return kept.select(key, (F.col("_r") - 1).alias("position"), F.when(F.col("title") == "", F.col("url")).otherwise(F.col("title")).alias("title"), "url", "snippet")


def is_pdf(content_type: Column | str, body: Column | str, url: Column | str) -> Column:
    """By content type, by the first bytes, or by the URL's path."""
    path = F.lower(F.try_parse_url(col(url), F.lit("PATH")))
    return F.coalesce((col(content_type) == "application/pdf") | (F.substring(col(body), 1, 5) == F.lit(b"%PDF-")) | path.endswith(".pdf"), F.lit(False))


def accession_path(cik: Column | str, accession: Column | str) -> Column:
    """``<number without zeros>/<accession without dashes>`` of a filing."""
    return F.concat(col(cik).cast("bigint").cast("string"), F.lit("/"), F.replace(col(accession), F.lit("-"), F.lit("")))


def filing_index_url(base: str, cik: Column | str, accession: Column | str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), accession_path(cik, accession), F.lit("/index.json"))


def filing_document_url(base: str, cik: Column | str, accession: Column | str, name: Column | str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), accession_path(cik, accession), F.lit("/"), col(name))


def filing_items(index: Column | str) -> Column:
    """The entries of a filing's index."""
    return F.coalesce(F.from_json(col(index), INDEX)["directory"]["item"], F.array().cast("array<struct<name: string, description: string>>"))


def pdf_items(index: Column | str) -> Column:
    """Names of entries that are PDF files by name or description."""
    found = F.filter(filing_items(index), lambda i: F.lower(F.trim(i["name"])).endswith(".pdf") | F.contains(F.lower(F.coalesce(i["description"], F.lit(""))), F.lit("pdf")))
    return F.transform(found, lambda i: i["name"])


def primary_document(index: Column | str) -> Column:
    """Name of the first HTML entry that is no index, summary, exhibit or report fragment; null without one."""
    names = F.transform(filing_items(index), lambda i: i["name"])
    fine = F.filter(names, lambda n: F.lower(n).rlike(r"\.html?$") & ~F.lower(n).rlike(r"index|exhibit|^filingsummary\.|^r\d+\.html?$"))
    return F.get(fine, F.lit(0))


def without_inline_facts(html: Column | str) -> Column:
    """Inline facts unwrapped, hidden elements without children of their own kind and schema links out."""
    out = F.regexp_replace(col(html), r"(?i)</?ix:[^>]*>", "")
    out = F.regexp_replace(out, r"(?is)<(div|span|p)\b[^>]*style=[\"'][^\"']*display\s*:\s*none[^\"']*[\"'][^>]*>(?:(?!<\1\b).)*?</\1>", "")
    return F.regexp_replace(out, r"(?i)<link\b[^>]*(?:href=[\"'][^\"']*\.xsd[\"']|rel=[\"'][^\"']*schemaref)[^>]*>", "")


def unzipped(files: DataFrame) -> DataFrame:
    """``(name, content)``: files of ``files(name, content)``, archives as their members, in Arrow batches."""
    import io
    import zipfile
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                if name.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        for member in z.infolist():
                            if not member.is_dir():
                                yield pd.DataFrame({"name": [member.filename.rpartition("/")[2]], "content": [z.read(member)]})
                else:
                    yield pd.DataFrame({"name": [name], "content": [content]})

    return files.select("name", "content").mapInPandas(run, "name string, content binary")
