"""Document sources: folders of text files, pages, questions, suggestions, table bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import document_iri
from ..functions.text import html_to_text, is_legible, legibility, local_name, strip_nul

#: Suffixes that are read as text, and those that need a PDF reader.
TEXT_SUFFIXES, PDF_SUFFIXES = ("txt",), ("pdf",)


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``(path, name, suffix, length, modified, content)`` of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", local_name("path").alias("name"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), "length", F.col("modificationTime").alias("modified"), "content")


def provenance(files: DataFrame) -> DataFrame:
    """``(path, name, length, sha256)`` of files."""
    return files.select("path", "name", "length", F.sha2("content", 256).alias("sha256"))


def pdf_text() -> Column | None:
    """A pandas UDF from PDF bytes to text, pages parted by a blank line; None without a PDF library."""
    try:
        import pypdf  # noqa: F401
    except ImportError:
        return None
    import pandas as pd

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        import io

        import pypdf

        def one(data: bytes) -> str | None:
            try:
                return "\n\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages)
            except Exception:  # noqa: BLE001  one damaged file is an unreadable file
                return None

        return contents.map(one)

    return read


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, name, suffix, text)`` of the files of a known kind; text is null where none could be read."""
    files = read_files(spark, folder).where(F.col("suffix").isin(*TEXT_SUFFIXES, *PDF_SUFFIXES))
    reader = pdf_text()
    plain = F.make_valid_utf8(F.col("content").cast("string"))
    text = F.when(F.col("suffix").isin(*TEXT_SUFFIXES), plain)
    if reader is not None:
        text = text.when(F.col("suffix").isin(*PDF_SUFFIXES), reader("content"))
    return files.select("path", "name", "suffix", strip_nul(text).alias("text"))


def load_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, name, text, readable)``: text files as UTF-8 with replacement signs, PDF files if a reader is installed.

    Blank and unreadable files are left out (see :func:`skipped`); ``readable`` tells whether a text looks like language.
    """
    loaded = _texts(spark, folder).drop("suffix").where(F.trim("text") != "")
    return loaded.withColumn("readable", is_legible("text"))


def skipped(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, name, reason)`` of the files that :func:`load_documents` leaves out or finds not readable."""
    no_text = F.when(F.col("suffix").isin(*PDF_SUFFIXES), "damaged PDF file" if pdf_text() is not None else "no PDF reader installed").otherwise("unreadable")
    reason = F.when(F.col("text").isNull(), no_text).when(F.trim("text") == "", "blank").when(~is_legible("text"), "does not look like language")
    return _texts(spark, folder).select("path", "name", reason.alias("reason")).where("reason is not null")


def preflight(documents: DataFrame, text: str = "text", name: str = "name") -> DataFrame:
    """``(name, legibility, readable)``: which documents look like language."""
    score = legibility(text)
    return documents.select(name, score.alias("legibility"), is_legible(text).alias("readable"))


def pages_to_documents(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their plain text."""
    return pages.withColumn("text", html_to_text(html))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """``(question, expected_gap)``: one a line; comments and blank lines out, ``[gap]`` in front marks a gap."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    return questions(rows)


def questions(rows: DataFrame) -> DataFrame:
    gap = F.col("line").rlike(r"(?i)^\[gap\]\s*.+$")
    return rows.select(F.when(gap, F.regexp_extract("line", r"(?i)^\[gap\]\s*(.+)$", 1)).otherwise(F.col("line")).alias("question"), gap.alias("expected_gap"))


SUGGESTION = T.StructType([T.StructField(c, T.StringType()) for c in ("CLASS_TYPE", "CLASS_DESCRIPTION", "PARENT_CLASS_TYPE")])


def read_suggestions(spark: SparkSession, path: str) -> DataFrame:
    """``(label, description, parent_label)`` of a JSON list of suggested classes; a record without a type is an error."""
    rows = spark.read.schema(SUGGESTION).option("multiLine", "true").json(path)
    if not rows.where("CLASS_TYPE is null or trim(CLASS_TYPE) = ''").isEmpty():
        raise ValueError(f"{path}: a suggested class has no CLASS_TYPE")
    return suggestions(rows)


def suggestions(rows: DataFrame) -> DataFrame:
    return rows.select(F.trim("CLASS_TYPE").alias("label"), F.coalesce(F.trim("CLASS_DESCRIPTION"), F.lit("")).alias("description"), F.nullif(F.trim("PARENT_CLASS_TYPE"), F.lit("")).alias("parent_label"))


CELL = T.StructType([T.StructField("@id", T.StringType()), T.StructField("inColumn", T.StringType()), T.StructField("cellValue", T.StringType())])
ROW = T.StructType([T.StructField("@id", T.StringType()), T.StructField("rowIndex", T.IntegerType()), T.StructField("rowLabel", T.StringType()), T.StructField("isHeaderRow", T.BooleanType()), T.StructField("cells", T.ArrayType(CELL))])
COLUMN = T.StructType([T.StructField("@id", T.StringType()), T.StructField("columnIndex", T.IntegerType()), T.StructField("columnLabel", T.StringType())])
TABLE = T.StructType([T.StructField("@id", T.StringType()), T.StructField("caption", T.StringType()), T.StructField("pageNumber", T.IntegerType()), T.StructField("columns", T.ArrayType(COLUMN)), T.StructField("rows", T.ArrayType(ROW))])


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """One row a table of JSON bundles ``{"tables": [...]}``."""
    bundle = T.StructType([T.StructField("tables", T.ArrayType(TABLE))])
    return spark.read.schema(bundle).option("multiLine", "true").json(path).select(F.explode("tables").alias("t")).select("t.*")


def with_iri(documents: DataFrame, text: str = "text") -> DataFrame:
    digest = F.sha2(F.col(text).cast("binary"), 256)
    return documents.withColumn("content_hash", digest).withColumn("document_iri", document_iri("content_hash"))
