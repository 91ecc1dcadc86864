"""Structured tables: grids to JSON-LD records, candidate strings, flat summaries, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import part_iri, table_iri
from ..functions.shapes import is_table_candidate
from ..functions.text import col, looks_numeric, normalize_name


def from_grid(df: DataFrame, grid: str = "grid", digest: str = "content_hash", index: str = "table_index", caption: str = "caption", page: str = "page_number") -> DataFrame:
    """A ``table`` struct of each rectangular grid: the first row names columns.

    The first column labels rows if none of its cells below the header is empty or a number.
    """
    cells = F.transform(grid, lambda r: F.transform(r, lambda x: F.trim(F.coalesce(x, F.lit("")))))
    df = df.withColumn("_g", cells).withColumn("_iri", table_iri(digest, index))
    body = F.slice("_g", 2, F.greatest(F.size("_g") - 1, F.lit(0)))
    labels = (F.size(body) > 0) & F.forall(body, lambda r: (r[0] != "") & ~looks_numeric(r[0]))
    df = df.withColumn("_body", body).withColumn("_from", F.when(labels, 1).otherwise(0))
    rest = lambda r: F.slice(r, F.col("_from") + 1, F.greatest(F.size(r) - F.col("_from"), F.lit(0)))
    columns = F.transform(rest(F.get("_g", F.lit(0))), lambda x, i: F.struct(part_iri("_iri", "Col", i).alias("@id"), i.cast("int").alias("columnIndex"), F.nullif(x, F.lit("")).alias("columnLabel")))
    rows = F.transform(
        "_body",
        lambda r, i: F.struct(
            part_iri("_iri", "Row", i).alias("@id"),
            i.cast("int").alias("rowIndex"),
            F.when(F.col("_from") == 1, r[0]).alias("rowLabel"),
            F.lit(False).alias("isHeaderRow"),
            F.transform(rest(r), lambda x, j: F.struct(part_iri("_iri", "Cell", i, j).alias("@id"), part_iri("_iri", "Col", j).alias("inColumn"), x.alias("cellValue"))).alias("cells"),
        ),
    )
    table = F.struct(F.col("_iri").alias("@id"), F.col(caption).alias("caption"), F.col(page).alias("pageNumber"), columns.alias("columns"), rows.alias("rows"))
    return df.withColumn("table", table).drop("_g", "_iri", "_body", "_from")


def strings(table: Column | str) -> Column:
    """Caption, then each row's label and cells, in order."""
    t = col(table)
    rows = F.transform(t["rows"], lambda r: F.concat(F.array(r["rowLabel"]), F.transform(r["cells"], lambda c: c["cellValue"])))
    return F.concat(F.array(t["caption"]), F.flatten(rows))


def candidates(tables: DataFrame, key: str = "table_id", table: str = "table") -> DataFrame:
    """``(key, position, value)``: strings that could name entities, the first of each normalized form."""
    rows = tables.select(key, F.posexplode(strings(table)).alias("position", "value")).where(is_table_candidate("value"))
    rows = rows.withColumn("_n", normalize_name("value")).where("_n <> ''")
    first = F.row_number().over(Window.partitionBy(key, "_n").orderBy("position"))
    return rows.withColumn("_r", first).where("_r = 1").select(key, "position", F.trim("value").alias("value"))


def summary(table: Column | str, most_cells: int = 60) -> Column:
    """Caption, column line and row lines until the budget of cells is spent."""
    t = col(table)
    head = F.concat(F.lit("Columns: "), F.array_join(F.filter(F.transform(t["columns"], lambda c: c["columnLabel"]), lambda x: x.isNotNull()), " | "))
    line = lambda r: F.concat_ws(": ", r["rowLabel"], F.array_join(F.transform(r["cells"], lambda c: c["cellValue"]), " | "))
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("lines"))
    add = lambda s, r: F.when(s["n"] + F.size(r["cells"]) <= most_cells, F.struct((s["n"] + F.size(r["cells"])).alias("n"), F.concat(s["lines"], F.array(line(r))).alias("lines"))).otherwise(F.struct(F.lit(most_cells + 1).alias("n"), s["lines"].alias("lines")))
    lines = F.aggregate(t["rows"], zero, add, lambda s: s["lines"])
    return F.array_join(F.filter(F.concat(F.array(t["caption"], head), lines), lambda x: x.isNotNull()), "\n")


def problems(table: Column | str) -> Column:
    """What a table record lacks, as a list; empty if it is sound."""
    t = col(table)
    ids = F.transform(t["columns"], lambda c: c["@id"])
    stray = F.exists(t["rows"], lambda r: F.exists(r["cells"], lambda c: ~F.array_contains(ids, c["inColumn"])))
    found = [(t["@id"].isNull(), "no @id"), (t["columns"].isNull() | (F.size(t["columns"]) == 0), "no columns"), (t["rows"].isNull(), "no rows"), (F.coalesce(stray, F.lit(False)), "a cell of an unknown column")]
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in found]))


def without_stray_cells(table: Column | str) -> Column:
    """The rows with only those cells whose column is known."""
    t = col(table)
    ids = F.transform(t["columns"], lambda c: c["@id"])
    return t.withField("rows", F.transform(t["rows"], lambda r: r.withField("cells", F.filter(r["cells"], lambda c: F.array_contains(ids, c["inColumn"])))))


def concepts(proposals: DataFrame, anchors: tuple[str, ...]) -> DataFrame:
    """``(label, parent_iri, sources, first_label)`` of ``proposals(label, parent_iri, table_id, position)`` under the anchors.

    Proposals with an equal normalized label and parent are one.
    """
    from ..functions.text import table_label

    rows = proposals.where(F.col("parent_iri").isin(*anchors)).withColumn("_k", table_label("label")).where("_k <> ''")
    return rows.groupBy(F.col("_k").alias("label"), "parent_iri").agg(F.array_sort(F.collect_set("table_id")).alias("sources"), F.min_by("label", F.struct("table_id", "position")).alias("first_label"))
