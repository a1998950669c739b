"""Documents from their units (paragraphs, pages, slides) and tables from their cells.

Cells are kept long: table_no, row_no, col_no, text. Column sets differ from table to table, so a pivot is only made for one
table at a time. Lists gathered for a document or a table are as long as that document or table. Joins on tables, rows and columns are
hinted as merges: Spark would judge the small keys by their bytes in files, and their hash tables would fill the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import column_name, trimmed
from tidewater.operators.infer import facts, left_open, numeric, told, verdict


def visible_units(units: DataFrame) -> DataFrame:
    """Units whose text is not blank."""
    return units.filter(trimmed(F.col("text")) != "")


def table_sizes(cells: DataFrame) -> DataFrame:
    """table_no, first and last row, and last column of each table."""
    return cells.groupBy("table_no").agg(F.min("row_no").alias("first"), F.max("row_no").alias("last"), F.max("col_no").cast("int").alias("last_col"))


def whole_tables(cells: DataFrame) -> DataFrame:
    """Cells of tables with a header and at least one row more."""
    sizes = table_sizes(cells).filter(F.col("last") > F.col("first"))
    return cells.join(sizes.select("table_no").hint("merge"), "table_no", "left_semi")


def _joined(texts: str, separator: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", texts))), lambda x: x[texts]), separator)


def document_text(units: DataFrame, separator: str = "\n") -> DataFrame:
    """Text of each document: its visible units in order."""
    return visible_units(units).groupBy("doc_no").agg(_joined("text", separator).alias("text"))


def page_text(units: DataFrame) -> DataFrame:
    """Text of each document: all units in order, with nothing between."""
    return units.groupBy("doc_no").agg(_joined("text", "").alias("text"))


def slides(units: DataFrame) -> DataFrame:
    """doc_no, title (the last), body (in order) and notes (joined by a line break) of each document's units."""
    ordered = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "text")))), lambda x: x["text"])
    return visible_units(units).groupBy("doc_no").agg(F.max_by(F.when(F.col("kind") == "title", F.col("text")), F.when(F.col("kind") == "title", F.col("pos"))).alias("title"), ordered("body").alias("body"), F.array_join(ordered("notes"), "\n").alias("notes"))


def deck_text(units: DataFrame) -> DataFrame:
    """Units with their labels, joined by blank lines."""
    label = F.when(F.col("kind") == "title", F.concat(F.lit("SLIDE "), (F.col("pos") + 1).cast("string"), F.lit(": "), F.col("text"))).when(F.col("kind") == "notes", F.concat(F.lit("Notes: "), F.col("text"))).otherwise(F.col("text"))
    return visible_units(units).withColumn("text", label).groupBy("doc_no").agg(_joined("text", "\n\n").alias("text"))


def with_extracted_flag(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_extracted", F.coalesce(F.length(trimmed(F.col("text_content"))) > 0, F.lit(False)))


def unit_counters(units: DataFrame) -> DataFrame:
    """Units of each kind and characters of text, for each document."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("title", "body", "notes")]
    return units.groupBy("doc_no").agg(F.count(F.lit(1)).alias("n_units"), *kinds, F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("n_chars"))


def cell_counters(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_no").agg((F.max("row_no") + 1).alias("n_rows"), (F.max("col_no") + 1).alias("n_columns"), F.count(F.lit(1)).alias("n_cells"))


def padded(cells: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Every row as wide as its table's widest, missing and null cells as empty text. With sizes (table_no, last_col), cells may be
    some rows of the tables; tables that have no size are left out.

    Cells that are there stay as they are; a row's list of columns, as long as the row, tells those that are missing."""
    width = (table_sizes(cells) if sizes is None else sizes).filter("last_col >= 0").select("table_no", "last_col").hint("merge")
    rows = cells.filter("row_no IS NOT NULL").groupBy("table_no", "row_no").agg(F.collect_list(F.struct(F.col("col_no").cast("int").alias("col_no"), F.coalesce("text", F.lit("")).alias("text"))).alias("there"))
    blank = lambda i: F.struct(i.alias("col_no"), F.lit("").alias("text"))
    missing = F.transform(F.array_except(F.sequence(F.lit(0), F.col("last_col")), F.transform("there", lambda x: x["col_no"])), blank)
    whole = F.concat(F.filter("there", lambda x: x["col_no"] >= 0), missing)
    return rows.join(width, "table_no").select("table_no", "row_no", F.inline(whole))


def headers(cells: DataFrame, first_suffix: int = 1, blank: str = "") -> DataFrame:
    """table_no, col_no, col_name from each table's first row: cleaned, with suffixes for repeats; column_<i> if all are blank.

    The second of a name gets first_suffix. A header row is as wide as its table, so its window is small.
    """
    table = Window.partitionBy("table_no")
    top = cells.filter(F.col("row_no") == 0).withColumn("text", F.coalesce(trimmed(F.col("text")), F.lit("")))
    blanks = top.withColumn("all_blank", F.every(F.col("text") == "").over(table))
    named = blanks.withColumn("name", F.when(F.col("all_blank"), F.concat(F.lit("column_"), F.col("col_no").cast("string"))).when(F.lit(blank != "") & (F.col("text") == ""), F.lit(blank)).otherwise(column_name(F.col("text"))))
    nth = F.row_number().over(Window.partitionBy("table_no", "name").orderBy("col_no"))
    suffixed = F.when(F.col("nth") > 1, F.concat("name", F.lit("_"), (F.col("nth") - 2 + first_suffix).cast("string"))).otherwise(F.col("name"))
    return named.withColumn("nth", nth).select("table_no", "col_no", suffixed.alias("col_name"))


def promoted(cells: DataFrame, first_suffix: int = 1, blank: str = "") -> DataFrame:
    """Data cells with the names of their columns: table_no, row_no, col_no, col_name, value."""
    return cells.filter(F.col("row_no") > 0).join(headers(cells, first_suffix, blank).hint("merge"), ["table_no", "col_no"]).select("table_no", "row_no", "col_no", "col_name", F.col("text").alias("value"))


def normalised(data: DataFrame) -> DataFrame:
    """Data cells trimmed, blanks as null, without rows and columns that have no value: for each table, in long form."""
    value = trimmed(F.col("value"))
    clean = data.withColumn("value", F.when(value != "", value))
    rows = clean.filter(F.col("value").isNotNull()).select("table_no", "row_no").distinct()
    columns = clean.filter(F.col("value").isNotNull()).select("table_no", "col_no").distinct()
    return clean.join(rows.hint("merge"), ["table_no", "row_no"], "left_semi").join(columns.hint("merge"), ["table_no", "col_no"], "left_semi")


KEYS = ("table_no", "col_no", "col_name")


def column_types(data: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """table_no, col_no, col_name, inferred_type, decimal (Spark's type, of a NUMERIC column) and formats (of a TIMESTAMP one) of every column of
    every table, from long data cells: one aggregate."""
    listed = lambda made: [f"{x} AS {k}" for k, x in made.items()]
    second = data.selectExpr(*keys, *listed(told("value"))).selectExpr("*", *listed(left_open()))
    found = second.groupBy(*keys).agg(*(F.expr(x).alias(k) for k, x in facts().items()))
    return found.selectExpr(*keys, f"{verdict()} AS inferred_type", f"{numeric()} AS decimal", "coalesce(formats, 0) AS formats")


def _names_and_values(cells: DataFrame, first_suffix: int) -> tuple[DataFrame, DataFrame]:
    """Names of the columns of tables with a header and at least one row more, and all data cells, trimmed and blanks as null."""
    sizes = table_sizes(cells).filter(F.col("last") > F.col("first"))
    names = headers(padded(cells.filter(F.col("row_no") == 0), sizes), first_suffix)
    value = trimmed(F.col("text"))
    return names, cells.filter(F.col("row_no") > 0).select("table_no", "row_no", F.col("col_no").cast("int").alias("col_no"), F.when(value != "", value).alias("value"))


def data_cells(cells: DataFrame, first_suffix: int = 1) -> DataFrame:
    """Every table's data cells, named and normalised: the chain from cells up to types and the load, without its joins of all cells
    with each other. Rows without values are left out as they are gathered, and the others filled up to the columns that have values."""
    names, values = _names_and_values(cells, first_suffix)
    said = values.filter(F.col("value").isNotNull()).select("table_no", "col_no").distinct()
    columns = names.join(said.hint("merge"), ["table_no", "col_no"], "left_semi")
    listed = columns.groupBy("table_no").agg(F.collect_set("col_no").alias("columns"))
    rows = values.groupBy("table_no", "row_no").agg(F.collect_list(F.struct("col_no", "value")).alias("there"), F.count("value").alias("n")).filter("n > 0")
    missing = F.transform(F.array_except("columns", F.transform("there", lambda x: x["col_no"])), lambda i: F.struct(i.alias("col_no"), F.lit(None).cast("string").alias("value")))
    filled = rows.join(listed.hint("merge"), "table_no").select("table_no", "row_no", F.inline(F.concat("there", missing)))
    return filled.join(columns.hint("merge"), ["table_no", "col_no"]).select("table_no", "row_no", "col_no", "col_name", "value")


def typed_tables(cells: DataFrame, first_suffix: int = 1) -> DataFrame:
    """Every table's columns with names and types: values are told by table and column, and only what is told of a column meets its name."""
    names, values = _names_and_values(cells, first_suffix)
    types = column_types(values.filter(F.col("value").isNotNull()), KEYS[:2])
    return types.join(names.hint("merge"), ["table_no", "col_no"]).select(*KEYS, "inferred_type")


def csv_field(value: Column) -> Column:
    """A field of a CSV line: null is empty; quoted where it holds a comma, a quote or a line break."""
    text = F.coalesce(value, F.lit(""))
    return F.when(text.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_texts(data: DataFrame) -> DataFrame:
    """table_no, content, n_rows: each table's data cells as CSV text with a header. A table is one row, as it is one object."""
    in_order = lambda names, what: F.transform(F.array_sort(F.collect_list(F.struct(*names))), lambda x: x[what])
    fields = data.withColumn("field", csv_field(F.col("value")))
    lines = fields.groupBy("table_no", "row_no").agg(F.array_join(in_order(("col_no", "field"), "field"), ",").alias("line"))
    names = data.select("table_no", "col_no", csv_field(F.col("col_name")).alias("name")).distinct().groupBy("table_no").agg(F.array_join(in_order(("col_no", "name"), "name"), ",").alias("head"))
    bodies = lines.groupBy("table_no").agg(in_order(("row_no", "line"), "line").alias("lines"), F.count(F.lit(1)).alias("n_rows"))
    return bodies.join(names, "table_no").select("table_no", F.concat(F.array_join(F.concat(F.array("head"), F.col("lines")), "\n"), F.lit("\n")).alias("content"), "n_rows")


#: Folders and forms of the keys of extracted tables, of which the place is a page or slide.
TABLE_KEYS = {"pdf": "processed/structured/pdf-tables/%s_page%d_table%d.csv", "docx": "processed/structured/docx-tables/%s_table_%d.csv", "pptx": "processed/structured/ppt-tables/%s_slide%d_table%d.csv"}


def table_key(kind: str, file_stem: Column, place: Column, nth: Column) -> Column:
    """The key of a document's table: the nth on its page or slide, or (docx) in the document."""
    return F.format_string(TABLE_KEYS[kind], file_stem, *(() if kind == "docx" else (place,)), nth)


def table_keys(cells: DataFrame, file_stem: str) -> DataFrame:
    """table_no and the key of each table's CSV object."""
    return cells.select("table_no").distinct().withColumn("table_key", F.concat(F.lit(f"{file_stem}_table_"), (F.col("table_no") + 1).cast("string"), F.lit(".csv")))
