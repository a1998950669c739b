"""Landed files as frames: listings, whole objects, and CSV, JSON and Parquet read with tolerance for bad rows."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.text import basename, extension
from tidewater.operators.clean import flattened, numbered
from tidewater.operators.records import flattened_records
from tidewater.sources.objects import is_folder, walked, with_contents

#: Candidate delimiters, in the order that settles ties.
DELIMITERS = (",", ";", "\t", "|", ":")


def landing(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """Every file under a folder: path, modificationTime, length. Contents are not read. Tasks list a folder, so the driver gets no names; files, patterns,
    several folders and schemes that tasks cannot open are listed by Spark's reader."""
    if is_folder(folder):
        return walked(spark, folder).select("path", "length", "modificationTime")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")


def objects(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """Every file under a folder with its content."""
    if is_folder(folder):
        return with_contents(walked(spark, folder), folder)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def drop_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a local folder as catalog rows under raw/, with the path of each."""
    path = F.col("path")
    return landing(spark, folder).select(F.lit("lake").alias("bucket_name"), F.concat(F.lit("raw/"), basename(path)).alias("object_name"), F.col("length").alias("object_size"), extension(path).alias("file_format"), "path")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Width, height and channels of image files; files that cannot be decoded are left out."""
    return spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(folder).select("image.origin", "image.width", "image.height", "image.nChannels", "image.mode")


def file_type(name: Column, text: Column) -> Column:
    """csv, json or parquet by extension; else json if the first 1000 characters are JSON, else csv."""
    ext = extension(name)
    guess = F.when(F.try_parse_json(F.substring(text, 1, 1000)).isNotNull(), "json").otherwise("csv")
    return F.when(ext.isin("csv", "tsv", "txt"), "csv").when(ext == "json", "json").when(ext.isin("parquet", "pq"), "parquet").otherwise(guess)


def encoding(content: Column) -> Column:
    return F.when(F.is_valid_utf8(content), "UTF-8").otherwise("ISO-8859-1")


def decoded(content: Column) -> Column:
    """Text of file content, by its encoding."""
    return F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def delimiters(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, delimiter: the candidate whose count varies least over the first ten lines, relative to its mean.

    All within the row: per candidate the counts over lines, their mean over one plus their variance; the first greatest wins.
    """
    lines = F.filter(F.slice(F.split(F.substring(F.col(text), 1, 5000), "\n"), 1, 10), lambda x: F.trim(x) != "")

    def score(d: str) -> Column:
        counts = F.transform(F.col("lines"), lambda x: (F.char_length(x) - F.char_length(F.replace(x, F.lit(d), F.lit("")))).cast("double"))
        n = F.size("lines")
        mean = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) / n
        spread = F.aggregate(counts, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
        return F.when(n > 0, mean / (1 + spread)).otherwise(0.0)

    scored = files.select(key, lines.alias("lines")).select(key, *(score(d).alias(str(i)) for i, d in enumerate(DELIMITERS)))
    best = F.greatest(*(F.col(str(i)) for i in range(len(DELIMITERS))))
    picked = F.lit(DELIMITERS[0])
    for i in reversed(range(len(DELIMITERS))):
        picked = F.when((F.col(str(i)) == best) & (best > 0), DELIMITERS[i]).otherwise(picked)
    return scored.select(key, picked.alias("delimiter"))


def plain_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


#: Ways of quoting, in the order in which they are tried: doubled quotes, quotes escaped by a backslash, none.
QUOTINGS = ({"quote": '"', "escape": '"'}, {"quote": '"', "escape": "\\"}, {"quote": "", "escape": ""})


def _delimited(spark: SparkSession, paths: str | list[str], width: int, delimiter: str, charset: str, quoting: dict[str, str], lines: bool) -> DataFrame:
    """Columns 0, 1, ... of records that are not too long."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*map(str, range(width)), "_record"]])
    read = spark.read.schema(schema).options(**quoting).options(columnNameOfCorruptRecord="_record", columnPruning=False).csv(paths, header=True, sep=delimiter, mode="PERMISSIVE", encoding=charset, multiLine=lines)
    # a record of another length comes with its text: delimiters outside quotes, as this way of quoting has them, tell which are too long
    inside = r'"(?:[^"]|"")*"' if quoting["escape"] == '"' else r'"(?:[^"\\]|\\.)*"'
    bare = F.regexp_replace("_record", inside, "") if quoting["quote"] else F.col("_record")
    extra = F.char_length(bare) - F.char_length(F.replace(bare, F.lit(delimiter), F.lit("")))
    # always true: Spark refuses a query of the record alone, as a count would be
    some = F.coalesce(F.char_length("0"), F.lit(0)) >= 0
    return read.filter((F.col("_record").isNull() | (extra < width)) & some).drop("_record")


def tolerant_csv(spark: SparkSession, paths: str | list[str], columns: list[str], delimiter: str = ",", charset: str = "UTF-8") -> DataFrame:
    """Rows with too many fields are left out, short rows are filled with nulls; the first way of quoting that gives rows is taken.

    Files are read in pieces; those in which a quoted field may run over the end of a line, as a line has an odd number of quotes,
    are read whole, and no others. The driver gets the names of the files where there are both.
    """
    open_quote = spark.read.text(paths).filter(F.regexp_count("value", F.lit('"')) % 2 == 1).select(F.col("_metadata.file_path").alias("file")).distinct()
    whole = [r["file"] for r in open_quote.collect()]
    pieces = paths
    if whole:
        files = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file")).distinct()
        pieces = [r["file"] for r in files.collect() if r["file"] not in set(whole)]
    for quoting in QUOTINGS:
        found = [_delimited(spark, x, len(columns), delimiter, charset, quoting, lines) for x, lines in ((pieces, False), (whole, True)) if x]
        rows = reduce(DataFrame.unionAll, found)
        if not rows.isEmpty():
            break
    return rows.toDF(*columns)


def header_names(line: str, delimiter: str = ",") -> list[str]:
    """Names of columns from a header line: repeated ones are numbered, whatever their case; empty ones are named by their place."""
    fields = next(csv.reader([line], delimiter=delimiter), [])
    named = [x.strip() or f"Unnamed: {i}" for i, x in enumerate(fields)]
    counts = numbered([x.lower() for x in named])
    return [x if n == x.lower() else x + n[len(x) :] for x, n in zip(named, counts, strict=True)]


def csv_columns(spark: SparkSession, paths: str | list[str], delimiter: str = ",", charset: str = "UTF-8") -> list[str]:
    """Names from the first line of the first file."""
    # lines in another encoding: a separator that no header has leaves them whole
    lines = spark.read.schema("value string").options(quote="", escape="").csv(paths, sep="\x01", encoding=charset)
    first = lines.filter(F.trim("value") != "").first()
    return header_names(first["value"], delimiter) if first else []


def file_heads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, valid (all its lines are UTF-8), text (its first ten lines), header (the first that is not blank) of every text file; lines are read in pieces."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    facts = lines.groupBy("file").agg(F.every(F.is_valid_utf8("value")).alias("valid"), F.min(F.when(F.col("at") == 0, F.col("n"))).alias("first"))
    top = lines.filter("at = 0").join(facts, "file").filter(F.col("n") < F.col("first") + 10)
    texts = top.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "\n").alias("text"))
    lines_of = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return facts.join(texts, "file").select("file", "valid", "text", F.regexp_replace(F.get(lines_of, F.lit(0)), "\r$", "").alias("header"))


def ndjson(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """One object a line; lines that are not JSON are left out."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def json_document(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A single object or an array of objects."""
    return spark.read.option("multiLine", True).json(path)


def _alike(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, columns of either; those of unlike types as text."""
    types = [{f.name: f.dataType for f in x.schema} for x in (a, b)]
    unlike = [c for c in types[0] if c in types[1] and types[0][c] != types[1][c]]

    def as_text(df: DataFrame, kinds: dict) -> DataFrame:
        return df.withColumns({c: F.to_json(f"`{c}`") if isinstance(kinds[c], (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{c}`").cast("string") for c in unlike})

    return as_text(a, types[0]).unionByName(as_text(b, types[1]), allowMissingColumns=True)


#: Files up to this size may be read whole to see whether they are one document.
WHOLE_BYTES = 128 << 20


def _json_files(spark: SparkSession, path: str | list[str]) -> tuple[list[str], str | list[str]]:
    """The files that are one document, and the others, which are lines. A file whose first line is JSON, or cannot begin a document, is read line by line; of the others,
    those that are JSON as a whole are documents. Files over WHOLE_BYTES are not read for that: they are documents unless
    their second line is a record of its own, as where the first one was cut. The driver gets the names of the documents."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    here = lines.filter((F.col("at") == 0) & (F.trim("value") != ""))
    top = here.groupBy("file").agg(F.min_by("value", "n").alias("value"), F.min("n").alias("n"), F.min("size").alias("size"))
    second = here.alias("l").join(top.select("file", F.col("n").alias("first")).alias("t"), "file").filter(F.col("n") > F.col("first")).groupBy("file").agg(F.min_by("value", "n").alias("second"))
    begins = F.try_parse_json(F.trim("value")).isNull() & F.col("value").rlike(r'^\s*(\[|\{\s*("|$))')
    maybe = top.filter(begins).select("file", "value", "size")
    large = F.col("size") > WHOLE_BYTES
    known = {r["file"]: r["large"] for r in maybe.select("file", large.alias("large")).collect()}
    if not known:
        return [], path
    small = [f for f, is_large in known.items() if not is_large]
    whole = [r["file"] for r in spark.read.text(small, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json(F.trim("value")).isNotNull().alias("whole")).filter("whole").collect()] if small else []
    if len(small) < len(known):
        record = F.try_parse_json(F.trim("second")).isNotNull() & F.trim("second").startswith("{") & F.trim("value").startswith("{")
        whole += [r["file"] for r in maybe.filter(large).join(second, "file", "left").filter(~F.coalesce(record, F.lit(False))).select("file").collect()]
    rest = [r["file"] for r in lines.select("file").distinct().collect() if r["file"] not in set(whole)]
    return whole, rest


def any_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Each file by its content; lines that are not JSON are left out."""
    found = [f(spark, x) for f, x in zip((json_document, ndjson), _json_files(spark, path), strict=True) if x]
    return found[0] if len(found) == 1 else _alike(*found)


def json_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """record (VARIANT): the objects of files of lines, of arrays and of single objects, whatever their shape."""
    whole, rest = _json_files(spark, path)
    v, kind = F.try_parse_json("value"), F.schema_of_variant(F.col("record"))
    parts = []
    if rest:
        parts.append(spark.read.text(rest).select(v.alias("record")))
    if whole:
        parts.append(spark.read.text(whole, wholetext=True).select(v.alias("record")).select(F.explode(F.when(kind.startswith("ARRAY"), F.try_variant_get("record", "$", "array<variant>")).otherwise(F.array("record"))).alias("record")))
    return reduce(DataFrame.unionByName, parts).filter(kind.startswith("OBJECT"))


def flat_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records as columns named by their paths. Where a text of Spark's own reader may be an object, as where a field is an object here and
    something else there, records are read as VARIANT, so that both get columns."""
    plain = flattened(any_json(spark, path))
    texts = [F.col(f"`{f.name}`").rlike(r"^\s*\{") for f in plain.schema if isinstance(f.dataType, T.StringType)]
    mixed = bool(texts) and not plain.filter(reduce(lambda a, b: a | b, (F.coalesce(x, F.lit(False)) for x in texts))).isEmpty()
    return flattened_records(json_records(spark, path)) if mixed else plain


def structured(spark: SparkSession, path: str) -> DataFrame:
    """A landed object (a file, or a folder of its parts) as a frame: parts of like type, delimiter, encoding and header are read
    together, columns of unlike ones are matched by name.

    The driver gets the names of the parts, as it does to plan any read. Nested JSON is flattened."""
    named = landing(spark, path).select("path", extension(F.col("path")).alias("ext"))
    stored = [r["path"] for r in named.filter(F.col("ext").isin("parquet", "pq")).collect()]
    frames = [spark.read.parquet(*stored)] if stored else []
    texts = [r["path"] for r in named.filter(~F.col("ext").isin("parquet", "pq")).collect()]
    if texts:
        heads = file_heads(spark, texts)
        found = heads.select("file", "valid", file_type(F.col("file"), F.col("text")).alias("type"), "header").join(delimiters(heads, "file", "text"), "file")
        csv_only = lambda c: F.when(F.col("type") == "csv", F.col(c)).alias(c)
        for r in found.groupBy("type", "valid", csv_only("delimiter"), csv_only("header")).agg(F.array_sort(F.collect_list("file")).alias("files")).collect():
            charset = "UTF-8" if r["valid"] else "ISO-8859-1"
            if r["type"] == "csv":
                # the header of a file that is not UTF-8 is read again in its encoding
                names = header_names(r["header"] or "", r["delimiter"]) if r["valid"] else csv_columns(spark, r["files"], r["delimiter"], charset)
                if names:
                    frames.append(tolerant_csv(spark, r["files"], names, r["delimiter"], charset))
            else:
                frames.append(flat_json(spark, r["files"]))
    if not frames:
        raise ValueError(f"no files in {path}")
    return reduce(_alike, frames)
