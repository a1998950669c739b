"""Paths, names and text as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted extensions, and the category of each.
CATEGORIES = {"csv": "structured", "json": "structured", "parquet": "structured", "pq": "structured", "tsv": "structured", "txt": "structured", "pdf": "pdf", "docx": "docx", "doc": "docx", "png": "image", "jpg": "image", "jpeg": "image", "pptx": "ppt", "ppt": "ppt"}
ACCEPTED = ("csv", "json", "parquet", "pdf", "docx", "doc", "png", "jpg", "jpeg", "txt", "pptx", "ppt")
#: The pipeline of each routed extension.
ROUTES = {"csv": "structured", "json": "structured", "parquet": "structured", "pdf": "pdf", "docx": "docx", "doc": "docx", "pptx": "ppt", "ppt": "ppt", "png": "image", "jpg": "image", "jpeg": "image"}
#: White space of Unicode.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
#: Leading bytes (hex) of the accepted kinds, and their MIME types.
MAGIC = (("25504446", "application/pdf"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("504B0304", "application/zip"), ("D0CF11E0", "application/x-ole-storage"), ("50415231", "application/vnd.apache.parquet"))

#: Names in packed office files that tell their kind, and their MIME types.
OFFICE = ((b"word/", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), (b"ppt/", "application/vnd.openxmlformats-officedocument.presentationml.presentation"), (b"xl/", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"))


def extension(path: Column) -> Column:
    """After the last dot, in lower case; empty if there is no dot."""
    return F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1))).otherwise("")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def processed_key(path: Column, folder: str = "processed/structured/", ext: str = "parquet") -> Column:
    """raw/ becomes the folder, the extension becomes ext."""
    return F.regexp_replace(F.replace(path, F.lit("raw/"), F.lit(folder)), r"\.[^.]*$", f".{ext}")


def upload_key(path: Column) -> Column:
    """raw/<category>/<name>."""
    return F.concat(F.lit("raw/"), category(extension(path)), F.lit("/"), basename(path))


def category(ext: Column) -> Column:
    pairs = [F.lit(x) for k, v in CATEGORIES.items() for x in (k, v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("other"))


def route(ext: Column) -> Column:
    pairs = [F.lit(x) for k, v in ROUTES.items() for x in (k, v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("unsupported"))


def column_name(name: Column) -> Column:
    """A column name from any text: word characters, single underscores, lower case, never empty or led by a digit."""
    marked = F.regexp_replace(trimmed(name), r"(?U)[^\w\s]", "_")
    joined = F.regexp_replace(F.regexp_replace(marked, r"(?U)\s+", "_"), "^_+|_+$", "")
    led = F.when(joined.rlike(r"^\p{Nd}"), F.concat(F.lit("col_"), joined)).otherwise(joined)
    return F.when(led == "", "unnamed_column").otherwise(F.lower(led))


def table_name(path: Column) -> Column:
    """data_<stem> of word characters in lower case, at most 63 characters."""
    cleaned = F.lower(F.regexp_replace(F.regexp_replace(stem(path), r"(?U)[^\w]", "_"), "^_+|_+$", ""))
    return F.substring(F.concat(F.lit("data_"), cleaned), 1, 63)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(text, F.lit(SPACES))


def preview(text: Column, length: int = 200) -> Column:
    return F.substring(text, 1, length)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def mime_type(content: Column) -> Column:
    """From leading bytes, and of packed office files from the names that they hold; text or octet-stream otherwise."""
    head = F.hex(F.substring(content, 1, 4))
    # of a longer text, the last character read may be cut
    valid = lambda n: F.is_valid_utf8(F.substring(content, 1, n))
    cut = (F.octet_length(content) > 512) & (valid(511) | valid(510) | valid(509))
    out = F.when(valid(512) | cut, "text/plain").otherwise("application/octet-stream")
    for digits, mime in reversed(MAGIC):
        out = F.when(head.startswith(digits), mime).otherwise(out)
    for name, mime in OFFICE:
        out = F.when((head == "504B0304") & F.contains(content, F.lit(name)), mime).otherwise(out)
    return out


def kilobytes(size: Column, digits: int = 2) -> Column:
    return F.bround(size / 1024, digits)


def megabytes(size: Column) -> Column:
    return F.bround(size / (1024 * 1024), 2)


def gigabytes(size: Column) -> Column:
    return F.bround(size / (1024 * 1024 * 1024), 2)


#: The fields of each kind of object's metadata.
METADATA = {
    "upload": ("original_filename", "mime_type", "upload_time", "source"),
    "local": ("original_filename", "mime_type", "ingest_time", "source"),
    "structured": ("row_count", "column_count", "columns", "data_types"),
    "pdf": ("author", "creator", "producer", "subject", "title", "creation_date", "page_count", "table_count"),
    "docx": ("author", "created", "modified", "title", "subject", "category", "comments", "table_count", "paragraph_count"),
    "ppt": ("author", "created", "modified", "title", "subject", "category", "comments", "slide_count", "table_count", "image_count"),
    "image": ("width", "height", "format", "mode", "exif"),
}


def metadata(kind: str, **fields: Column) -> Column:
    """JSON text with all fields of the kind in order; those not given are null."""
    unknown = set(fields) - set(METADATA[kind])
    if unknown:
        raise ValueError(f"{kind} has no {sorted(unknown)}")
    return F.to_json(F.struct(*(fields.get(f, F.lit(None).cast("string")).alias(f) for f in METADATA[kind])), {"ignoreNullFields": "false"})
