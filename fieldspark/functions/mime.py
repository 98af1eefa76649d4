"""Media type and kind of a file by its suffix."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {
    "text": "csv htm html json md tsv txt xls xlsx xml yaml yml", "image": "bmp gif jpeg jpg png tiff webp", "pdf": "pdf", "zip": "zip",
    "audio": "aac flac m4a mp3 ogg wav wma", "video": "avi mkv mov mp4 webm wmv", "office": "doc docx ppt pptx",
}
_OFFICE = "application/vnd.openxmlformats-officedocument."
OWN = {
    "csv": "text/csv", "tsv": "text/tab-separated-values", "md": "text/markdown", "xml": "application/xml", "json": "application/json", "yml": "application/yaml", "yaml": "application/yaml", "pdf": "application/pdf",
    "ppt": "application/vnd.ms-powerpoint", "xls": "application/vnd.ms-excel", "doc": "application/msword", "pptx": f"{_OFFICE}presentationml.presentation", "xlsx": f"{_OFFICE}spreadsheetml.sheet", "docx": f"{_OFFICE}wordprocessingml.document",
}
UNKNOWN = "application/octet-stream"


def mime_of(suffix: str) -> str:
    return OWN.get(suffix) or mimetypes.guess_type(f"x.{suffix}")[0] or UNKNOWN


def suffix(path: Column) -> Column:
    """What follows the last dot of the name, in lower case; empty for none and for names that begin with their only dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def mime_map(spark: SparkSession) -> DataFrame:
    """(ext, mime, kind), one row for each known suffix."""
    return spark.createDataFrame([(e, mime_of(e), kind) for kind, exts in KINDS.items() for e in exts.split()], "ext string, mime string, kind string")


def with_mime(df: DataFrame, path: str = "path") -> DataFrame:
    """df with ext, mime and kind; unknown suffixes are binary. The map has a fixed size, so it is broadcast."""
    known = F.broadcast(mime_map(df.sparkSession))
    found = df.withColumn("ext", suffix(F.col(path))).join(known, "ext", "left")
    return found.withColumns({"mime": F.coalesce("mime", F.lit(UNKNOWN)), "kind": F.coalesce("kind", F.lit("binary"))})


def wrap_text(name: Column, mime: Column, text: Column) -> Column:
    """A text between marks that name its file and media type."""
    return F.concat(F.lit("=== FILE "), name, F.lit(" ("), mime, F.lit(") ===\n"), text, F.lit("\n=== END OF "), name, F.lit(" ==="))
