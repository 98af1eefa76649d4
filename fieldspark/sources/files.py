"""Files as rows: texts, spreadsheets and archives are read here, all else stays binary."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.mime import with_mime, wrap_text


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, file_ord, size, content, ext, mime, kind); a path that doesn't exist is an error. Order is that of the paths."""
    wanted = [paths] if isinstance(paths, str) else [*paths]
    wanted = [resolved(p) for p in wanted]
    raw = spark.read.format("binaryFile").load(wanted).select("path", F.col("length").alias("size"), "content")
    # paths are compared whole, without scheme and host; of nested ones the longest counts
    bare = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    ranked = sorted(range(len(wanted)), key=lambda i: -len(wanted[i]))
    at = F.lit(None).cast("int")
    for i in reversed(ranked):
        own = F.lit(re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", wanted[i]).rstrip("/"))
        at = F.when((bare == own) | F.startswith(bare, F.concat(own, F.lit("/"))), F.lit(i + 1)).otherwise(at)
    return with_mime(raw.withColumn("file_ord", at))


def resolved(path: str) -> str:
    """A local path made absolute, with ~ expanded; others, which name a scheme, as they are."""
    return path if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path) else str(Path(path).expanduser().resolve())


def as_text(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes aren't UTF-8."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def cell_place(ref: str) -> tuple[int, int]:
    """(row, column), from 1, of a cell's name such as BC12; (1, 1) if it isn't one."""
    found = re.fullmatch(r"([A-Z]+)([0-9]+)", ref.upper())
    if not found:
        return 1, 1
    column = 0
    for c in found[1]:
        column = column * 26 + ord(c) - 64
    return int(found[2]), column


def cell_coordinates(ref: Column) -> Column:
    """struct<row, column> of a column of cells' names, as ``cell_place``."""
    name = F.upper(ref)
    letters = F.regexp_extract(name, r"^([A-Z]+)[0-9]+$", 1)
    column = F.aggregate(F.split(letters, ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)
    row = F.regexp_extract(name, r"^[A-Z]+([0-9]+)$", 1).try_cast("int")
    good = F.coalesce(letters != "", F.lit(False))
    return F.struct(F.when(good, row).otherwise(1).alias("row"), F.when(good, column).otherwise(1).alias("column"))


def _tag(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _strings(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _tag(x) == "t")


def xlsx_text(content: bytes) -> str:
    """All sheets as tab-separated text under a heading each. Cells are raw values: no styles, no dates."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        tree = lambda name: ElementTree.fromstring(book.read(name))
        shared = [_strings(x) for x in tree("xl/sharedStrings.xml") if _tag(x) == "si"] if "xl/sharedStrings.xml" in names else []
        titles = [x.get("name", "") for x in tree("xl/workbook.xml").iter() if _tag(x) == "sheet"] if "xl/workbook.xml" in names else []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=lambda n: (len(n), n))
        blocks = []
        for i, name in enumerate(sheets):
            rows: dict[int, dict[int, str]] = {}
            for cell in (x for x in tree(name).iter() if _tag(x) == "c"):
                row, column = cell_place(cell.get("r", ""))
                kind = cell.get("t")
                value = next((x.text or "" for x in cell if _tag(x) == "v"), "")
                if kind == "s":
                    value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                elif kind == "inlineStr":
                    value = _strings(cell)
                rows.setdefault(row, {})[column] = value
            lines = ["\t".join(cells.get(c, "") for c in range(1, max(cells) + 1)) for _, cells in sorted(rows.items())]
            blocks.append("\n".join([f"### {titles[i] if i < len(titles) else f'Sheet{i + 1}'}", *lines]))
    return "\n\n".join(blocks)


def unzipped(files: DataFrame) -> DataFrame:
    """Archives' members in place of the archives: path is archive!member, in order. Nothing is written to disk.

    Directories and nested archives aren't opened; members of equal base names stay apart. What isn't an
    archive passes through. An archive that can't be read is one row, its own, with the reason in ``error``.
    """
    keys = ["path", "file_ord", "size", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, ord_, size, content, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if kind != "zip":
                    out.append((path, ord_, 0, size, content, None))
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        members = [m for m in z.infolist() if not m.is_dir()]
                        out += [(f"{path}!{m.filename}", ord_, k, m.file_size, z.read(m), None) for k, m in enumerate(members)]
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError) as e:  # broken, encrypted or packed in an unknown way
                    out.append((path, ord_, 0, size, content, f"{type(e).__name__}: {e}"))
            cols = [*zip(*out)] or [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "file_ord", "member_ord", "size", "content", "error"])

    return with_mime(files.select(*keys, "kind").mapInArrow(run, "path string, file_ord int, member_ord int, size long, content binary, error string"))


@F.pandas_udf(T.StringType())
def _sheet_text(content: pd.Series) -> pd.Series:
    def one(data: bytes | None) -> str | None:
        try:
            return None if data is None else xlsx_text(bytes(data))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None

    return content.map(one)


def parts(files: DataFrame) -> DataFrame:
    """(path, file_ord, member_ord, mime, kind, text, content, error): text of what can be read as text, else the bytes.

    Old spreadsheets (.xls) need an office suite to convert them; without one their bytes are read as text.
    """
    flat = unzipped(files)
    text = F.when(F.col("ext") == "xlsx", _sheet_text("content")).when(F.col("kind") == "text", as_text(F.col("content")))
    wrapped = wrap_text(F.regexp_extract("path", "[^/]*$", 0), F.col("mime"), text)
    return flat.select("path", "file_ord", "member_ord", "mime", "kind", wrapped.alias("text"), F.when(text.isNull(), F.col("content")).alias("content"), "error")


def flattened(parts_: DataFrame, group: str) -> DataFrame:
    """(group, text, payloads): all texts of a group in order, and its binary parts."""
    order = F.struct("file_ord", "member_ord")
    rows = parts_.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "text"))).alias("t"), F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct(order.alias("o"), "mime", "content")))).alias("b"))
    texts = F.filter(F.transform("t", lambda x: x["text"]), lambda x: x.isNotNull())
    return rows.select(group, F.array_join(texts, "\n\n").alias("text"), F.transform("b", lambda x: F.struct(x["mime"].alias("mime"), x["content"].alias("content"))).alias("payloads"))
