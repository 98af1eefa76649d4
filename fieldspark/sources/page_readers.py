"""Page tables of files, by a reader that the caller supplies; PDF and OCR libraries stay optional."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Page:
    """Number (from 1), text layer, images on it, and the text that OCR reads from it, if it ran."""

    number: int
    text: str
    images: int = 0
    ocr: str | None = None


class PageReader(Protocol):
    def pages(self, path: str, content: bytes) -> Iterator[Page]: ...


class FormFeedReader:
    """Texts whose pages are parted by form feeds."""

    def pages(self, path: str, content: bytes) -> Iterator[Page]:
        for i, text in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
            yield Page(i, text)


class PyMuPdfReader:
    """PDFs by PyMuPDF, where that is installed."""

    def pages(self, path: str, content: bytes) -> Iterator[Page]:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as book:
            for i, page in enumerate(book, 1):
                yield Page(i, page.get_text(), len(page.get_images()))


_ROWS = "path string, page_no int, text string, n_images int, ocr string, error string"


def read_pages(files: DataFrame, reader: PageReader) -> DataFrame:
    """(path, page_no, text, n_images, ocr, error): the pages of each file; a file that can't be read is a row with an error.

    Files are read in parallel as their partitions are, so no pool of threads is needed.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    out += [(path, p.number, p.text, p.images, p.ocr, None) for p in reader.pages(path, content or b"")]
                except Exception as e:
                    out.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()))], ["path", "page_no", "text", "n_images", "ocr", "error"])

    return files.select("path", F.col("content")).mapInArrow(rows, _ROWS)
