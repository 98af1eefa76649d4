"""Pages of documents as rows: what kind of PDF they make, their text, and ranges of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_PAGE_CHARS, SAMPLE, GOOD_QUALITY = 100, 10, 0.7
#: What stands for a page whose image could not be read, or holds no text.
OCR_FAILED, NO_TEXT = "[OCR failed]", "[No text extracted]"


def sample_pages(total: Column, k: int = SAMPLE) -> Column:
    """array<int>: the pages (from 0) that are looked at: all, or k at even distances."""
    n = F.greatest(total, F.lit(0))
    few = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int")))
    some = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * n / F.lit(k)).cast("int"))
    return F.when(n <= k, few).otherwise(some)


def text_quality(text_ratio: Column, avg_chars: Column) -> Column:
    return text_ratio * 0.7 + F.least(F.lit(1.0), avg_chars / 500) * 0.3


def pdf_type(pages: Column, text_ratio: Column, image_ratio: Column) -> Column:
    rich = F.when(image_ratio > 0.3, "image_heavy").otherwise("text_rich")
    return F.when(pages == 0, "unknown").when(text_ratio > 0.8, rich).when(1 - text_ratio > 0.8, "scanned").otherwise("hybrid")


def method(kind: Column, quality: Column, pages: Column, vision_pages: int = 20) -> Column:
    """struct<method, confidence>: how to read a PDF of a kind."""
    use = lambda name, c: F.struct(F.lit(name).alias("method"), F.lit(c).alias("confidence"))
    heavy = F.when(pages <= vision_pages, use("vision", 0.85)).otherwise(use("hybrid", 0.75))
    rich = F.when(quality >= GOOD_QUALITY, use("text_layer", 0.95)).otherwise(use("text_layer", 0.75))
    return F.when(kind == "text_rich", rich).when(kind == "scanned", use("ocr", 0.9)).when(kind == "hybrid", use("hybrid", 0.8)).when(kind == "image_heavy", heavy).otherwise(use("text_layer", 0.5))


def analyze(pages: DataFrame, doc: str, page_no: str = "page_no", text: str = "text", images: str = "n_images", sample: int = SAMPLE) -> DataFrame:
    """One row for each document: pages, share of text and image pages in the sample, quality, type, method, confidence."""
    totals = pages.groupBy(doc).agg(F.count("*").cast("int").alias("n_pages"))
    # only the lengths of the pages are shuffled, not their texts
    slim = pages.select(doc, page_no, F.length(F.trim(F.coalesce(F.col(text), F.lit("")))).alias("_chars"), images)
    looked = slim.join(totals, doc).where(F.array_contains(sample_pages(F.col("n_pages"), sample), (F.col(page_no) - 1).cast("int")))
    chars = F.col("_chars")
    out = looked.groupBy(doc).agg(F.first("n_pages").alias("n_pages"), F.avg(F.when(chars >= TEXT_PAGE_CHARS, 1.0).otherwise(0.0)).alias("text_ratio"), F.avg(F.when(F.col(images) > 0, 1.0).otherwise(0.0)).alias("image_ratio"), F.avg(chars).alias("avg_chars"))
    out = out.withColumn("quality", text_quality(F.col("text_ratio"), F.col("avg_chars"))).withColumn("pdf_type", pdf_type(F.col("n_pages"), F.col("text_ratio"), F.col("image_ratio")))
    return out.withColumn("_m", method(F.col("pdf_type"), F.col("quality"), F.col("n_pages"))).select(*out.columns, "_m.method", "_m.confidence")


def page_range(pages: DataFrame, low: int, high: int, page_no: str = "page_no") -> DataFrame:
    """Pages low to high, both included; a filter that reaches the scan."""
    if low < 1 or high < low:
        raise ValueError(f"no such range of pages: {low} to {high}")
    return pages.where(F.col(page_no).between(low, high))


def document_text(pages: DataFrame, doc: str, page_no: str = "page_no", text: str = "text", ocr: str | None = None) -> DataFrame:
    """(doc, text, n_pages): pages that aren't blank, in order, each after its mark.

    ocr: column of text read from the page's image, taken where the text layer has fewer than 100 characters. Such a
    page isn't left out if that gives nothing: a mark says that reading failed (null) or that there is no text.
    """
    layer = F.coalesce(F.col(text), F.lit(""))
    if ocr:
        thin = F.length(F.trim(layer)) < TEXT_PAGE_CHARS
        body, mark = F.when(~thin, F.trim(layer)).when(F.col(ocr).isNull(), OCR_FAILED).when(F.col(ocr).rlike(r"(?U)\S"), F.col(ocr)).otherwise(NO_TEXT), F.when(thin, " (OCR) ---\n").otherwise(" ---\n")
    else:
        body, mark = layer, F.lit(" ---\n")
    rows = pages.select(doc, F.col(page_no).alias("p"), body.alias("b"), mark.alias("m")).where(F.col("b").rlike(r"(?U)\S"))
    whole = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("p", "b", "m"))).alias("ps"))
    parts = F.transform("ps", lambda x: F.concat(F.lit("--- PAGE "), x["p"].cast("string"), x["m"], x["b"]))
    return whole.select(doc, F.array_join(parts, "\n\n").alias("text"), F.size("ps").alias("n_pages"))


def recommended_text(pages: DataFrame, doc: str, page_no: str = "page_no", text: str = "text", images: str = "n_images", ocr: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc, method, text, n_pages): each document's text by the method that ``analyze`` recommends for it.

    The text layer alone; or, where ``ocr`` names a column, the images of thin pages (hybrid) or of all pages (ocr,
    vision). Without that column everything is read from the text layer. One join on the document, by its few columns.
    """
    found = analyze(pages, doc, page_no, text, images, sample).select(doc, "method")
    if ocr is None:
        return found.join(document_text(pages, doc, page_no, text), doc, "left").select(doc, "method", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"))
    by = pages.join(found, doc)
    layer = document_text(by.where("method = 'text_layer'"), doc, page_no, text)
    seen = by.where("method <> 'text_layer'").withColumn("_layer", F.when(F.col("method") == "hybrid", F.col(text)))
    both = layer.unionByName(document_text(seen, doc, page_no, "_layer", ocr))
    return found.join(both, doc, "left").select(doc, "method", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


def complexity(files: DataFrame, group: str, kind: str = "kind", size: str = "size", pages: str = "n_pages") -> DataFrame:
    """(group, n_files, total_pages, est_tokens, kinds): how much there is to read in each group of files."""
    n = F.when(F.col(kind) == "pdf", F.coalesce(F.col(pages), F.greatest(F.lit(1).cast("long"), F.floor(F.col(size) / 50_000)))).when(F.col(kind) == "image", 1).otherwise(0)
    tokens = F.when(F.col(kind) == "pdf", n * 2500).when(F.col(kind) == "image", 1000).otherwise(F.floor(F.col(size) / 4))
    kinds = F.when(F.col(kind).isin("pdf", "image"), F.col(kind)).otherwise("other")
    return files.groupBy(group).agg(F.count("*").alias("n_files"), F.sum(n).alias("total_pages"), F.sum(tokens).alias("est_tokens"), F.array_join(F.array_sort(F.collect_set(kinds)), ",").alias("kinds"))
