"""What a result lacks, when to ask again, and for which pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.functions.emptiness import empty_placeholder
from fieldspark.functions.paths import bound, value_at

HINTS = (r"(?i)\bpages?\s+(\d+)\s*-\s*\d+", r"(?i)\bpages\s+\d+\s*-\s*(\d+)", r"(?i)\bpage\s+(\d+)")
MARKER = r"---\s*PAGE\s+(\d+)\s*(?:\(OCR\)\s*)?---"


def missing_fields(record: Column, leaves: list[str], countable: list[str] | None = None, threshold: float = 0.3) -> Column:
    """array<string>: the empty leaves of a VARIANT, in schema order, if more than ``threshold`` of all are. No join, no shuffle.

    countable: all leaves, if more count than can be missing.
    """
    none = F.array().cast("array<string>")
    if not leaves:
        return none
    rows = bound(record, lambda r: F.array(*[F.struct(F.lit(p).alias("path"), value_at(r, p).alias("value")) for p in leaves]))  # each looked up once
    gone = F.transform(F.filter(rows, lambda x: empty_placeholder(x["value"])), lambda x: x["path"])
    return bound(gone, lambda g: F.when(F.size(g) / F.lit(len(countable or leaves)) > threshold, g).otherwise(none))


def array_instances(is_array: Column, pages: Column) -> Column:
    each = F.when(pages < 5, 5).when(pages < 50, 10).otherwise(15)
    return F.when(is_array, F.greatest(F.lit(1), pages * each)).otherwise(0)


def adaptive_threshold(fields: Column, depth: Column, is_array: Column, pages: Column) -> Column:
    """The missing rate above which a second pass pays: 0.3, moved by the schema's and the documents' size, within 0.1 to 0.6."""
    t = F.lit(0.3) + F.when(fields < 10, -0.1).when(fields > 50, 0.1).otherwise(0.0) + F.when(depth > 3, 0.05).otherwise(0.0)
    t = t + F.when(pages > 50, 0.05).when(pages < 5, -0.05).otherwise(0.0) + F.when(is_array & (array_instances(is_array, pages) > 100), 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(0.6), F.greatest(F.lit(0.1), t)), 4)


def complexity(fields: Column, depth: Column) -> Column:
    return (F.least(fields / 100, F.lit(1.0)) + F.least(depth / 10, F.lit(1.0))) / 2


def should_retry(complete: Column, confidence: Column, threshold: float = 0.7) -> Column:
    return ~F.coalesce(complete, F.lit(True)) | (F.coalesce(confidence, F.lit(1.0)) < threshold)


def productive_chunks(items: DataFrame, doc: str, chunk: str = "chunk_id") -> DataFrame:
    """(doc, chunk, n_items): the chunks that gave items, one row of ``items`` for each item."""
    return items.groupBy(doc, chunk).agg(F.count("*").alias("n_items"))


def page_markers(text: Column) -> Column:
    """array<int>: the pages whose marks stand in a text, those of OCR too."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), lambda x: x.cast("int")))


def page_hints(prompt: Column) -> Column:
    """array<int>: pages that a prompt names, ends of ranges included, in ascending order."""
    found = F.flatten(F.array(*[F.regexp_extract_all(prompt, F.lit(p), F.lit(1)) for p in HINTS]))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def focus_range(chunks: DataFrame, doc: str, hints: DataFrame | None = None, wide: int = 150, broad: int = 100) -> DataFrame:
    """(doc, page_lo, page_hi, strategy): the pages to read again.

    chunks: (doc, chunk_id, page_lo, page_hi, productive), one row for each chunk; hints: (doc, hint_lo,
    hint_hi). In this order: the hints' pages and 5 around; productive chunks and their neighbours, if that
    is wider than ``wide`` the productive ones alone, if still above ``broad`` the largest; the smallest
    chunk of 10 to 50 pages; of more than 50 pages the middle third; else all pages and 2 around. All
    within the document's pages. Neighbours come by one window over a document's few chunks.
    """
    by = W.partitionBy(doc).orderBy("chunk_id")
    size = F.col("page_hi") - F.col("page_lo") + 1
    good = F.coalesce(F.col("productive"), F.lit(False))
    near = good | F.coalesce(F.lag(good).over(by), F.lit(False)) | F.coalesce(F.lead(good).over(by), F.lit(False))
    marked = chunks.withColumns({"_size": size, "_good": good, "_near": near})
    mid = F.col("_size").between(10, 50)
    s = marked.groupBy(doc).agg(
        F.min("page_lo").alias("lo"), F.max("page_hi").alias("hi"), F.sum("_size").alias("n"),
        F.min(F.when(F.col("_near"), F.col("page_lo"))).alias("near_lo"), F.max(F.when(F.col("_near"), F.col("page_hi"))).alias("near_hi"),
        F.min(F.when(F.col("_good"), F.col("page_lo"))).alias("good_lo"), F.max(F.when(F.col("_good"), F.col("page_hi"))).alias("good_hi"),
        F.max_by(F.struct("page_lo", "page_hi"), F.when(F.col("_good"), F.struct("_size", -F.col("chunk_id")))).alias("large"),
        F.min_by(F.struct("page_lo", "page_hi"), F.when(mid, F.struct("_size", "chunk_id"))).alias("small"),
    )
    if hints is not None:
        s = s.join(hints.select(doc, "hint_lo", "hint_hi"), doc, "left")
    else:
        s = s.withColumns({"hint_lo": F.lit(None).cast("int"), "hint_hi": F.lit(None).cast("int")})
    third = F.floor(F.col("n") / 3).cast("int")
    pick = lambda name, lo, hi: F.struct(F.lit(name).alias("strategy"), lo.cast("int").alias("a"), hi.cast("int").alias("b"))
    c = F.col
    some = F.coalesce(
        F.when(c("hint_lo").isNotNull(), pick("hints", c("hint_lo") - 5, c("hint_hi") + 5)),
        F.when(c("near_hi") - c("near_lo") + 1 <= wide, pick("neighbours", c("near_lo"), c("near_hi"))),
        F.when(c("good_hi") - c("good_lo") + 1 <= broad, pick("productive", c("good_lo"), c("good_hi"))),
        F.when(c("large").isNotNull(), pick("largest", c("large.page_lo"), c("large.page_hi"))),
        F.when(c("small").isNotNull(), pick("smallest", c("small.page_lo"), c("small.page_hi"))),
        F.when(c("n") > 50, pick("middle", c("lo") + third, c("lo") + 2 * third)),
        pick("all", c("lo") - 2, c("hi") + 2),
    )
    out = s.withColumn("_f", some)
    return out.select(doc, F.greatest(c("_f.a"), c("lo")).alias("page_lo"), F.least(c("_f.b"), c("hi")).alias("page_hi"), c("_f.strategy").alias("strategy"))
