"""How files, pages and texts are spread over chunks. Remainders are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.functions.mime import mime_of, wrap_text
from fieldspark.operators.pages import document_text
from fieldspark.operators.segment import pack


def spread(df: DataFrame, group: str, order: str, n: Column | int, compat: bool = False) -> DataFrame:
    """df with chunk_id: its rows in n runs of nearly equal length, group by group.

    compat: runs of floor(rows / n) rows, and rows beyond the last of them are dropped.
    """
    by = W.partitionBy(group)
    n = F.lit(n) if isinstance(n, int) else n
    ranked = df.withColumns({"_at": F.row_number().over(by.orderBy(order)) - 1, "_rows": F.count("*").over(by), "_n": F.greatest(n.cast("long"), F.lit(1))})
    if compat:
        each = F.greatest(F.floor(F.col("_rows") / F.col("_n")), F.lit(1))
        out = ranked.withColumn("chunk_id", F.floor(F.col("_at") / each).cast("int")).where(F.col("chunk_id") < F.col("_n"))
    else:
        short, longer = F.floor(F.col("_rows") / F.col("_n")), F.col("_rows") % F.col("_n")
        head = longer * (short + 1)
        rest = longer + F.floor((F.col("_at") - head) / F.greatest(short, F.lit(1)))
        out = ranked.withColumn("chunk_id", F.when(F.col("_at") < head, F.floor(F.col("_at") / (short + 1))).otherwise(rest).cast("int"))
    return out.drop("_at", "_rows", "_n")


def page_ranges(pages: DataFrame, doc: str, page: str, n: Column | int, compat: bool = False) -> DataFrame:
    """(doc, chunk_id, page_lo, page_hi, n_pages): the pages of each document in n ranges."""
    return spread(pages, doc, page, n, compat).groupBy(doc, "chunk_id").agg(F.min(page).alias("page_lo"), F.max(page).alias("page_hi"), F.count("*").alias("n_pages"))


def chunk_size(text: Column, n: Column | int, least: int = 5000) -> Column:
    """Characters of a chunk if a text is to be cut in about n."""
    return F.greatest(F.lit(least), F.floor(F.length(text) / n)).cast("int")


def strategy(kind: Column, pdf_type: Column) -> Column:
    """How a file is cut: by sentences where it has a text layer, else by pages."""
    return F.when((kind == "text") | ((kind == "pdf") & (pdf_type == "text_rich")), "semantic").otherwise("page_based")


def chunk_documents(files: DataFrame, pages: DataFrame, group: str, n: int, how: str = "auto", least: int = 5000) -> DataFrame:
    """(group, chunk_id, chunk_type, text, page_lo, page_hi, n_files): each group of files in about n chunks.

    files: (group, file_ord, path, kind, pdf_type, text); pages: (group, file_ord, page_no, text) of those with pages. Several
    files are spread as they are. One file is cut by sentences or by pages: by ``strategy`` if ``how`` is auto, by
    pages only what is a PDF if it is hybrid, always so if it is semantic or page_based, and not at all if it is
    none. What should be cut by sentences but has no text is cut by pages. Groups meet their pages in one shuffle.
    """
    if how not in ("auto", "none", "semantic", "page_based", "hybrid"):
        raise ValueError(f"unknown way to cut {how!r}; choose auto, none, semantic, page_based or hybrid")
    here = files.withColumn("_files", F.count("*").over(W.partitionBy(group)))
    ways = {"auto": strategy(F.col("kind"), F.col("pdf_type")), "hybrid": F.when(F.col("kind") == "pdf", "page_based").otherwise("semantic")}
    way = ways.get(how, F.lit(how))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S")
    here = here.withColumn("_way", F.when(F.col("_files") > 1, "multi_file").when((way == "semantic") & blank, "page_based").otherwise(way))
    nothing = F.lit(None).cast("int")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", wrap_text(F.col("path"), F.lit(mime_of("txt")), F.coalesce(F.col("text"), F.lit(""))).alias("b")))), lambda x: x["b"]), "\n\n")
    many = spread(here.where("_way = 'multi_file'"), group, "file_ord", n).groupBy(group, "chunk_id").agg(body.alias("text"), F.count("*").cast("int").alias("n_files"))
    many = many.select(group, "chunk_id", F.lit("multi_file").alias("chunk_type"), "text", nothing.alias("page_lo"), nothing.alias("page_hi"), "n_files")
    whole = here.where("_way = 'none'").select(group, F.lit(0).alias("chunk_id"), F.lit("none").alias("chunk_type"), "text", nothing.alias("page_lo"), nothing.alias("page_hi"), F.lit(1).alias("n_files"))
    cut = semantic(here.where("_way = 'semantic'").select(group, "text", F.lit(n).alias("n_chunks")), [group], least=least)
    cut = cut.select(group, "chunk_id", F.lit("semantic").alias("chunk_type"), "text", nothing.alias("page_lo"), nothing.alias("page_hi"), F.lit(1).alias("n_files"))
    paged = spread(pages.join(here.where("_way = 'page_based'").select(group, "file_ord"), [group, "file_ord"], "left_semi"), group, "page_no", n)
    ranged = paged.groupBy(group, "chunk_id").agg(F.min("page_no").alias("page_lo"), F.max("page_no").alias("page_hi"))
    texts = document_text(paged.withColumn("_chunk", F.struct(group, "chunk_id")), "_chunk").select(F.col(f"_chunk.{group}").alias(group), "_chunk.chunk_id", "text")
    by_page = ranged.join(texts, [group, "chunk_id"], "left").select(group, "chunk_id", F.lit("page_based").alias("chunk_type"), F.coalesce("text", F.lit("")).alias("text"), "page_lo", "page_hi", F.lit(1).alias("n_files"))
    return many.unionByName(whole).unionByName(cut).unionByName(by_page)


def semantic(df: DataFrame, keys: list[str], text: str = "text", n: str = "n_chunks", least: int = 5000, lossy: bool = False) -> DataFrame:
    """Each text in about n chunks that end with a sentence."""
    return pack(df.withColumn("_size", chunk_size(F.col(text), F.col(n), least)), keys, text, "_size", newlines=True, lossy=lossy)
