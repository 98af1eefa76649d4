from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.operators import completeness, pages
from fieldspark.sources.page_readers import FormFeedReader, read_pages


def test_readers_and_text(spark):
    files = spark.createDataFrame([("a", bytearray(b"one\f\f" + b"t" * 120)), ("b", None)], "path string, content binary")
    rows = read_pages(files, FormFeedReader())
    assert rows.where("path = 'a'").count() == 3
    text = {r.path: r.text for r in pages.document_text(rows, "path").collect()}
    assert text == {"a": "--- PAGE 1 ---\none\n\n--- PAGE 3 ---\n" + "t" * 120}
    seen = pages.document_text(rows.withColumn("ocr", F.lit("scan")), "path", ocr="ocr").where("path = 'a'").first()
    assert seen.text.startswith("--- PAGE 1 (OCR) ---\nscan") and seen.n_pages == 3

    class Broken:
        def pages(self, path, content):
            raise OSError("torn")

    assert {r.error for r in read_pages(files, Broken()).collect()} == {"OSError: torn"}


def test_classification(spark):
    got = spark.range(1).select(*[pages.pdf_type(F.lit(n), F.lit(t), F.lit(i)).alias(f"c{k}") for k, (n, t, i) in enumerate([(0, 0.0, 0.0), (5, 0.9, 0.1), (5, 0.9, 0.5), (5, 0.1, 0.0), (5, 0.5, 0.0)])]).first()
    assert [*got] == ["unknown", "text_rich", "image_heavy", "scanned", "hybrid"]
    s = spark.range(1).select(pages.sample_pages(F.lit(4), 10).alias("a"), pages.sample_pages(F.lit(25), 5).alias("b"), pages.sample_pages(F.lit(0), 5).alias("c")).first()
    assert (s.a, s.b, s.c) == ([0, 1, 2, 3], [0, 5, 10, 15, 20], [])


def test_thresholds(spark):
    cases = [(5, 1, False, 2, 0.15), (60, 4, False, 100, 0.5), (25, 2, False, 20, 0.3), (10, 2, True, 120, 0.45), (100, 5, True, 200, 0.6)]
    for fields, depth, array, n, want in cases:
        got = spark.range(1).select(completeness.adaptive_threshold(F.lit(fields), F.lit(depth), F.lit(array), F.lit(n)).alias("t"), completeness.array_instances(F.lit(array), F.lit(n)).alias("i")).first()
        assert got.t == want and got.i == (n * 15 if array else 0)


def test_hints_stay_within_the_document(spark):
    chunks = spark.createDataFrame([(1, 0, 1, 30, False)], "doc long, chunk_id long, page_lo long, page_hi long, productive boolean")
    hints = spark.createDataFrame([(1, 3, 28)], "doc long, hint_lo int, hint_hi int")
    assert [*completeness.focus_range(chunks, "doc", hints).first()] == [1, 1, 30, "hints"]
    assert [*completeness.focus_range(chunks, "doc").first()] == [1, 1, 30, "smallest"]
