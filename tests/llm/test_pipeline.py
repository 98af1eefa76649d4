"""The corpus pipeline against plain Python, and the registered queries against DuckDB."""

from __future__ import annotations

import brute
import corpus_pipeline
import numpy as np
import pytest
from comparing import duck_rows, spark_rows

import __spark_entry__ as entry
from fieldspark.llm import bpe, decontaminate, quality, registry, simhash
from fieldspark.llm.shared import read


def test_pipeline_equals_brute_force(spark, corpus, sf):
    docs = brute.quality(corpus, quality.MIN_DOCS, quality.MIN_SHARE, quality.MIN_KEPT)
    docs = brute.line_dedup([*docs.items()])
    ids = sorted(docs)
    prints = simhash.fingerprints([docs[d].encode() for d in ids]).tolist()
    root = brute.roots(len(ids), brute.near_pairs(prints, simhash.MAX_DISTANCE))
    docs = {d: docs[d] for i, d in enumerate(ids) if root[i] == i}
    items = [decontaminate.normalised(r.text) for r in read(spark, sf, "benchmark").collect()]
    matcher = decontaminate.Matcher([(i, t) for i, t in enumerate(items) if t], decontaminate.ERROR_RATE)
    docs = {d: t for d, t in docs.items() if not matcher.find(decontaminate.normalised(t))}
    coder = bpe.encoder(bpe.VOCABULARY)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(docs) and 0 < len(docs) < len(corpus)
    for d, r in got.items():
        counts, ids_, offsets = coder.encode([docs[d].encode()])
        assert (r.tokens, r.offsets, r.n_tokens) == (ids_.tolist(), offsets.tolist(), int(counts[0]))


def _folder(tmp_path, docs, sf, spark):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    read(spark, sf, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_on_awkward_rows(spark, awkward, sf, tmp_path):
    """Null, empty and blank texts end in the first stage; of equal texts one id stays, as often as it came; the rest passes whole."""
    rows = corpus_pipeline.run(spark, _folder(tmp_path, awkward, sf, spark)).collect()
    # 4 (twice) and 5 repeat the null id's text, which is one line of over 300 characters or near enough for SimHash
    assert sorted((r.doc_id or 0, r.lossless) for r in rows) == [(0, True), (4, True), (6, True), (7, True), (8, True), (9, True)]
    by = {r.doc_id: r for r in rows}
    coder = bpe.encoder(bpe.VOCABULARY)
    text = lambda d: coder.decode(np.array(by[d].tokens)).tobytes().decode()
    assert text(8) == "one\ntwo\nthree\nfour" and text(9) == "zero\nfive" and text(4) == "another text of the same id"
    assert len(by[6].tokens) > 100_000 and set(rows[0].asDict()) == {"doc_id", "lang", "source", "n_tokens", "tokens", "offsets", "n_bytes", "lossless"}


def test_pipeline_keeps_repeated_rows_together(spark, sf, tmp_path):
    docs = [(1, "one text that stays as it is", "en", "a", 1)] * 3 + [(2, "quite another one, with words of its own", "en", "a", 1)]
    rows = corpus_pipeline.run(spark, _folder(tmp_path, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), sf, spark)).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 1, 2]


def test_pipeline_loses_no_near_copy(spark, sf, tmp_path):
    docs = brute.edited_copies(200, 4)
    prints = simhash.fingerprints([t.encode() for _, t in docs]).tolist()
    root = brute.roots(len(docs), brute.near_pairs(prints, simhash.MAX_DISTANCE))
    rows = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.run(spark, _folder(tmp_path, rows, sf, spark)).collect())
    assert got == [d for d, _ in docs if root[d] == d] and 200 < len(got) < 220


def test_pipeline_of_nothing(spark, empty, sf, tmp_path):
    assert corpus_pipeline.run(spark, _folder(tmp_path, empty, sf, spark)).count() == 0


def test_stages_keep_the_columns(spark, sf):
    docs = read(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "benchmark_decontamination", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.fieldNames() == docs.schema.fieldNames()


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_oracles(spark, sf, name):
    assert spark_rows(registry.queries()[name](spark, sf)) == duck_rows(registry.oracle_sql()[name], sf)


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
