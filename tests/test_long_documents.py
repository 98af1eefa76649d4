"""Queries against their SQL where documents are longer than a call takes, so that the engine would cut them."""

from __future__ import annotations

import pytest
from comparing import duck_rows, spark_rows

from fieldspark import catalog

FILL = "Some words of no matter at all, and then some more. " * 1400
TEXTS = [
    FILL + "Mail a@b.example. " + FILL + "Host 10.0.0.1 here. ",
    FILL + FILL + "Host 10.0.0.1, mail a@b.example. It is licensed under the MIT License. ",
    "Mail c@b.example. " + FILL + FILL + "Mail d@b.example. ",
    FILL + FILL,
    "Mail a@b.example. ",
    " ",
]


@pytest.mark.parametrize("name", ["field_chunking_auto", "multipass_failing", "provenance_track", "provenance_json", "multipass"])
def test_long_documents(spark, tmp_path, name):
    spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/made")
    (file,) = (tmp_path / "made").glob("*.parquet")
    file.rename(tmp_path / "documents.parquet")
    assert spark_rows(catalog.queries()[name](spark, str(tmp_path))) == duck_rows(catalog.oracle_sql()[name], str(tmp_path))
