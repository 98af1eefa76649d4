"""Where a field's value comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_of(page_range: Column, page: Column) -> Column:
    """The first page of a chunk's range, else its page."""
    return F.coalesce(F.try_element_at(page_range, F.lit(1)), page)


def checked_confidence(confidence: Column) -> Column:
    """The confidence, or an error if it is outside 0 to 1."""
    return F.when(confidence.isNull() | confidence.between(0, 1), confidence).otherwise(F.raise_error(F.concat(F.lit("confidence must lie in 0 to 1, not "), confidence.cast("string"))).cast("double"))


def citation(content: Column, value: Column, around: int = 50) -> Column:
    """The first place of a value in a text, in any case, with so many characters on each side; null if there is none.

    Dots stand where the text goes on, and white space becomes one blank.
    """
    at = F.position(F.lower(value), F.lower(content))
    begin = F.greatest(F.lit(1), at - around)
    end = F.least(F.length(content), at - 1 + F.length(value) + around)
    part = F.concat(F.when(begin > 1, "...").otherwise(""), F.substring(content, begin, end - begin + 1), F.when(end < F.length(content), "...").otherwise(""))
    return F.when((at > 0) & (value != ""), F.trim(F.regexp_replace(part, r"(?U)\s+", " ")))


def track(values: DataFrame, chunks: DataFrame, on: list[str], around: int = 50, method: str = "text") -> DataFrame:
    """(on, field, value, page, source_file, confidence, citation, method) of each value and the chunk it was found in."""
    found = values.join(chunks, on)
    return found.select(*on, "field", "value", page_of(F.col("page_range"), F.col("page")).alias("page"), "source_file", checked_confidence(F.coalesce("confidence", F.lit(1.0))).alias("confidence"), citation(F.col("content"), F.col("value"), around).alias("citation"), F.lit(method).alias("method"))


def to_json(rows: DataFrame, doc: str, field: str = "field") -> DataFrame:
    """(doc, provenance): the sources of a document's fields as one JSON object by field."""
    rest = [c for c in rows.columns if c not in (doc, field)]
    return rows.groupBy(doc).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(field), F.struct(*rest)))))).alias("provenance"))


def from_json(df: DataFrame, doc: str, kind: str, column: str = "provenance", field: str = "field") -> DataFrame:
    """The rows that ``to_json`` made; kind: their columns besides doc and field, as DDL."""
    return df.select(doc, F.explode(F.from_json(column, f"map<string, struct<{kind}>>")).alias(field, "_p")).select(doc, field, "_p.*")


def of_field(rows: DataFrame, name: str, field: str = "field") -> DataFrame:
    """The sources of one field, or of a nested one by its dotted path."""
    return rows.where(F.col(field) == name)


def merge_provenance(df: DataFrame, keys: list[str], order: str, strategy: str = "highest_confidence", confidence: str = "confidence") -> DataFrame:
    """One row for each key: of most confidence (the earlier of equals), the first or the last by ``order``."""
    row = F.struct(*[c for c in df.columns if c not in keys])
    picks = {"first": lambda: F.min_by(row, order), "last": lambda: F.max_by(row, order), "highest_confidence": lambda: F.max_by(row, F.struct(F.col(confidence), -F.col(order)))}
    if strategy not in picks:
        raise ValueError(f"unknown strategy {strategy!r}; choose one of {', '.join(picks)}")
    return df.groupBy(*keys).agg(picks[strategy]().alias("_row")).select(*keys, "_row.*")
