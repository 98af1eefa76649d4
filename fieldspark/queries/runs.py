"""Queries that run extractors over all documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.operators import mapper, merge, segment
from fieldspark.plans.config import Config
from fieldspark.plans.engine import Engine, call, kept, record, top_fields
from fieldspark.plans.extractors import RULES, CallableExtractor, RuleExtractor
from fieldspark.queries.segments import BUFFER, CHUNKS_PACK
from fieldspark.session import table

_TEXT = {"type": "string"}
_LIST = {"type": "array", "items": _TEXT}
CONTACTS = {"type": "object", "properties": {"emails": _LIST, "ipv4s": _LIST, "license": _TEXT}}
FLAT = {"type": "object", "properties": {"email": _TEXT, "ipv4": _TEXT, "license": _TEXT}}
ITEMS = {"type": "array", "items": {"type": "object", "properties": {"name": _TEXT}}}


def _sql(name: str) -> str:
    return "'" + RULES[name].replace("'", "''") + "'"


_E, _I, _L = _sql("email"), _sql("ipv4"), _sql("license")
_ONE = f"nullif(regexp_extract(text, {_E}), '') AS email, nullif(regexp_extract(text, {_I}), '') AS ipv4, nullif(regexp_extract(text, {_L}), '') AS license"


def _flat(data: DataFrame, key: str = "doc_id") -> DataFrame:
    return data.select(key, *[F.get_json_object("data", f"$.{c}").alias(c) for c in FLAT["properties"]])


def extract_flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of whole sentences, an extraction for each, merged to one record for each document."""
    chunks = segment.pack(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], size=BUFFER)
    calls = kept(call(chunks, ["doc_id", "chunk_id"], RuleExtractor(), CONTACTS))
    merged = merge.merge_chunks(top_fields(calls, ["doc_id", "chunk_id"], CONTACTS), ["doc_id", "path"], "chunk_id")
    data = record(merged, ["doc_id"])
    counts = calls.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    length = lambda c: F.coalesce(F.json_array_length(F.get_json_object("data", f"$.{c}")), F.lit(0))
    return counts.join(data, "doc_id", "left").select("doc_id", "n_chunks", length("emails").alias("n_emails"), length("ipv4s").alias("n_ips"), F.get_json_object("data", "$.license").alias("license"), F.get_json_object("data", "$.emails[0]").alias("first_email"))


#: No match crosses the end of a sentence, so those of the whole text are those of its chunks.
EXTRACT_FLAGSHIP = f"""
WITH k AS (SELECT doc_id, count(*) AS n_chunks FROM ({CHUNKS_PACK}) GROUP BY doc_id),
d AS (SELECT doc_id, regexp_extract_all(text, {_E}) AS e, regexp_extract_all(text, {_I}) AS i, nullif(regexp_extract(text, {_L}), '') AS license FROM documents)
SELECT doc_id, n_chunks, len(e)::INT AS n_emails, len(i)::INT AS n_ips, license, e[1] AS first_email FROM k JOIN d USING (doc_id)
"""


def _risky(text: str) -> dict:
    if "@" in text:
        raise ValueError("an address")
    return {"words": len(text.split(" "))}


def map_with_errors(spark: SparkSession, sf: str) -> DataFrame:
    out = mapper.map_with_errors(table(spark, sf, "documents"), ["doc_id"], "text", _risky)
    return out.select("doc_id", F.get_json_object("result", "$.words").cast("int").alias("words"), F.col("error.type").alias("error_type"), F.col("error.message").alias("error_message"))


MAP_WITH_ERRORS = "SELECT doc_id, CASE WHEN NOT contains(text, '@') THEN len(string_split(text, ' '))::INT END AS words, CASE WHEN contains(text, '@') THEN 'ValueError' END AS error_type, CASE WHEN contains(text, '@') THEN 'an address' END AS error_message FROM documents"


def map_error_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return mapper.counts(mapper.map_with_errors(docs, ["source"], "text", _risky), ["source"])


MAP_ERROR_COUNTS = "SELECT source, count(*) AS total, count(*) FILTER (WHERE NOT contains(text, '@')) AS succeeded, count(*) FILTER (WHERE contains(text, '@')) AS failed FROM documents GROUP BY source"


def _hesitant(text: str, schema: dict, prompt: str) -> dict:
    """Finds addresses only, unless it is told that something is missing."""
    names = [*schema["properties"]] if "Still missing" in prompt else ["email"]
    return {k: m.group() if k in names and (m := re.search(RULES[k], text)) else None for k in schema["properties"]}


def adaptive_two_pass(spark: SparkSession, sf: str) -> DataFrame:
    """A second pass for the documents that lack more than 0.7 of the fields."""
    engine = Engine(spark, CallableExtractor(_hesitant), Config(missing_threshold=0.7, max_workers=8, max_concurrency=1))
    return _flat(engine.extract(table(spark, sf, "documents"), FLAT).data)


_COMMON = f"WITH d AS (SELECT doc_id, {_ONE} FROM documents WHERE regexp_matches(text, '\\S'))"
ADAPTIVE_TWO_PASS = f"{_COMMON} SELECT doc_id, email, CASE WHEN email IS NULL THEN ipv4 END AS ipv4, CASE WHEN email IS NULL THEN license END AS license FROM d"


def multipass(spark: SparkSession, sf: str) -> DataFrame:
    engine = Engine(spark, config=Config(multipass=True, passes=3, strategy="majority"))
    return _flat(engine.extract(table(spark, sf, "documents"), FLAT).data)


MULTIPASS = f"{_COMMON} SELECT * FROM d"


def field_chunking(spark: SparkSession, sf: str) -> DataFrame:
    """Contacts and the rest in calls of their own."""
    return _flat(Engine(spark).extract_by_group(table(spark, sf, "documents"), FLAT).data)


FIELD_CHUNKING = MULTIPASS


def batch_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Five documents in a row make a group of files."""
    files = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 5).alias("group_id"), F.col("doc_id").alias("file_ord"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    data = Engine(spark, config=Config(adaptive=False)).batch(files, CONTACTS).data
    length = lambda c: F.coalesce(F.json_array_length(F.get_json_object("data", f"$.{c}")), F.lit(0))
    return data.select("group_id", "group_key", length("emails").alias("n_emails"), length("ipv4s").alias("n_ips"))


BATCH_GROUPS = f"""
SELECT doc_id // 5 AS group_id, 'd' || min(doc_id) || '.txt' AS group_key, sum(len(regexp_extract_all(text, {_E})))::INT AS n_emails, sum(len(regexp_extract_all(text, {_I})))::INT AS n_ips
FROM documents GROUP BY 1
"""


def _addresses(text: str, schema: dict, prompt: str) -> dict:
    return {"items": [{"name": m.group()} for m in re.finditer(RULES["ipv4"], text)] + [{"name": m.group().upper()} for m in re.finditer(RULES["email"], text)]}


def extract_items(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of a document as items of a root array, without repeats."""
    engine = Engine(spark, CallableExtractor(_addresses), Config(max_workers=8, max_concurrency=1))
    data = engine.extract(table(spark, sf, "documents"), ITEMS).data
    return data.select("doc_id", F.lower(F.get_json_object("data", "$.name")).alias("name"))


EXTRACT_ITEMS = f"SELECT DISTINCT doc_id, lower(unnest(list_concat(regexp_extract_all(text, {_I}), regexp_extract_all(text, {_E})))) AS name FROM documents"

_NAMED = (extract_flagship, map_with_errors, map_error_counts, adaptive_two_pass, multipass, field_chunking, batch_groups, extract_items)
QUERIES = {f.__name__: f for f in _NAMED}
SQL = {k: globals()[k.upper()] for k in QUERIES}
