"""Queries over schemas and nested records: splitting, focusing, sizes, pruning, items and reports, prompts, costs.

The schemas are made from the tables region and nation, which have a fixed size whatever the scale.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions.paths import items_of, report_of, successful_leaves
from fieldspark.operators import completeness, pages, provenance, segment, usage
from fieldspark.plans import prompts
from fieldspark.plans import schema as S
from fieldspark.plans.extractors import RULES
from fieldspark.plans.validate import pruned
from fieldspark.queries.merges import _PAGE, PDF_CLASSIFY, _pages
from fieldspark.queries.schemas import _CUSTOMER_SQL, CUSTOMER, _customers
from fieldspark.queries.segments import _pack_sql
from fieldspark.session import table

_TEXT = {"type": "string"}


def _atlas(spark: SparkSession, sf: str) -> tuple[dict, dict, list]:
    """A flat schema of all nations, a nested one of nations by region, and the rows (region, nation, key)."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = [tuple(x) for x in n.join(r, n.n_regionkey == r.r_regionkey).orderBy("n_nationkey").select("r_name", "n_name", "n_nationkey").collect()]
    part = lambda found: {"type": "object", "required": [a for _, a, k in found if k % 2 == 0], "properties": {a: _TEXT for _, a, _ in found}}
    regions = {g: part([x for x in rows if x[0] == g]) for g in dict.fromkeys(x[0] for x in rows)}
    return {"title": "Atlas", **part(rows)}, {"type": "object", "title": "Atlas", "required": [*regions], "properties": regions}, rows


_PLACES = "SELECT r_name, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey"


def schema_split(spark: SparkSession, sf: str) -> DataFrame:
    flat, _, _ = _atlas(spark, sf)
    rows = [(i, k, name, name in part.get("required", []), part["title"]) for i, part in enumerate(S.split(flat, 4)) for k, name in enumerate(part["properties"])]
    return spark.createDataFrame(rows, "round int, ord int, field string, required boolean, title string")


SCHEMA_SPLIT = "SELECT (n_nationkey // 4)::INT AS round, (n_nationkey % 4)::INT AS ord, n_name AS field, n_nationkey % 2 = 0 AS required, 'Atlas_Round' || (n_nationkey // 4 + 1) AS title FROM nation"


def schema_optional(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of the nested schema before and after ``optional``."""
    _, nested, _ = _atlas(spark, sf)
    before, after = (S.fields_table(spark, x).select("path", "depth", "is_leaf", F.col("required").alias(name)) for x, name in ((nested, "required"), (S.optional(nested), "still_required")))
    return before.join(after, ["path", "depth", "is_leaf"])


SCHEMA_OPTIONAL = f"SELECT DISTINCT r_name AS path, 1 AS depth, FALSE AS is_leaf, TRUE AS required, FALSE AS still_required FROM ({_PLACES}) UNION ALL SELECT r_name || '.' || n_name, 2, TRUE, n_nationkey % 2 = 0, FALSE FROM ({_PLACES})"


def schema_metadata(spark: SparkSession, sf: str) -> DataFrame:
    _, nested, _ = _atlas(spark, sf)
    rows = [(g, m["n_properties"], m["n_required"], ",".join(sorted(m["required"]))) for g, m in ((g, S.metadata(x)) for g, x in nested["properties"].items())]
    return spark.createDataFrame(rows, "region string, n_properties int, n_required int, required string")


SCHEMA_METADATA = f"SELECT r_name AS region, count(*)::INT AS n_properties, count(*) FILTER (WHERE n_nationkey % 2 = 0)::INT AS n_required, coalesce(string_agg(n_name, ',' ORDER BY n_name) FILTER (WHERE n_nationkey % 2 = 0), '') AS required FROM ({_PLACES}) GROUP BY 1"


def schema_size(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves, depth and score of the nested schema, of its parts and of a list of it."""
    _, nested, _ = _atlas(spark, sf)
    parts = [("all", nested), ("list", {"type": "array", "items": nested}), *nested["properties"].items()]
    rows = [(name, c["fields"], c["depth"], c["is_array"], round(c["score"], 6)) for name, c in ((n, S.complexity(x)) for n, x in parts)]
    return spark.createDataFrame(rows, "part string, fields int, depth int, is_array boolean, score double")


SCHEMA_SIZE = f"""
WITH n AS (SELECT r_name AS part, count(*) AS fields, 1 AS depth, FALSE AS is_array FROM ({_PLACES}) GROUP BY 1 UNION ALL SELECT 'all', count(*), 2, FALSE FROM nation UNION ALL SELECT 'list', count(*), 2, TRUE FROM nation)
SELECT part, fields::INT AS fields, depth, is_array, round((least(fields / 100, 1.0) + least(depth / 10, 1.0)) / 2, 6)::DOUBLE AS score FROM n
"""


def schema_focused(spark: SparkSession, sf: str) -> DataFrame:
    """The leaves that are left of the nested schema, and how many fields it still requires."""
    _, nested, rows = _atlas(spark, sf)
    part = S.focused(nested, [f"{g}.{a}" for g, a, k in rows if k % 3 == 0])
    need = sum(len(x.get("required", [])) for x in (part, *part["properties"].values()))
    return spark.createDataFrame([(p, need) for p in S.leaves(part)], "path string, n_required int")


SCHEMA_FOCUSED = f"SELECT r_name || '.' || n_name AS path, 0 AS n_required FROM ({_PLACES}) WHERE n_nationkey % 3 = 0"


def leaves_found(spark: SparkSession, sf: str) -> DataFrame:
    """The leaves of each record that hold a value."""
    found = successful_leaves(F.col("record"), [*S.leaves(CUSTOMER)])
    return _customers(spark, sf).select("c_custkey", F.inline(found)).select("c_custkey", "path", F.when(F.col("path") != "account.balance", F.col("value")).alias("value"))


LEAVES_FOUND = f"""
WITH c AS ({_CUSTOMER_SQL})
SELECT c_custkey, 'name' AS path, name AS value FROM c UNION ALL SELECT c_custkey, 'segment', segment FROM c WHERE segment <> 'Pending' UNION ALL SELECT c_custkey, 'account.balance', NULL FROM c
UNION ALL SELECT c_custkey, 'contact.phone', phone FROM c WHERE NOT no_contact AND phone NOT IN ('N/A', 'unknown', '')
"""


def prompt_known(spark: SparkSession, sf: str) -> DataFrame:
    """A second request for each record: what is known, and what is missing."""
    r = F.col("record")
    known = F.filter(successful_leaves(r, [*S.leaves(CUSTOMER)]), lambda x: x["path"] != "account.balance")
    return _customers(spark, sf).select("c_custkey", prompts.focused_request(known, completeness.missing_fields(r, S.missable(CUSTOMER), None, 0.0), "Read on.").alias("request"))


PROMPT_KNOWN = f"""
WITH c AS ({_CUSTOMER_SQL}), p AS (SELECT *, no_contact OR phone IS NULL OR phone IN ('N/A', 'unknown', '') AS no_phone FROM c)
SELECT c_custkey, 'Known so far:' || chr(10) || '- name: ' || name || chr(10) || CASE WHEN segment = 'Pending' THEN '' ELSE '- segment: ' || segment || chr(10) END || CASE WHEN no_phone THEN '' ELSE '- contact.phone: ' || phone || chr(10) END
  || 'Still missing:' || chr(10) || '- account: account.nation' || chr(10) || '- contact: contact.email' || CASE WHEN no_phone THEN ', contact.phone' ELSE '' END || CASE WHEN segment = 'Pending' THEN chr(10) || '- segment: segment' ELSE '' END
  || chr(10) || 'Give only the missing fields.' || chr(10) || chr(10) || 'Read on.' AS request FROM p
"""


def prompt_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The request for each turn of a conversation, taken as chunks with and without pages; and that for a retry."""
    turn, none = F.col("turn"), F.lit(None).cast("int")
    ask = prompts.chunk_prompt("Go.", turn, turn + 3, F.when(turn % 2 == 0, turn + 1).otherwise(none), F.when(turn % 2 == 0, turn + 2).otherwise(none), True)
    return table(spark, sf, "conversations").select("conv_id", "turn", ask.alias("request"), prompts.retry_prompt(turn, F.when(turn % 3 == 0, F.col("role")), "Go.").alias("retry"))


PROMPT_CHUNKS = """
SELECT conv_id, turn, 'This is ' || CASE WHEN turn % 2 = 0 THEN 'pages ' || (turn + 1) || ' to ' || (turn + 2) ELSE 'part ' || (turn + 1) || ' of about ' || (turn + 3) END || '. List every item that it holds.' || chr(10) || chr(10) || 'Go.' AS request,
  'An earlier attempt found ' || turn || ' items and may be incomplete (' || coalesce(CASE WHEN turn % 3 = 0 THEN role END, 'no reason given') || '). Go through the pages again and list all.' || chr(10) || chr(10) || 'Go.' AS retry
FROM conversations
"""


def items_and_report(spark: SparkSession, sf: str) -> DataFrame:
    """Items and report of answers, some of which have no list or no report."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("role")).alias("roles"))
    k = F.col("conv_id") % 3
    items = F.when(k == 1, F.lit('"none"')).otherwise(F.to_json("roles"))
    report = F.when(k == 2, F.lit("null")).otherwise(F.concat(F.lit('{"items_found":'), F.size("roles").cast("string"), F.lit(',"extraction_complete":'), (F.size("roles") > 4).cast("string"), F.lit("}")))
    answer = F.concat(F.lit('{"items":'), items, F.lit(',"extraction_metadata":'), report, F.lit("}"))
    said = report_of(answer)
    return c.select("conv_id", F.array_join(items_of(answer, "string"), ",").alias("items"), said["items_found"].alias("items_found"), said["extraction_complete"].alias("complete"))


ITEMS_AND_REPORT = """
SELECT conv_id, CASE WHEN conv_id % 3 = 1 THEN '' ELSE string_agg(role, ',' ORDER BY role) END AS items, CASE WHEN conv_id % 3 <> 2 THEN count(*) END::BIGINT AS items_found, CASE WHEN conv_id % 3 <> 2 THEN count(*) > 4 END AS complete
FROM conversations GROUP BY conv_id
"""


def productive_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks that hold addresses, and how many."""
    chunks = segment.pack(table(spark, sf, "documents"), ["doc_id"], size=500)
    items = chunks.select("doc_id", "chunk_id", F.explode(F.regexp_extract_all("text", F.lit(RULES["ipv4"]), F.lit(0))).alias("item"))
    return completeness.productive_chunks(items, "doc_id")


PRODUCTIVE_CHUNKS = f"SELECT doc_id, chunk_id, len(regexp_extract_all(text, '{RULES['ipv4']}')) AS n_items FROM ({_pack_sql('500')}) WHERE regexp_matches(text, '{RULES['ipv4']}')"

_NOTE = {
    "type": "object", "required": ["id"],
    "properties": {"id": _TEXT, "note": _TEXT, "tag": _TEXT, "inner": {"type": "object", "required": ["a"], "properties": {"a": _TEXT, "b": _TEXT}}},
}


def pruned_records(spark: SparkSession, sf: str) -> DataFrame:
    """The keys that are left when empty optional fields go."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(pruned(json.loads(t), _NOTE)))

    k = F.col("p_partkey")
    say = lambda n, empty, full: F.when(k % n == 0, F.lit(empty)).otherwise(F.lit(full))
    inner = F.struct(say(4, None, "a").alias("a"), say(7, "", "b").alias("b"))
    record = F.struct(say(5, "", "id").alias("id"), say(2, "", "n").alias("note"), say(3, None, "t").alias("tag"), inner.alias("inner"))
    out = table(spark, sf, "part").select("p_partkey", cut(F.to_json(record, {"ignoreNullFields": "false"})).alias("r"))
    names = lambda c: F.array_join(F.array_sort(F.json_object_keys(c)), ",")
    return out.select("p_partkey", names(F.col("r")).alias("keys"), names(F.get_json_object("r", "$.inner")).alias("inner_keys"))


PRUNED_RECORDS = """
SELECT p_partkey, 'id,inner' || CASE WHEN p_partkey % 2 <> 0 THEN ',note' ELSE '' END || CASE WHEN p_partkey % 3 <> 0 THEN ',tag' ELSE '' END AS keys, 'a' || CASE WHEN p_partkey % 7 <> 0 THEN ',b' ELSE '' END AS inner_keys FROM part
"""


def document_text_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a thin text layer are read from their images, which fails or gives nothing for some."""
    thin = F.when(F.col("page_no") % 2 == 0, F.substring("text", 1, 20)).otherwise(F.col("text"))
    ocr = F.when(F.col("page_no") % 3 == 0, F.lit(None)).when(F.col("page_no") % 3 == 1, F.lit(" ")).otherwise(F.concat(F.lit("seen "), F.col("page_no").cast("string")))
    return pages.document_text(_pages(spark, sf).select("conv_id", "page_no", thin.alias("text"), ocr.alias("ocr")), "conv_id", ocr="ocr")


DOCUMENT_TEXT_HYBRID = f"""
WITH p AS (SELECT conv_id, page_no, trim(coalesce(CASE WHEN page_no % 2 = 0 THEN left(text, 20) ELSE text END, ''), ' ') AS t FROM ({_PAGE})),
q AS (SELECT conv_id, page_no, length(t) < 100 AS thin, CASE WHEN length(t) >= 100 THEN t WHEN page_no % 3 = 0 THEN '[OCR failed]' WHEN page_no % 3 = 1 THEN '[No text extracted]' ELSE 'seen ' || page_no END AS body FROM p)
SELECT conv_id, string_agg('--- PAGE ' || page_no || CASE WHEN thin THEN ' (OCR) ---' ELSE ' ---' END || chr(10) || body, chr(10) || chr(10) ORDER BY page_no) AS text, count(*)::INT AS n_pages FROM q GROUP BY conv_id
"""


def document_text_recommended(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's text by the method that fits it; every page has a text of its image."""
    rows = _pages(spark, sf).withColumn("ocr", F.concat(F.lit("seen "), F.col("page_no").cast("string")))
    return pages.recommended_text(rows, "conv_id", ocr="ocr", sample=3)


DOCUMENT_TEXT_RECOMMENDED = f"""
WITH m AS (SELECT conv_id, method FROM ({PDF_CLASSIFY})), q AS (SELECT p.conv_id, m.method, page_no, coalesce(text, '') AS t, method <> 'text_layer' AND (method <> 'hybrid' OR length(trim(coalesce(text, ''), ' ')) < 100) AS thin FROM ({_PAGE}) p JOIN m USING (conv_id)),
r AS (SELECT conv_id, method, page_no, thin, CASE WHEN thin THEN 'seen ' || page_no WHEN method = 'text_layer' THEN t ELSE trim(t, ' ') END AS body FROM q)
SELECT conv_id, method, coalesce(string_agg('--- PAGE ' || page_no || CASE WHEN thin THEN ' (OCR) ---' ELSE ' ---' END || chr(10) || body, chr(10) || chr(10) ORDER BY page_no) FILTER (WHERE regexp_matches(body, '\\S')), '') AS text,
  count(*) FILTER (WHERE regexp_matches(body, '\\S'))::INT AS n_pages FROM r GROUP BY conv_id, method
"""


def confidence_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Discounts taken as confidences, all of which are valid, and some that are missing."""
    given = F.when(F.col("l_linenumber") != 2, F.col("l_discount").cast("double") * 10)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(provenance.checked_confidence(given), 6).alias("confidence"))


CONFIDENCE_CHECKED = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 THEN round(l_discount::DOUBLE * 10, 6) END AS confidence FROM lineitem"


def cost_passes(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of an order as passes, some of which have no price."""
    cost = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 3 != 0, F.col("l_quantity").cast("double") / 8)
    return usage.summed_cost(table(spark, sf, "lineitem").select("l_orderkey", cost.alias("cost_usd")), ["l_orderkey"])


COST_PASSES = "SELECT l_orderkey, sum(CASE WHEN (l_orderkey + l_linenumber) % 3 <> 0 THEN l_quantity::DOUBLE / 8 END) AS cost_usd FROM lineitem GROUP BY 1"

_NAMED = (
    schema_split, schema_optional, schema_metadata, schema_size, schema_focused, leaves_found, prompt_known, prompt_chunks, items_and_report, productive_chunks, pruned_records, document_text_hybrid, document_text_recommended, confidence_checked, cost_passes,
)
QUERIES = {f.__name__: f for f in _NAMED}
SQL = {k: globals()[k.upper()] for k in QUERIES}
