"""Queries over records and their schemas: what is missing or wrong, thresholds, groups, page ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions import tokens
from fieldspark.functions.paths import unquoted, value_at, with_value
from fieldspark.operators import completeness, merge
from fieldspark.plans import prompts
from fieldspark.plans import schema as S
from fieldspark.plans.engine import extra_keys
from fieldspark.plans.validate import empty_required_column, error_column
from fieldspark.session import table

_TEXT, _NUMBER = {"type": "string"}, {"type": "number"}
CUSTOMER = {
    "type": "object", "required": ["name", "contact"],
    "properties": {
        "name": _TEXT, "segment": _TEXT, "contact": {"type": "object", "required": ["phone"], "properties": {"phone": _TEXT, "email": _TEXT}},
        "account": {"type": "object", "properties": {"balance": _NUMBER, "nation": {"type": "integer"}}},
    },
}
ORDER = {
    "type": "object", "required": ["id", "status"],
    "properties": {"id": {"type": "integer"}, "status": {"type": "string", "enum": ["O", "F"]}, "price": {"type": "number", "minimum": 1000, "maximum": 300000}, "priority": {"type": "string", "maxLength": 8, "pattern": "^[1-5]"}},
}

_PHONES = ["N/A", "unknown", "", "+1 555", " "]
_CUSTOMER_SQL = f"SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'Pending' ELSE c_mktsegment END AS segment, ([{', '.join(repr(p) for p in _PHONES)}])[c_custkey % 6 + 1] AS phone, c_custkey % 4 = 0 AS no_contact, c_acctbal FROM customer"


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    """(c_custkey, record): records as VARIANT, with placeholders and gaps."""
    # rows of few bytes, of which much is made: a file of them is one partition, which would keep one core busy
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    phone = F.get(F.array(*[F.lit(p) for p in _PHONES]), (F.col("c_custkey") % 6).cast("int"))
    contact = F.when(F.col("c_custkey") % 4 != 0, F.struct(phone.alias("phone")))
    record = F.struct(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "Pending").otherwise(F.col("c_mktsegment")).alias("segment"), contact.alias("contact"), F.struct(F.col("c_acctbal").alias("balance")).alias("account"))
    return c.select("c_custkey", F.parse_json(F.to_json(record)).alias("record"))


def missing_fields(spark: SparkSession, sf: str) -> DataFrame:
    gone = completeness.missing_fields(F.col("record"), S.missable(CUSTOMER), [*S.leaves(CUSTOMER)], 0.5)
    return _customers(spark, sf).select("c_custkey", F.array_join(gone, ",").alias("missing"), F.size(gone).alias("n_missing"))


MISSING_FIELDS = f"""
WITH c AS ({_CUSTOMER_SQL}), m AS (
  SELECT c_custkey, list_filter([CASE WHEN segment = 'Pending' THEN 'segment' END, CASE WHEN no_contact OR phone IS NULL OR phone IN ('N/A', 'unknown', '') THEN 'contact.phone' END, 'contact.email', 'account.nation'], lambda x: x IS NOT NULL) AS gone FROM c
), t AS (SELECT c_custkey, CASE WHEN len(gone) / 6 > 0.5 THEN gone ELSE [] END AS gone FROM m)
SELECT c_custkey, array_to_string(gone, ',') AS missing, len(gone)::INT AS n_missing FROM t
"""


def prompt_focus(spark: SparkSession, sf: str) -> DataFrame:
    """The gaps of each record, by section."""
    gone = completeness.missing_fields(F.col("record"), S.missable(CUSTOMER), None, 0.0)
    return _customers(spark, sf).select("c_custkey", prompts.missing_by_section(gone).alias("gaps"))


PROMPT_FOCUS = f"""
WITH c AS ({_CUSTOMER_SQL})
SELECT c_custkey, '- account: account.nation' || chr(10) || '- contact: contact.email' || CASE WHEN no_contact OR phone IS NULL OR phone IN ('N/A', 'unknown', '') THEN ', contact.phone' ELSE '' END || CASE WHEN segment = 'Pending' THEN chr(10) || '- segment: segment' ELSE '' END AS gaps FROM c
"""


def required_empty(spark: SparkSession, sf: str) -> DataFrame:
    return _customers(spark, sf).select("c_custkey", F.array_join(empty_required_column(F.col("record"), CUSTOMER), ",").alias("faults"))


REQUIRED_EMPTY = f"WITH c AS ({_CUSTOMER_SQL}) SELECT c_custkey, CASE WHEN no_contact THEN 'contact' WHEN phone IS NULL OR phone = '' THEN 'contact.phone' ELSE '' END AS faults FROM c"


def nested_get(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("record")
    return _customers(spark, sf).select("c_custkey", unquoted(value_at(r, "contact.phone")).alias("phone"), value_at(r, "name.first").alias("nothing"), value_at(r, "account.balance").cast("double").alias("balance"))


NESTED_GET = f"WITH c AS ({_CUSTOMER_SQL}) SELECT c_custkey, CASE WHEN NOT no_contact THEN phone END AS phone, NULL AS nothing, c_acctbal AS balance FROM c"


def nested_set(spark: SparkSession, sf: str) -> DataFrame:
    """contact.phone set to a number, whether there was a contact or not; the rest stays."""
    changed = with_value(F.to_json("record"), "contact.phone", F.concat(F.lit('"#'), F.col("c_custkey").cast("string"), F.lit('"')))
    out = _customers(spark, sf).select("c_custkey", F.parse_json(changed).alias("r"))
    return out.select("c_custkey", unquoted(value_at(F.col("r"), "contact.phone")).alias("phone"), unquoted(value_at(F.col("r"), "name")).alias("name"))


NESTED_SET = "SELECT c_custkey, '#' || c_custkey AS phone, c_name AS name FROM customer"


def validation_errors(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus"))
    key = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("k"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    record = F.struct(status.alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    merged = with_value(F.to_json(record), "id", F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit('"'), key, F.lit('"'))).otherwise(key))
    found = error_column(F.parse_json(merged), ORDER)
    return o.select("o_orderkey", F.array_join(F.array_sort(found), "; ").alias("errors"))


VALIDATION_ERRORS = """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS status, o_totalprice AS price, o_orderpriority AS priority FROM orders)
SELECT o_orderkey, array_to_string(list_sort(list_filter([
  CASE WHEN status IS NULL THEN '$.status: required' END,
  CASE WHEN o_orderkey % 7 = 0 THEN '$.id: not of type integer' END,
  CASE WHEN status NOT IN ('O', 'F') THEN '$.status: not one of the listed values' END,
  CASE WHEN price < 1000 THEN '$.price: violates minimum 1000' END, CASE WHEN price > 300000 THEN '$.price: violates maximum 300000' END,
  CASE WHEN length(priority) > 8 THEN '$.priority: violates maxLength 8' END, CASE WHEN NOT regexp_matches(priority, '^[1-5]') THEN '$.priority: violates pattern ''^[1-5]''' END
], lambda e: e IS NOT NULL)), '; ') AS errors FROM o
"""


def adaptive_threshold(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    fields, depth, array, pages = F.col("doc_id") % 70, F.col("doc_id") % 6 + 1, F.col("doc_id") % 4 == 0, F.floor(F.col("n_chars") / 100) + 1
    return d.select("doc_id", completeness.adaptive_threshold(fields, depth, array, pages).alias("threshold"), completeness.array_instances(array, pages).cast("long").alias("instances"), F.round(completeness.complexity(fields, depth), 6).alias("score"))


ADAPTIVE_THRESHOLD = """
WITH d AS (SELECT doc_id, doc_id % 70 AS f, doc_id % 6 + 1 AS d, doc_id % 4 = 0 AS a, n_chars // 100 + 1 AS p FROM documents),
i AS (SELECT *, CASE WHEN a THEN greatest(1, p * CASE WHEN p < 5 THEN 5 WHEN p < 50 THEN 10 ELSE 15 END) ELSE 0 END AS instances FROM d)
SELECT doc_id, round(least(0.6, greatest(0.1, 0.3 + CASE WHEN f < 10 THEN -0.1 WHEN f > 50 THEN 0.1 ELSE 0 END + CASE WHEN d > 3 THEN 0.05 ELSE 0 END + CASE WHEN p > 50 THEN 0.05 WHEN p < 5 THEN -0.05 ELSE 0 END + CASE WHEN a AND instances > 100 THEN 0.1 ELSE 0 END))::DOUBLE, 4) AS threshold,
  instances::BIGINT AS instances, round((least(f / 100, 1.0) + least(d / 10, 1.0)) / 2, 6) AS score FROM i
"""


def should_retry(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    complete = F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False)
    sure = F.when(F.col("event_id") % 5 != 0, F.floor(F.abs("value")) % 10 / 10)
    return e.select("event_id", completeness.should_retry(complete, sure).alias("again"))


SHOULD_RETRY = "SELECT event_id, NOT coalesce(CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END, true) OR coalesce(CASE WHEN event_id % 5 <> 0 THEN floor(abs(value)) % 10 / 10 END, 1.0) < 0.7 AS again FROM events"


def page_markers(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations")
    text = F.concat(F.lit("--- PAGE "), F.col("turn").cast("string"), F.lit(" ---\n"), F.col("text"), F.lit("\n--- PAGE "), F.col("conv_id").cast("string"), F.lit(" (OCR) ---\n--- PAGE "), F.col("turn").cast("string"), F.lit("---"))
    return t.select("conv_id", "turn", F.array_join(completeness.page_markers(text).cast("array<string>"), ",").alias("pages"))


PAGE_MARKERS = "SELECT conv_id, turn, CASE WHEN turn = conv_id THEN turn::VARCHAR ELSE turn || ',' || conv_id END AS pages FROM conversations"


def page_hints(spark: SparkSession, sf: str) -> DataFrame:
    t, n = table(spark, sf, "conversations"), F.col("turn")
    prompt = F.concat(F.lit("See Pages "), (n + 3).cast("string"), F.lit("-"), (n + 9).cast("string"), F.lit(" and on page "), (n + 20).cast("string"), F.lit(", around PAGE "), (n + 3).cast("string"))
    return t.select("conv_id", "turn", F.array_join(completeness.page_hints(prompt).cast("array<string>"), ",").alias("pages"))


PAGE_HINTS = "SELECT conv_id, turn, (turn + 3) || ',' || (turn + 9) || ',' || (turn + 20) AS pages FROM conversations"


def focus_range(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as chunks of 9 + 13 (conv_id mod 9) pages; hints for every seventh conversation."""
    t, size = table(spark, sf, "conversations"), 9 + 13 * (F.col("conv_id") % 9)
    chunks = t.select("conv_id", F.col("turn").alias("chunk_id"), (F.col("turn") * size + 1).alias("page_lo"), ((F.col("turn") + 1) * size).alias("page_hi"), ((F.col("conv_id") % 3 == 0) & (F.col("turn") % 2 == 1)).alias("productive"))
    hints = t.where((F.col("conv_id") % 7 == 0) & (F.col("turn") == 0)).select("conv_id", F.lit(4).alias("hint_lo"), F.lit(12).alias("hint_hi"))
    return completeness.focus_range(chunks, "conv_id", hints)


FOCUS_RANGE = """
WITH c AS (SELECT conv_id, turn, 9 + 13 * (conv_id % 9) AS size, turn * (9 + 13 * (conv_id % 9)) + 1 AS lo, (turn + 1) * (9 + 13 * (conv_id % 9)) AS hi, conv_id % 3 = 0 AND turn % 2 = 1 AS good FROM conversations),
n AS (SELECT a.*, EXISTS (SELECT 1 FROM c b WHERE b.conv_id = a.conv_id AND b.good AND abs(b.turn - a.turn) <= 1) AS near FROM c a),
s AS (SELECT conv_id, min(lo) AS lo, max(hi) AS hi, any_value(size) AS size, count(*) * any_value(size) AS n, min(lo) FILTER (WHERE near) AS nlo, max(hi) FILTER (WHERE near) AS nhi, min(lo) FILTER (WHERE good) AS glo, max(hi) FILTER (WHERE good) AS ghi FROM n GROUP BY conv_id),
f AS (SELECT *, CASE WHEN conv_id % 7 = 0 THEN 'hints' WHEN nhi - nlo + 1 <= 150 THEN 'neighbours' WHEN ghi - glo + 1 <= 100 THEN 'productive' WHEN glo IS NOT NULL THEN 'largest' WHEN size BETWEEN 10 AND 50 THEN 'smallest' WHEN n > 50 THEN 'middle' ELSE 'all' END AS strategy FROM s)
SELECT conv_id, strategy,
  greatest(lo, CASE strategy WHEN 'hints' THEN -1 WHEN 'neighbours' THEN nlo WHEN 'productive' THEN glo WHEN 'largest' THEN glo WHEN 'smallest' THEN lo WHEN 'middle' THEN lo + n // 3 ELSE lo - 2 END)::INT AS page_lo,
  least(hi, CASE strategy WHEN 'hints' THEN 17 WHEN 'neighbours' THEN nhi WHEN 'productive' THEN ghi WHEN 'largest' THEN glo + size - 1 WHEN 'smallest' THEN lo + size - 1 WHEN 'middle' THEN lo + 2 * (n // 3) ELSE hi + 2 END)::INT AS page_hi FROM f
"""

_NAMES = ["Claimant_Name", "claim_id", "loss_date", "policy_no", "net_price", "inspector_id", "vendor_x", "created_at", "phone", "state", "notes", "colour"]


def field_groups(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in _NAMES])
    d = table(spark, sf, "documents").select("doc_id", F.element_at(names, (F.col("doc_id") % len(_NAMES) + 1).cast("int")).alias("field"))
    return d.select("doc_id", "field", S.group_column(F.col("field")).alias("group"))


FIELD_GROUPS = f"SELECT doc_id, ([{', '.join(repr(n) for n in _NAMES)}])[doc_id % {len(_NAMES)} + 1] AS field, ([{', '.join(repr(S.group_of(n)) for n in _NAMES)}])[doc_id % {len(_NAMES)} + 1] AS \"group\" FROM documents"


def schema_fields(spark: SparkSession, sf: str) -> DataFrame:
    return S.fields_table(spark, CUSTOMER).withColumn("bucket", F.floor(F.col("ord") / 3))


SCHEMA_FIELDS = """
SELECT *, ord // 3 AS bucket FROM (VALUES ('name', NULL, 1, 0, 'string', true, true), ('segment', NULL, 1, 1, 'string', false, true), ('contact', NULL, 1, 2, 'object', true, false), ('contact.phone', 'contact', 2, 3, 'string', true, true),
  ('contact.email', 'contact', 2, 4, 'string', false, true), ('account', NULL, 1, 5, 'object', false, false), ('account.balance', 'account', 2, 6, 'number', false, true), ('account.nation', 'account', 2, 7, 'integer', false, true)) t(path, parent, depth, ord, json_type, required, is_leaf)
"""


def chunk_fields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tokens.chunk_fields(F.col("doc_id") % 45, F.col("n_chars") * 10).alias("by_field"))


CHUNK_FIELDS = "SELECT doc_id, doc_id % 45 >= 30 OR (doc_id % 45 > 20 AND n_chars * 10 > 50000) AS by_field FROM documents"


def extra_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """How often each key turns up under extra."""
    e = table(spark, sf, "events").select(F.concat(F.lit('{"extra": {"'), F.col("event_type"), F.lit('": 1, "all": 2}}')).alias("data"))
    return extra_keys(e)


EXTRA_PROMOTION = "SELECT event_type AS key, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'all', count(*) FROM events"


def field_group_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as field groups: zero counts as empty, keys that begin with _ go."""
    e = table(spark, sf, "events")
    rows = e.select("user_id", "event_id", F.when(F.col("event_id") % 6 == 0, "_own").otherwise(F.col("event_type")).alias("key"), (F.col("event_id") % 3).cast("string").alias("value"))
    return merge.merge_groups(rows, ["user_id", "key"], "event_id")


FIELD_GROUP_MERGE = """
SELECT user_id, event_type AS key, coalesce(min_by((event_id % 3)::VARCHAR, event_id) FILTER (WHERE event_id % 3 <> 0), '0') AS value FROM events WHERE event_id % 6 <> 0 GROUP BY user_id, event_type
"""

_NAMED = (missing_fields, prompt_focus, required_empty, nested_get, nested_set, validation_errors, adaptive_threshold, should_retry, page_markers, page_hints, focus_range, field_groups, schema_fields, chunk_fields, extra_promotion, field_group_merge)
QUERIES = {f.__name__: f for f in _NAMED}
SQL = {k: globals()[k.upper()] for k in QUERIES}
