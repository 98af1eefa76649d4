"""Queries over partial records: merging, voting, repeats, usage, provenance.

A conversation stands for a document, its turns for rounds, passes or chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions.emptiness import PREDICATES
from fieldspark.functions.paths import quoted, unquoted
from fieldspark.operators import dedup, merge, pages, provenance, usage, voting
from fieldspark.session import table

_FIELDS = """
f AS (
  SELECT conv_id, turn, 'role' AS key, role AS value FROM conversations UNION ALL
  SELECT conv_id, turn, 'reply', CASE WHEN role = 'user' THEN '' ELSE role END FROM conversations UNION ALL
  SELECT conv_id, turn, 'text', text FROM conversations UNION ALL
  SELECT conv_id, turn, 'first', CASE WHEN turn % 3 = 1 THEN '' ELSE split_part(text, ' ', 1) END FROM conversations UNION ALL
  SELECT conv_id, turn, 'never', '' FROM conversations
)"""


def rounds(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, key, value): five fields of each turn as JSON text, some of them empty."""
    turns = table(spark, sf, "conversations")
    empty = F.lit("")
    fields = {"role": F.col("role"), "reply": F.when(F.col("role") == "user", empty).otherwise(F.col("role")), "text": F.col("text"), "first": F.when(F.col("turn") % 3 == 1, empty).otherwise(F.split_part("text", F.lit(" "), F.lit(1))), "never": empty}
    rows = F.array(*[F.struct(F.lit(k).alias("key"), quoted(v).alias("value")) for k, v in fields.items()])
    return turns.select("conv_id", "turn", F.inline(rows))


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("value", unquoted(F.col("value")))


def merge_first(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(merge.merge(rounds(spark, sf), ["conv_id", "key"], "first", "turn"))


MERGE_FIRST = f"WITH {_FIELDS} SELECT conv_id, key, coalesce(min_by(value, turn) FILTER (WHERE value <> ''), '') AS value FROM f GROUP BY ALL"


def merge_last(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(merge.merge(rounds(spark, sf), ["conv_id", "key"], "last", "turn"))


MERGE_LAST = f"WITH {_FIELDS} SELECT conv_id, key, max_by(value, turn) AS value FROM f WHERE value <> '' GROUP BY ALL"


def merge_concat(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(merge.merge(rounds(spark, sf), ["conv_id", "key"], "concat", "turn"))


MERGE_CONCAT = f"WITH {_FIELDS} SELECT conv_id, key, string_agg(value, ' ' ORDER BY turn) AS value FROM f WHERE value <> '' GROUP BY conv_id, key"


def merge_prefer_longer(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(merge.merge(rounds(spark, sf), ["conv_id", "key"], "prefer_longer", "turn"))


MERGE_PREFER_LONGER = f"WITH {_FIELDS} SELECT conv_id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY length(value) DESC, turn) AS nth FROM f WHERE value <> '') WHERE nth = 1"


def merge_report(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_report(rounds(spark, sf), "conv_id", "key", "turn")


MERGE_REPORT = f"WITH {_FIELDS} SELECT conv_id, key, min(turn) AS first_round, count(DISTINCT turn) AS n_rounds FROM f WHERE value <> '' GROUP BY ALL"


def keys_per_round(spark: SparkSession, sf: str) -> DataFrame:
    return merge.keys_per_round(rounds(spark, sf), "conv_id", "key", "turn").withColumn("keys", F.array_join("keys", ","))


KEYS_PER_ROUND = f"WITH {_FIELDS} SELECT conv_id, turn, count(*) AS n_keys, string_agg(key, ',' ORDER BY key) AS keys FROM f WHERE value <> '' GROUP BY conv_id, turn"


def merge_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as chunks: the type as a scalar and in a list, the properties as an object."""
    events = table(spark, sf, "events")
    fields = {"kind": quoted(F.col("event_type")), "kinds": F.concat(F.lit("["), quoted(F.col("event_type")), F.lit("]")), "props": F.to_json(F.parse_json("props"))}
    rows = events.select("user_id", "event_id", F.inline(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()])))
    out = merge.merge_chunks(rows, ["user_id", "key"], "event_id")
    return out.select("user_id", "key", "value", F.size("source_chunks").alias("n_chunks"), F.element_at("source_chunks", 1).alias("first_chunk"))


MERGE_CHUNKS = """
SELECT user_id, 'kind' AS key, '"' || min_by(event_type, event_id) || '"' AS value, 1 AS n_chunks, min(event_id) AS first_chunk FROM events GROUP BY user_id
UNION ALL SELECT user_id, 'kinds', '[' || string_agg('"' || event_type || '"', ',' ORDER BY event_id) || ']', count(*)::INT, min(event_id) FROM events GROUP BY user_id
UNION ALL SELECT user_id, 'props', replace(max_by(props, event_id), ' ', ''), count(*)::INT, min(event_id) FROM events GROUP BY user_id
"""


def merge_items(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a conversation's turns as items of one list."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return merge.merge_items(turns, "conv_id", "turn", "pos").groupBy("conv_id", "turn").agg(F.min("item").alias("first_item"), F.max("item").alias("last_item"), F.count("*").alias("n_items"))


MERGE_ITEMS = """
WITH w AS (SELECT conv_id, turn, unnest(range(len(string_split(text, ' ')))) AS pos FROM conversations), i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS item FROM w)
SELECT conv_id, turn, min(item)::INT AS first_item, max(item)::INT AS last_item, count(*) AS n_items FROM i GROUP BY ALL
"""


def merge_passes(spark: SparkSession, sf: str) -> DataFrame:
    """First two turns as two passes; the second may fill in first and reply."""
    r = rounds(spark, sf)
    first, second = (r.where(F.col("turn") == t).select("conv_id", "key", "value") for t in (0, 1))
    out = merge.merge_passes(first, second, ["conv_id", "key"], F.col("key").isin("first", "reply"))
    return _plain(out)


MERGE_PASSES = f"""
WITH {_FIELDS}, a AS (SELECT * FROM f WHERE turn = 0), b AS (SELECT * FROM f WHERE turn = 1)
SELECT conv_id, key, CASE WHEN key IN ('first', 'reply') AND coalesce(b.value, '') <> '' THEN b.value ELSE a.value END AS value, key IN ('first', 'reply') AND coalesce(b.value, '') <> '' AND b.value IS DISTINCT FROM a.value AS updated
FROM a FULL JOIN b USING (conv_id, key)
"""


def _vote(strategy: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _plain(voting.vote(rounds(spark, sf), "conv_id", strategy, "turn"))

    return query


_ONE = "p AS (SELECT conv_id, count(DISTINCT turn) AS passes FROM conversations GROUP BY conv_id)"
_FIRST = f"WITH {_FIELDS}, {_ONE} SELECT conv_id, key, coalesce(min_by(value, turn) FILTER (WHERE value <> ''), '') AS value FROM f JOIN p USING (conv_id) GROUP BY conv_id, key, passes HAVING passes = 1 OR count(*) FILTER (WHERE value <> '') > 0"


def _mode(having: str) -> str:
    return f"""
WITH {_FIELDS}, {_ONE}, c AS (SELECT conv_id, key, value, count(*) AS n, min(turn) AS first FROM f WHERE value <> '' GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY n DESC, first) AS nth, sum(n) OVER (PARTITION BY conv_id, key) AS have FROM c)
SELECT conv_id, key, value FROM m JOIN p USING (conv_id) WHERE nth = 1 AND passes > 1 AND {having}
UNION ALL SELECT conv_id, key, value FROM f JOIN p USING (conv_id) WHERE passes = 1
"""


def vote_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """The longer a text, the surer it is taken to be."""
    r = rounds(spark, sf).withColumn("sure", (F.length(unquoted(F.col("value"))) / 1000).cast("double"))
    return _plain(voting.vote(r, "conv_id", "highest_confidence", "turn", confidence="sure"))


VOTE_CONFIDENCE = f"""
WITH {_FIELDS}, {_ONE}, m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY length(value) DESC, turn) AS nth FROM f WHERE value <> '')
SELECT conv_id, key, value FROM m JOIN p USING (conv_id) WHERE nth = 1 AND passes > 1 UNION ALL SELECT conv_id, key, value FROM f JOIN p USING (conv_id) WHERE passes = 1
"""


def dedup_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each source as items; the same text in any case, but for white space around it, is a repeat."""
    return dedup.dedup_items(table(spark, sf, "documents").select("source", "doc_id", "text"), "source", ["doc_id"], [dedup.normal_key(F.col("text"))]).select("source", "doc_id")


DEDUP_KEYS = r"SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))"


def dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup_stats(table(spark, sf, "documents"), "source", [dedup.normal_key(F.col("text"))])


DEDUP_STATS = r"SELECT source, count(*) AS original, count(DISTINCT lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS unique_items, original - unique_items AS removed FROM documents GROUP BY source"

_EVENT_USAGE = "SELECT user_id, event_type AS model, 1::BIGINT AS requests, 0::BIGINT AS tool_calls, floor(abs(value) * 10)::BIGINT AS input_tokens, CASE WHEN event_id % 7 = 0 THEN NULL ELSE floor(abs(value))::BIGINT END AS output_tokens FROM events"
PRICES = '{"click": {"input_per_1k": 0.5, "output_per_1k": 1.5}, "view": {"input_per_1k": 0.25, "output_per_1k": 2}, "odd": {"input_per_1k": "x"}, "buy": 3}'


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("user_id", F.col("event_type").alias("model"), F.lit(1).cast("long").alias("requests"), F.lit(0).cast("long").alias("tool_calls"), F.floor(F.abs("value") * 10).alias("input_tokens"), F.when(F.col("event_id") % 7 != 0, F.floor(F.abs("value"))).alias("output_tokens"))


def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return usage.usage_totals(_usage(spark, sf), ["user_id"])


USAGE_ROLLUP = f"SELECT user_id, sum(requests)::BIGINT AS requests, sum(tool_calls)::BIGINT AS tool_calls, sum(input_tokens)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, (sum(input_tokens) + coalesce(sum(output_tokens), 0))::BIGINT AS total_tokens FROM ({_EVENT_USAGE}) GROUP BY user_id"


def cost_join(spark: SparkSession, sf: str) -> DataFrame:
    """Cost by user and model; unknown models have none."""
    totals = usage.usage_totals(_usage(spark, sf), ["user_id", "model"])
    return usage.with_cost(totals, usage.parse_prices(PRICES)).select("user_id", "model", "total_tokens", F.round("cost_usd", 6).alias("cost_usd"))


COST_JOIN = f"""
WITH u AS (SELECT user_id, model, sum(input_tokens) AS i, coalesce(sum(output_tokens), 0) AS o FROM ({_EVENT_USAGE}) GROUP BY ALL), p(model, a, b) AS (VALUES ('click', 0.5::DOUBLE, 1.5::DOUBLE), ('view', 0.25, 2))
SELECT user_id, u.model, (i + o)::BIGINT AS total_tokens, round(i / 1000 * a + o / 1000 * b, 6) AS cost_usd FROM u LEFT JOIN p ON u.model = p.model
"""

_VALUES = ["null", '""', '" \\t"', '"N/A"', '" n/a "', '"Pending"', "[]", "{}", "0", "0.0", "false", '"none"', '"x"', "[0]"]


def emptiness(spark: SparkSession, sf: str) -> DataFrame:
    """The six predicates over a value for each turn; turns beyond the list have none."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.get(F.array(*[F.lit(v) for v in _VALUES]), ((F.col("conv_id") + F.col("turn")) % (len(_VALUES) + 1)).cast("int")).alias("v"))
    return turns.select("conv_id", "turn", *[F.coalesce(f(F.col("v")), F.lit(True)).alias(k) for k, f in PREDICATES.items()])


_LIST = "[" + ", ".join("'" + v + "'" for v in _VALUES) + "]"
EMPTINESS = f"""
WITH t AS (SELECT conv_id, turn, ({_LIST})[(conv_id + turn) % {len(_VALUES) + 1} + 1] AS v FROM conversations),
s AS (SELECT *, v IS NULL OR v IN ('null', '""', '[]', '{{}}') AS e FROM t)
SELECT conv_id, turn, e AS empty_strict, e OR v = '" \\t"' AS empty_blank, e OR lower(v) IN ('"n/a"', '"pending"', '"none"') AS empty_placeholder, v IS NULL OR v IN ('null', '""', '[]') AS empty_pass, e OR v IN ('0', '0.0', 'false') AS falsy, v IS NULL OR v IN ('null', '""') AS required_empty FROM s
"""


def citation(spark: SparkSession, sf: str) -> DataFrame:
    """The second word of each turn, in lower case, cited from the turn."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lower(F.split_part("text", F.lit(" "), F.lit(2))).alias("value"))
    return turns.select("conv_id", "turn", provenance.citation(F.col("text"), F.col("value"), 30).alias("citation"))


CITATION = r"""
WITH v AS (SELECT conv_id, turn, text, lower(split_part(text, ' ', 2)) AS value FROM conversations),
p AS (SELECT *, strpos(lower(text), lower(value)) AS pos FROM v), q AS (SELECT *, greatest(1, pos - 30) AS b, least(length(text), pos - 1 + length(value) + 30) AS e FROM p)
SELECT conv_id, turn, CASE WHEN pos > 0 AND value <> '' THEN trim(regexp_replace(CASE WHEN b > 1 THEN '...' ELSE '' END || substr(text, b, e - b + 1) || CASE WHEN e < length(text) THEN '...' ELSE '' END, '\s+', ' ', 'g')) END AS citation FROM q
"""


def provenance_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Of a user's events of a type, that of most confidence; the first of equals."""
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("field"), "event_id", (F.floor(F.abs("value")) % 10 / 10).alias("confidence"))
    return provenance.merge_provenance(e, ["user_id", "field"], "event_id")


PROVENANCE_MERGE = """
SELECT user_id, field, event_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY confidence DESC, event_id) AS nth
  FROM (SELECT user_id, event_type AS field, event_id, floor(abs(value)) % 10 / 10 AS confidence FROM events)) WHERE nth = 1
"""

_PAGE = "SELECT conv_id, turn + 1 AS page_no, CASE WHEN (conv_id + turn) % 4 = 0 THEN '' ELSE text END AS text, CASE WHEN (conv_id + turn) % 5 = 0 THEN 1 ELSE 0 END AS n_images FROM conversations"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    t, n = table(spark, sf, "conversations"), F.col("conv_id") + F.col("turn")
    return t.select("conv_id", (F.col("turn") + 1).alias("page_no"), F.when(n % 4 == 0, "").otherwise(F.col("text")).alias("text"), F.when(n % 5 == 0, 1).otherwise(0).alias("n_images"))


def pdf_classify(spark: SparkSession, sf: str) -> DataFrame:
    out = pages.analyze(_pages(spark, sf), "conv_id", sample=3)
    return out.select("conv_id", "n_pages", F.round("text_ratio", 6).alias("text_ratio"), F.round("quality", 6).alias("quality"), "pdf_type", "method", "confidence")


PDF_CLASSIFY = f"""
WITH p AS ({_PAGE}), t AS (SELECT conv_id, count(*) AS n FROM p GROUP BY conv_id),
l AS (SELECT p.*, n, length(trim(text)) AS c FROM p JOIN t USING (conv_id) WHERE n <= 3 OR list_contains(list_transform(range(3), lambda i: floor(i * n / 3)::BIGINT), page_no - 1)),
a AS (SELECT conv_id, any_value(n)::INT AS n_pages, avg((c >= 100)::INT) AS text_ratio, avg((n_images > 0)::INT) AS images, avg(c) AS chars FROM l GROUP BY conv_id),
q AS (SELECT *, 0.7 * text_ratio + 0.3 * least(1, chars / 500) AS quality, CASE WHEN text_ratio > 0.8 THEN CASE WHEN images > 0.3 THEN 'image_heavy' ELSE 'text_rich' END WHEN 1 - text_ratio > 0.8 THEN 'scanned' ELSE 'hybrid' END AS pdf_type FROM a)
SELECT conv_id, n_pages, round(text_ratio, 6) AS text_ratio, round(quality, 6) AS quality, pdf_type,
  CASE pdf_type WHEN 'text_rich' THEN 'text_layer' WHEN 'scanned' THEN 'ocr' WHEN 'hybrid' THEN 'hybrid' ELSE CASE WHEN n_pages <= 20 THEN 'vision' ELSE 'hybrid' END END AS method,
  CASE pdf_type WHEN 'text_rich' THEN CASE WHEN quality >= 0.7 THEN 0.95 ELSE 0.75 END WHEN 'scanned' THEN 0.9 WHEN 'hybrid' THEN 0.8 ELSE CASE WHEN n_pages <= 20 THEN 0.85 ELSE 0.75 END END AS confidence FROM q
"""


def document_text(spark: SparkSession, sf: str) -> DataFrame:
    return pages.document_text(_pages(spark, sf), "conv_id")


DOCUMENT_TEXT = f"WITH p AS ({_PAGE}) SELECT conv_id, string_agg('--- PAGE ' || page_no || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page_no) AS text, count(*)::INT AS n_pages FROM p WHERE regexp_matches(text, '\\S') GROUP BY conv_id"


def page_range(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_range(_pages(spark, sf), 2, 3).select("conv_id", "page_no", "text")


PAGE_RANGE = f"SELECT conv_id, page_no, text FROM ({_PAGE}) WHERE page_no BETWEEN 2 AND 3"


def document_complexity(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("pdf", "image", "text")])
    files = table(spark, sf, "documents").select("source", F.element_at(kinds, (F.col("doc_id") % 3 + 1).cast("int")).alias("kind"), (F.col("n_chars") * 100).alias("size"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 9 + 1).alias("n_pages"))
    return pages.complexity(files, "source")


DOCUMENT_COMPLEXITY = """
WITH f AS (SELECT source, (['pdf', 'image', 'text'])[doc_id % 3 + 1] AS kind, n_chars * 100 AS size, CASE WHEN doc_id % 2 = 0 THEN doc_id % 9 + 1 END AS pages FROM documents),
g AS (SELECT *, CASE kind WHEN 'pdf' THEN coalesce(pages, greatest(1, size // 50000)) WHEN 'image' THEN 1 ELSE 0 END AS n FROM f)
SELECT source, count(*) AS n_files, sum(n)::BIGINT AS total_pages, sum(CASE kind WHEN 'pdf' THEN n * 2500 WHEN 'image' THEN 1000 ELSE size // 4 END)::BIGINT AS est_tokens, string_agg(DISTINCT CASE kind WHEN 'text' THEN 'other' ELSE kind END, ',' ORDER BY CASE kind WHEN 'text' THEN 'other' ELSE kind END) AS kinds FROM g GROUP BY source
"""

_NAMED = (merge_first, merge_last, merge_concat, merge_prefer_longer, merge_report, keys_per_round, merge_chunks, merge_items, merge_passes, vote_confidence, dedup_keys, dedup_stats, usage_rollup, cost_join, emptiness, citation, provenance_merge, pdf_classify, document_text, page_range, document_complexity)
QUERIES = {f.__name__: f for f in _NAMED} | {f"vote_{s}": _vote(s) for s in ("union", "intersection", "majority")}
SQL = {f.__name__: globals()[f.__name__.upper()] for f in _NAMED} | {"vote_union": _FIRST, "vote_intersection": _mode("have = passes"), "vote_majority": _mode("have * 2 > passes")}
