"""Queries over texts: estimates, sentences, chunks, spreading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions import mime, tokens
from fieldspark.operators import distribute, segment
from fieldspark.session import table
from fieldspark.sources import files

MODELS = ["gpt-4o-mini", "gpt-4", "claude-3-haiku-20240307", "vertex/gemini-pro", "GPT-3.5-Turbo", "own-model"]
BUFFER = 2000


def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    models = F.array(*[F.lit(m) for m in MODELS])
    docs = table(spark, sf, "documents").select("doc_id", "text", F.element_at(models, (F.col("doc_id") % len(MODELS) + 1).cast("int")).alias("model"))
    lit = lambda n: F.lit(n).cast("long")
    out = tokens.estimate(docs, tokens.count_tokens(F.col("text")), lit(300), lit(50), lit(0), F.col("model"))
    return out.select("doc_id", "model", "file_tokens", "total_tokens", "model_limit", "effective_limit", "utilization", "needs_chunking", "recommended_chunks")


_MODEL_LIST = "[" + ", ".join(f"'{m}'" for m in MODELS) + "]"
_LIMIT = "CASE " + " ".join(f"WHEN lower(model) LIKE '%{k}%' THEN {v}" for k, v in sorted(((k, v) for v, ks in tokens.LIMITS.items() for k in ks), key=lambda x: -len(x[0]))) + f" ELSE {tokens.DEFAULT_LIMIT} END"
TOKEN_ESTIMATE = f"""
WITH a AS (SELECT doc_id, length(text) // 4 AS file_tokens, ({_MODEL_LIST})[doc_id % {len(MODELS)} + 1] AS model FROM documents),
b AS (SELECT *, file_tokens + 1350 AS total_tokens, {_LIMIT} AS model_limit FROM a),
c AS (SELECT *, floor(model_limit * 0.3)::BIGINT AS effective_limit FROM b)
SELECT doc_id, model, file_tokens, total_tokens, model_limit, effective_limit, total_tokens / model_limit AS utilization, total_tokens > effective_limit AS needs_chunking,
  CASE WHEN total_tokens <= effective_limit OR effective_limit <= 1350 THEN 1 ELSE greatest(2, file_tokens // (effective_limit - 1350) + 1) END AS recommended_chunks
FROM c
"""


def sentences_token(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(segment.sentences(F.col("text"))).alias("ord", "sentence"))


_SENTENCES = r"list_filter(string_split(regexp_replace(text, '([.!?])(\s|$)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '')"
SENTENCES_TOKEN = f"SELECT doc_id, unnest(range(len(s)))::INT AS ord, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)"


def sentences_regex(spark: SparkSession, sf: str) -> DataFrame:
    """The lossy form, for compatibility."""
    docs = table(spark, sf, "documents").select("doc_id", segment.sentences(F.col("text"), lossy=True).alias("s"))
    return docs.select("doc_id", F.posexplode("s").alias("ord", "sentence"))


SENTENCES_REGEX = r"""
WITH s AS (SELECT doc_id, regexp_extract_all(text, '([^.!?]*[.!?]+(?:\s+|$))', 1) AS a, regexp_replace(text, '(?s)^.*[.!?](\s+|$)', '') AS rest FROM documents),
t AS (SELECT doc_id, CASE WHEN regexp_matches(rest, '\S') THEN list_append(a, rest) ELSE a END AS s FROM s)
SELECT doc_id, unnest(range(len(s)))::INT AS ord, unnest(s) AS sentence FROM t
"""


def text_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = segment.token_rows(table(spark, sf, "pages"), ["page_id"], "html")
    return rows.groupBy("page_id").agg(F.count("*").alias("n_tokens"), F.sum(F.length("token")).alias("n_chars"), F.max("end").alias("end_char"), F.count_if("after_nl").alias("n_line_starts"), F.sum("start").alias("sum_starts"))


TEXT_TOKENS = r"""
WITH t AS (SELECT page_id, regexp_extract_all(html, '([\p{L}\p{M}\p{Nd}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Pc}\s]|\s+)', 1) AS a FROM pages),
u AS (SELECT page_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS tok FROM t),
v AS (SELECT *, lag(tok) OVER (PARTITION BY page_id ORDER BY i) AS prev, coalesce(sum(length(tok)) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u)
SELECT page_id, count(*) AS n_tokens, sum(length(tok))::BIGINT AS n_chars, max(start + length(tok))::BIGINT AS end_char,
  count(*) FILTER (WHERE NOT regexp_matches(tok, '^\s') AND (prev IS NULL OR (regexp_matches(prev, '^\s') AND (ends_with(prev, chr(10)) OR i = 2)))) AS n_line_starts, sum(start)::BIGINT AS sum_starts
FROM v GROUP BY page_id
"""


def chunks_pack(spark: SparkSession, sf: str) -> DataFrame:
    return segment.pack(table(spark, sf, "documents"), ["doc_id"], size=BUFFER)


def _pack_lines_sql(size: str, table_: str = "documents", id_: str = "doc_id") -> str:
    """As ``_pack_sql``, but a sentence that is longer than a chunk is cut at its line feeds and stands alone."""
    return f"""
WITH s AS (SELECT {id_}, {size} AS size, {_SENTENCES} AS ss FROM {table_} WHERE regexp_matches(text, '\\S')),
p AS (
  SELECT {id_}, flatten(list_transform(range(1, len(ss) + 1), lambda i: CASE WHEN length(ss[i]) > size
    THEN list_transform(regexp_extract_all(ss[i], '[^\n]*\n|[^\n]+'), lambda l, j: {{'t': l, 'b': j = 1, 'k': (j = 1)::INT, 'size': size}})
    ELSE [{{'t': ss[i], 'b': i > 1 AND length(ss[i - 1]) > size, 'k': 1, 'size': size}}] END)) AS parts FROM s
), f AS (
  SELECT {id_}, list_reduce(list_transform(parts, lambda p: {{'done': []::STRUCT(t VARCHAR, n INT)[], 'now': p.t, 'b': p.b, 'k': p.k, 'size': p.size}}), lambda a, b:
    CASE WHEN NOT b.b AND length(a.now) + length(b.now) <= a.size
      THEN {{'done': a.done, 'now': a.now || b.now, 'b': a.b, 'k': a.k + b.k, 'size': a.size}}
      ELSE {{'done': list_append(a.done, {{'t': a.now, 'n': a.k}}), 'now': b.now, 'b': b.b, 'k': b.k, 'size': a.size}} END) AS r FROM p
), c AS (SELECT {id_}, list_append(r.done, {{'t': r.now, 'n': r.k}}) AS cs FROM f),
u AS (SELECT {id_}, unnest(range(len(cs)))::INT AS chunk_id, unnest(cs) AS c FROM c)
SELECT {id_}, chunk_id, c.t AS text, (sum(length(c.t)) OVER w - length(c.t))::INT AS char_start, (sum(length(c.t)) OVER w)::INT AS char_end, c.n::INT AS n_sentences
FROM u WINDOW w AS (PARTITION BY {id_} ORDER BY chunk_id)"""


def _pack_sql(size: str, parts: str = _SENTENCES, table_: str = "documents", id_: str = "doc_id") -> str:
    return f"""
WITH s AS (SELECT {id_}, {size} AS size, {parts} AS parts FROM {table_} WHERE regexp_matches(text, '\\S')),
f AS (
  SELECT {id_}, list_reduce(list_transform(parts, lambda p: {{'done': []::STRUCT(t VARCHAR, n INT)[], 'now': p, 'k': 1, 'size': size}}), lambda a, b:
    CASE WHEN length(a.now) + length(b.now) <= a.size
      THEN {{'done': a.done, 'now': a.now || b.now, 'k': a.k + 1, 'size': a.size}}
      ELSE {{'done': list_append(a.done, {{'t': a.now, 'n': a.k}}), 'now': b.now, 'k': 1, 'size': a.size}} END) AS r FROM s
), c AS (SELECT {id_}, list_append(r.done, {{'t': r.now, 'n': r.k}}) AS cs FROM f),
u AS (SELECT {id_}, unnest(range(len(cs)))::INT AS chunk_id, unnest(cs) AS c FROM c)
SELECT {id_}, chunk_id, c.t AS text, (sum(length(c.t)) OVER w - length(c.t))::INT AS char_start, (sum(length(c.t)) OVER w)::INT AS char_end, c.n::INT AS n_sentences
FROM u WINDOW w AS (PARTITION BY {id_} ORDER BY chunk_id)"""


CHUNKS_PACK = _pack_sql(str(BUFFER))


def chunks_catalyst(spark: SparkSession, sf: str) -> DataFrame:
    """The same packing as one Catalyst expression; a cross-check of the kernel."""
    docs = table(spark, sf, "documents").select("doc_id", segment.packed(segment.sentences(F.col("text")), BUFFER).alias("cs"))
    return docs.select("doc_id", F.posexplode("cs").alias("chunk_id", "text"))


CHUNKS_CATALYST = f"SELECT doc_id, chunk_id, text FROM ({CHUNKS_PACK})"


def chunks_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines packed into chunks."""
    docs = table(spark, sf, "documents").select("doc_id", segment.packed(segment.lines(F.col("text")), 500).alias("cs"))
    return docs.select("doc_id", F.posexplode("cs").alias("chunk_id", "text"))


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i < len(string_split(text, chr(10))) THEN x || chr(10) ELSE x END), lambda x: x <> '')"
CHUNKS_LINES = f"SELECT doc_id, chunk_id, text FROM ({_pack_sql('500', _LINES)})"


def chunks_semantic(spark: SparkSession, sf: str) -> DataFrame:
    """About three chunks a document, 1000 characters at least."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(3).alias("n"))
    sized = docs.withColumn("_size", distribute.chunk_size(F.col("text"), F.col("n"), 1000))
    return segment.pack(sized, ["doc_id"], "text", "_size")


CHUNKS_SEMANTIC = _pack_sql("greatest(1000, length(text) // 3)")


def page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("page_no"))
    return distribute.page_ranges(turns, "conv_id", "page_no", 3)


PAGE_RANGES = """
WITH b AS (SELECT conv_id, turn + 1 AS page_no, ntile(3) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_id FROM conversations)
SELECT conv_id, chunk_id::INT AS chunk_id, min(page_no) AS page_lo, max(page_no) AS page_hi, count(*) AS n_pages FROM b GROUP BY ALL
"""


def page_ranges_compat(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("page_no"))
    return distribute.page_ranges(turns, "conv_id", "page_no", 3, compat=True)


PAGE_RANGES_COMPAT = """
WITH b AS (SELECT conv_id, turn + 1 AS page_no, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
c AS (SELECT conv_id, page_no, pos // greatest(n // 3, 1) AS chunk_id FROM b)
SELECT conv_id, chunk_id::INT AS chunk_id, min(page_no) AS page_lo, max(page_no) AS page_hi, count(*) AS n_pages FROM c WHERE chunk_id < 3 GROUP BY ALL
"""


def file_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each source as files, spread over seven chunks."""
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return distribute.spread(docs, "source", "doc_id", 7).groupBy("source", "chunk_id").agg(F.count("*").alias("n_files"), F.min("doc_id").alias("first_doc"), F.sum("n_chars").alias("chars"))


FILE_DISTRIBUTION = """
SELECT source, chunk_id::INT AS chunk_id, count(*) AS n_files, min(doc_id) AS first_doc, sum(n_chars)::BIGINT AS chars
FROM (SELECT *, ntile(7) OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_id FROM documents) GROUP BY ALL
"""

_EXTS = ["TXT", "md", "tar.gz", "PDF", "jpeg", "zip", "mp3", "mov", "docx", "weird", "xlsx", "json"]


def mime_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    exts = F.array(*[F.lit(e) for e in _EXTS])
    named = table(spark, sf, "pages").select("page_id", F.concat(F.lit("/in/x."), F.element_at(exts, (F.col("page_id") % len(_EXTS) + 1).cast("int"))).alias("path"))
    return mime.with_mime(named).select("page_id", "ext", "mime", "kind")


_KIND_SQL = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in v.split())}) THEN '{k}'" for k, v in mime.KINDS.items()) + " ELSE 'binary' END"
_MIME_SQL = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{mime.mime_of(e)}'" for v in mime.KINDS.values() for e in v.split()) + f" ELSE '{mime.UNKNOWN}' END"
MIME_DISPATCH = f"""
WITH e AS (SELECT page_id, lower(list_last(string_split(([{', '.join(repr(e) for e in _EXTS)}])[page_id % {len(_EXTS)} + 1], '.'))) AS ext FROM pages)
SELECT page_id, ext, {_MIME_SQL} AS mime, {_KIND_SQL} AS kind FROM e
"""


def wrap_payload(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return pages.select("page_id", mime.wrap_text(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")), F.lit("text/html"), F.col("html")).alias("payload"))


WRAP_PAYLOAD = "SELECT page_id, '=== FILE p' || page_id || '.html (text/html) ===' || chr(10) || html || chr(10) || '=== END OF p' || page_id || '.html ===' AS payload FROM pages"


def file_tokens(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("text", "pdf", "image", "binary")])
    pages = table(spark, sf, "pages").select("page_id", F.element_at(kinds, (F.col("page_id") % 4 + 1).cast("int")).alias("kind"), F.when(F.col("page_id") % 8 != 1, F.col("html")).alias("body"), F.octet_length("html").alias("size"), F.when(F.col("page_id") % 3 == 0, "claude-3-opus").otherwise("gpt-4o").alias("model"))
    return pages.select("page_id", "kind", "model", tokens.file_tokens(F.col("kind"), F.col("body"), F.col("size"), F.col("model")).alias("n_tokens"))


FILE_TOKENS = """
WITH p AS (SELECT page_id, (['text', 'pdf', 'image', 'binary'])[page_id % 4 + 1] AS kind, CASE WHEN page_id % 8 <> 1 THEN html END AS body, strlen(html) AS size, CASE WHEN page_id % 3 = 0 THEN 'claude-3-opus' ELSE 'gpt-4o' END AS model FROM pages)
SELECT page_id, kind, model, CASE WHEN kind IN ('text', 'pdf') THEN coalesce(length(body) // 4, size // 4) WHEN kind = 'image' THEN CASE WHEN model LIKE '%claude%' THEN 1600 ELSE 765 END ELSE size // 4 END AS n_tokens FROM p
"""

def chunks_newlines(spark: SparkSession, sf: str) -> DataFrame:
    """Long sentences are cut at their line feeds."""
    return segment.pack(table(spark, sf, "documents"), ["doc_id"], size=300, newlines=True)


CHUNKS_NEWLINES = _pack_lines_sql("300")


def chunks_lossy(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of the lossy form, packed."""
    return segment.pack(table(spark, sf, "documents"), ["doc_id"], size=BUFFER, lossy=True).select("doc_id", "chunk_id", "text", "n_sentences")


_LOSSY = r"""CASE WHEN regexp_matches(regexp_replace(text, '(?s)^.*[.!?](\s+|$)', ''), '\S') THEN list_append(regexp_extract_all(text, '([^.!?]*[.!?]+(?:\s+|$))', 1), regexp_replace(text, '(?s)^.*[.!?](\s+|$)', '')) ELSE regexp_extract_all(text, '([^.!?]*[.!?]+(?:\s+|$))', 1) END"""
CHUNKS_LOSSY = f"SELECT doc_id, chunk_id, text, n_sentences FROM ({_pack_sql(str(BUFFER), _LOSSY)})"


def token_estimate_array(spark: SparkSession, sf: str) -> DataFrame:
    """A root array is always cut, in two at least."""
    lit = lambda n: F.lit(n).cast("long")
    out = tokens.estimate(table(spark, sf, "documents").select("doc_id", "text"), tokens.count_tokens(F.col("text")), lit(300), lit(50), lit(0), F.lit("gpt-4"), array_schema=True)
    return out.select("doc_id", "total_tokens", "needs_chunking", "recommended_chunks")


TOKEN_ESTIMATE_ARRAY = """
WITH a AS (SELECT doc_id, length(text) // 4 AS n FROM documents)
SELECT doc_id, n + 1350 AS total_tokens, TRUE AS needs_chunking, CASE WHEN n + 1350 <= 2457 THEN 2 ELSE greatest(2, n // (2457 - 1350) + 1) END AS recommended_chunks FROM a
"""


def token_counter(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens by a counter of the caller's, here words."""
    words = lambda text: F.size(F.regexp_extract_all(text, F.lit(r"[^ \n]+"), F.lit(0)))
    return table(spark, sf, "documents").select("doc_id", tokens.count_tokens(F.col("text"), words).alias("n_tokens"))


TOKEN_COUNTER = "SELECT doc_id, len(regexp_extract_all(text, '[^ \n]+'))::BIGINT AS n_tokens FROM documents"

#: Kinds of files by document: text, PDF with a text layer, scanned PDF, and one of several files of a group.
_FILES = "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'm' || doc_id // 16 ELSE 'g' || doc_id END AS group_id, doc_id % 4 AS k, text, 'd' || doc_id || '.txt' AS path FROM documents"


def chunk_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Each group of files is cut by what it holds: sentences, pages or files."""
    d, k = table(spark, sf, "documents"), F.col("doc_id") % 4
    name = F.when(k == 3, F.concat(F.lit("m"), F.floor(F.col("doc_id") / 16).cast("string"))).otherwise(F.concat(F.lit("g"), F.col("doc_id").cast("string")))
    files = d.select(
        name.alias("group_id"), F.col("doc_id").alias("file_ord"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.when(k.isin(1, 2), "pdf").otherwise("text").alias("kind"),
        F.when(k == 1, "text_rich").when(k == 2, "scanned").alias("pdf_type"), "text",
    )
    pages = d.where(k == 2).select(name.alias("group_id"), F.col("doc_id").alias("file_ord"), F.posexplode(F.split("text", "\n", -1)).alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)
    out = distribute.chunk_documents(files, pages, "group_id", 2, least=1000)
    return out.select("group_id", "chunk_id", "chunk_type", F.length("text").alias("n_chars"), "page_lo", "page_hi", "n_files")


_SINGLE = f"(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS files FROM ({_FILES})) WHERE k <> 2 AND files = 1)"
CHUNK_DISPATCH = f"""
WITH many AS (SELECT *, ntile(2) OVER (PARTITION BY group_id ORDER BY doc_id) - 1 AS chunk FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS files FROM ({_FILES})) WHERE files > 1),
pages AS (SELECT group_id, unnest(string_split(text, chr(10))) AS page, generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM ({_FILES}) WHERE k = 2),
paged AS (SELECT *, ntile(2) OVER (PARTITION BY group_id ORDER BY page_no) - 1 AS chunk FROM pages)
SELECT group_id, chunk_id, 'semantic' AS chunk_type, length(text)::INT AS n_chars, NULL::INT AS page_lo, NULL::INT AS page_hi, 1 AS n_files FROM ({_pack_lines_sql("greatest(1000, length(text) // 2)", _SINGLE, "group_id")})
UNION ALL SELECT group_id, chunk::INT, 'multi_file', length(string_agg('=== FILE ' || path || ' (text/plain) ===' || chr(10) || text || chr(10) || '=== END OF ' || path || ' ===', chr(10) || chr(10)))::INT, NULL, NULL, count(*)::INT FROM many GROUP BY group_id, chunk
UNION ALL SELECT group_id, chunk::INT, 'page_based', coalesce(length(string_agg('--- PAGE ' || page_no || ' ---' || chr(10) || page, chr(10) || chr(10)) FILTER (WHERE regexp_matches(page, '\\S'))), 0)::INT, min(page_no)::INT, max(page_no)::INT, 1 FROM paged GROUP BY group_id, chunk
"""


def text_decoding(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes that are UTF-8 in half of the documents and Latin-1 in the others."""
    d = table(spark, sf, "documents")
    plain = F.regexp_replace("text", "[^\u0000-\u00ff]", "")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode(plain, "ISO-8859-1"))
    return d.select("doc_id", files.as_text(content).alias("text"))


TEXT_DECODING = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\\x{0000}-\\x{00ff}]', '', 'g') END AS text FROM documents"


def flatten_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of a group in order, and how many bytes its binary parts have."""
    d, k = table(spark, sf, "documents"), F.col("doc_id") % 4
    parts = d.select(F.floor(F.col("doc_id") / 4).alias("group_id"), k.cast("int").alias("file_ord"), F.lit(0).alias("member_ord"), F.lit("x/y").alias("mime"), F.when(k != 3, F.col("text")).alias("text"), F.when(k == 3, F.encode("text", "UTF-8")).alias("content"))
    out = files.flattened(parts, "group_id")
    return out.select("group_id", F.md5("text").alias("text_md5"), F.aggregate("payloads", F.lit(0), lambda n, p: n + F.octet_length(p["content"])).alias("n_bytes"))


FLATTEN_PARTS = """
SELECT doc_id // 4 AS group_id, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY doc_id) FILTER (WHERE doc_id % 4 <> 3), '')) AS text_md5, coalesce(sum(strlen(text)) FILTER (WHERE doc_id % 4 = 3), 0)::INT AS n_bytes
FROM documents GROUP BY 1
"""


def cell_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """Cell names, some of them wrong, to rows and columns."""
    k = F.col("p_partkey")
    letter = lambda n: F.char((F.lit(65) + n).cast("int"))
    name = F.when(k % 9 == 0, F.lit("?")).otherwise(F.concat(letter(k % 26), F.lower(letter(F.floor(k / 26) % 26)), (k % 500 + 1).cast("string")))
    place = files.cell_coordinates(name)
    return table(spark, sf, "part").select("p_partkey", place["row"].alias("row"), place["column"].alias("column"))


CELL_COORDINATES = """
SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE p_partkey % 500 + 1 END::INT AS row, CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 26 * (p_partkey % 26 + 1) + p_partkey // 26 % 26 + 1 END::INT AS "column" FROM part
"""

_MORE = (chunks_newlines, chunks_lossy, token_estimate_array, token_counter, chunk_dispatch, text_decoding, flatten_parts, cell_coordinates)
QUERIES = {f.__name__: f for f in _MORE} | {f.__name__: f for f in (token_estimate, file_tokens, sentences_token, sentences_regex, text_tokens, chunks_pack, chunks_catalyst, chunks_lines, chunks_semantic, page_ranges, page_ranges_compat, file_distribution, mime_dispatch, wrap_payload)}
SQL = {k: globals()[k.upper()] for k in QUERIES}
