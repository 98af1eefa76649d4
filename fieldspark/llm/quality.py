"""Operator 4, quality rules: cross-document line frequency.

Lines are normalised and hashed, the distinct documents that carry a line are counted on each host,
lines above the limits are removed, and documents of which too little is left are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.shared import col, read, small

#: A line is boilerplate of a host if more distinct documents than this carry it there ...
MIN_DOCS = 20
#: ... and more than this share of the host's distinct documents.
MIN_SHARE = 0.001
#: A document is rejected if less than this share of its characters (without white space) is left.
MIN_KEPT = 0.2
#: Up to so many boilerplate lines are sent to the executors (8 bytes each); more are joined instead.
BROADCAST_LINES = 2_000_000

_COUNTED = "host bigint, line bigint, doc bigint"
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _host(name: str | None) -> int:
    return 0 if name is None else _hash(name) | 1


def normalised(line: str) -> str:
    """Lower case, runs of white space as one blank, none at the ends."""
    return " ".join(line.lower().split())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key(host: int, line: int) -> int:
    return ((host * _GOLD) ^ line) & _MASK


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, line, doc) once for each distinct line of a document, and line 0 for the document itself."""
    for batch in small(batches):
        hosts, lines, docs = [], [], []
        for text, host in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text is None:
                continue
            h, d = _signed(_host(host)), _signed(_hash(text))
            found = {_signed(_hash(x)) for x in map(normalised, text.split("\n")) if x}
            found.add(0)
            lines.extend(found)
            hosts.extend([h] * len(found))
            docs.extend([d] * len(found))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hosts, lines, docs)], ["host", "line", "doc"])


def frequent_lines(df: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, line, docs): hashes of the lines above the limits and the distinct documents that carry them."""
    seen = df.select(col(text).cast("string"), col(host).cast("string")).mapInArrow(_count_lines, _COUNTED)
    counts = seen.distinct().groupBy("host", "line").agg(F.count("*").alias("docs")).where((F.col("docs") > min_docs) | (F.col("line") == 0))
    size = counts.where("line = 0").select("host", F.col("docs").alias("host_docs"))
    return counts.where("line <> 0").join(size, "host").where(F.col("docs") > F.col("host_docs") * min_share).select("host", "line", "docs")


def _cleaner(keys: object, min_kept: float, text_at: int, host_at: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(keys.value.tolist())
        for batch in small(batches):
            kept_rows, texts, totals, removed = [], [], [], []
            for row, (text, host) in enumerate(zip(batch.column(text_at).to_pylist(), batch.column(host_at).to_pylist())):
                if text is None:
                    continue
                h, lines = _host(host), text.split("\n")
                good, size, left = [], 0, 0
                for line in lines:
                    n = normalised(line)
                    chars = len(n) - n.count(" ")
                    size += chars
                    if not n or _key(h, _hash(n)) not in known:
                        good.append(line)
                        left += chars
                if left and left >= min_kept * size:
                    kept_rows.append(row)
                    texts.append("\n".join(good))
                    totals.append(len(lines))
                    removed.append(len(lines) - len(good))
            out = batch.take(pa.array(kept_rows, pa.int64()))
            columns = [pa.array(texts, pa.string()) if i == text_at else c for i, c in enumerate(out.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int32()), pa.array(removed, pa.int32())], [f"c{i}" for i in range(len(columns) + 2)])

    return clean


def quality_rules(df: DataFrame, text: str = "text", host: str = "source", n_chars: str | None = "n_chars", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_kept: float = MIN_KEPT, broadcast_lines: int = BROADCAST_LINES, report: bool = False) -> DataFrame:
    """df without boilerplate lines and without the documents that they deplete.

    A line counts as ``normalised`` leaves it; a line without signs is never boilerplate. Documents
    with the same text count once on a host, so copies of a document don't turn its lines into
    boilerplate. A line is removed where more than ``min_docs`` distinct documents of the host and more
    than ``min_share`` of them carry it. A document of which less than ``min_kept`` of the characters
    is left, or nothing, is rejected.

    Nulls: a null or blank text is rejected (nothing is left of it); null hosts form a host of their
    own. Very long texts are taken whole. Repeated rows: each is kept or rejected like the other. Ties: counts have none; limits are
    strict. An empty table gives an empty table. Other columns pass through, whatever their names.
    The column ``n_chars`` is set to the new length if df has it. ``report`` adds n_lines and n_removed.

    The frequent lines are sent to the executors as 64-bit hashes while they are at most
    ``broadcast_lines``; beyond that, documents are joined with them line by line. Both give the same.
    """
    frequent = frequent_lines(df, text, host, min_docs, min_share)
    sc = df.sparkSession.sparkContext
    found = frequent.select("host", "line").limit(broadcast_lines + 1).toArrow()
    if found.num_rows <= broadcast_lines:
        keys = (found.column("host").to_numpy().view(np.uint64) * np.uint64(_GOLD)) ^ found.column("line").to_numpy().view(np.uint64)
        out = _apply(df, text, host, sc.broadcast(keys), min_kept)
    else:
        out = _apply_joined(df, text, host, frequent, min_kept)
    names = [*df.columns, "n_lines", "n_removed"] if report else df.columns
    if n_chars is not None and n_chars in df.columns:
        kind = dict(df.dtypes)[n_chars]
        at = df.columns.index(n_chars)
        out = out.withColumn(f"c{at}", F.length(f"c{df.columns.index(text)}").cast(kind))
    return out.select([F.col(f"c{i}") for i in range(len(names))]).toDF(*names)


def _positional(df: DataFrame) -> tuple[DataFrame, str]:
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain, ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(plain.schema))


def _apply(df: DataFrame, text: str, host: str, keys: object, min_kept: float) -> DataFrame:
    plain, schema = _positional(df)
    t, h = df.columns.index(text), df.columns.index(host)
    return plain.mapInArrow(_cleaner(keys, min_kept, t, h), f"{schema}, c{len(df.columns)} int, c{len(df.columns) + 1} int")


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for text, host, row in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if text is not None:
                h = _signed(_host(host))
                for at, line in enumerate(text.split("\n")):
                    n = normalised(line)
                    out.append((row, at, h, _signed(_hash(n)) if n else 0, len(n) - n.count(" "), line))
        cols = list(zip(*out)) or [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["row", "at", "host", "line", "chars", "words"])


def _apply_joined(df: DataFrame, text: str, host: str, frequent: DataFrame, min_kept: float) -> DataFrame:
    """As _apply, by a join on (host, line), for more boilerplate than may be sent to each executor.

    The result of a row depends on its text and host only, so rows that share both share it.
    """
    plain, _ = _positional(df)
    t, h, n = df.columns.index(text), df.columns.index(host), len(df.columns)
    keyed = plain.withColumn("row", F.xxhash64(F.col(f"c{t}").cast("string"), F.col(f"c{h}").cast("string")))
    lines = keyed.select(F.col(f"c{t}").cast("string"), F.col(f"c{h}").cast("string"), "row").distinct().mapInArrow(_line_rows, "row bigint, at int, host bigint, line bigint, chars bigint, words string")
    bad = frequent.select("host", "line", F.lit(True).alias("bad"))
    marked = lines.join(bad, ["host", "line"], "left").withColumn("good", F.col("bad").isNull())
    sums = marked.groupBy("row").agg(
        F.sum("chars").alias("size"), F.sum(F.when(F.col("good"), F.col("chars")).otherwise(0)).alias("left"), F.count("*").cast("int").alias("total"), F.count_if(~F.col("good")).cast("int").alias("gone"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("at", "words")))), lambda x: x["words"]), "\n").alias("clean"),
    ).where((F.col("left") > 0) & (F.col("left") >= F.col("size") * min_kept))
    out = keyed.join(sums, "row")
    return out.select(*[F.col("clean").alias(f"c{i}") if i == t else F.col(f"c{i}") for i in range(n)], F.col("total").alias(f"c{n}"), F.col("gone").alias(f"c{n + 1}"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pass, with their clean text and the lines that went."""
    return quality_rules(read(spark, sf_dir, "documents"), report=True)


#: The same by DuckDB. Java, Python and DuckDB agree on lower case and white space for these tables.
SQL = f"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), normal AS (SELECT *, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS n FROM lines),
counts AS (SELECT source, n, count(DISTINCT text) AS docs FROM normal WHERE n <> '' GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT text) AS host_docs FROM documents GROUP BY ALL),
bad AS (SELECT source, n FROM counts JOIN hosts USING (source) WHERE docs > {MIN_DOCS} AND docs > host_docs * {MIN_SHARE}),
marked AS (SELECT m.*, length(replace(m.n, ' ', '')) AS chars, b.n IS NULL AS good FROM normal m LEFT JOIN bad b ON m.source = b.source AND m.n = b.n),
sums AS (
  SELECT doc_id, sum(chars) AS size, coalesce(sum(chars) FILTER (WHERE good), 0) AS kept, count(*) AS total, count(*) FILTER (WHERE NOT good) AS gone,
    string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE good) AS clean FROM marked GROUP BY doc_id
)
SELECT d.doc_id, s.clean AS text, d.lang, d.source, length(s.clean) AS n_chars, s.total::INT AS n_lines, s.gone::INT AS n_removed
FROM documents d JOIN sums s USING (doc_id) WHERE s.kept > 0 AND s.kept >= s.size * {MIN_KEPT}
"""
