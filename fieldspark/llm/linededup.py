"""Operator 1, line dedup: winnowing over line hashes.

Of each window of line hashes the least k-gram is a fingerprint (Schleimer et al. 2003), so any two equal runs
of ``min_run`` lines share one at the same place. Positions are joined with the fingerprints that occur more than
once, each match is extended to both sides over the runs that chose the fingerprint, and runs that were met
earlier are deleted. Shorter runs of long lines are their own fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.shared import as_bytes, checkpointed, col, joined, mix, read, sequence_hashes, signed, slices, sliding_least, small, span_hashes

#: Repeated runs of at least so many lines are deleted ...
MIN_RUN = 3
#: ... and shorter ones that have so many characters, line ends left out.
MIN_CHARS = 300
#: Bytes of text whose lines a task hashes at once.
PIECE_BYTES = 1 << 18
#: Lines in a fingerprint.
GRAM = 2

_PRINTS = "print bigint, doc bigint, body bigint, lines int, size int, at int, runs array<bigint>"


def line_runs(texts: list[bytes], min_run: int, min_chars: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each size of run: text, its lines, size, line of the first run, fingerprint, runs that follow each other there, and their hashes.

    Runs of ``min_run`` lines that choose the same fingerprint come together.
    """
    buf, _, end = joined(texts)
    breaks = np.r_[np.flatnonzero(buf == 10), len(buf)]
    starts = np.r_[0, breaks[:-1] + 1]
    hashes = span_hashes(buf, starts, breaks)
    of = np.searchsorted(end, starts)
    count = np.bincount(of, minlength=len(texts))
    opens = np.cumsum(count) - count
    chars = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
    total = np.r_[0, np.cumsum(chars[breaks] - chars[starts])]
    for size in range(1, min_run + 1):
        n = max(len(of) - size + 1, 0)
        first = np.flatnonzero(of[:n] == of[size - 1 : size - 1 + n])
        if size < min_run:
            first = first[total[first + size] - total[first] >= min_chars]
        runs = mix(sequence_hashes(hashes, first, first + size) ^ np.uint64(size))
        prints, where = runs, np.arange(len(first))
        if size == min_run:
            edge = np.arange(len(hashes))
            grams = sequence_hashes(hashes, edge, np.minimum(edge + gram, len(hashes)))
            at = sliding_least(grams, min_run - gram + 1, first)
            where = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
            prints = grams[at[where]]
        text = of[first[where]]
        yield text, count[text], np.full(len(where), size), first[where] - opens[text], prints, np.diff(np.r_[where, len(first)]), runs


def _winnow(min_run: int, min_chars: int, gram: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            raw = as_bytes(batch.column(0))
            for i, j in slices(raw, PIECE_BYTES):
                for text, lines, size, at, own, follow, runs in line_runs(raw[i:j], min_run, min_chars, gram):
                    rest = batch.slice(i, j - i).take(pa.array(text))
                    numbers = [pa.array(x.astype(np.int32)) for x in (lines, size, at)]
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(follow)].astype(np.int32)), signed(runs))
                    yield pa.RecordBatch.from_arrays([signed(own), rest.column(1), rest.column(2), *numbers, lists], ["print", "doc", "body", "lines", "size", "at", "runs"])

    return prints


def repeated_runs(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_run: int = MIN_RUN, min_chars: int = MIN_CHARS, gram: int = GRAM) -> DataFrame:
    """(doc, body, lines, kept): of each document with later repeated runs, the line numbers that stay.

    Both aggregates combine before they shuffle, so a header that millions of documents carry is one row of each
    task; the joins back are on rows, which Spark can split where a key is hot.
    """
    docs = df.select(col(text).cast("string"), col(doc_id).cast("bigint"), F.xxhash64(col(text).cast("string"))).where(col(text).isNotNull())
    prints = checkpointed(docs.mapInArrow(_winnow(min_run, min_chars, min(gram, min_run)), _PRINTS))
    several = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print")
    near = prints.join(several, "print", "left_semi").select("doc", "body", "lines", "size", "at", F.posexplode("runs").alias("more", "run"))
    near = near.select("doc", "body", "lines", "size", (F.col("at") + F.col("more")).alias("at"), "run")
    place = F.struct("doc", "body", "at")
    least = near.groupBy("run").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least <> most").select("run", "least")
    later = near.join(least, "run").where(~place.eqNullSafe(F.col("least")))
    runs = later.groupBy("doc", "body").agg(F.max("lines").alias("lines"), F.collect_set(F.struct("at", "size")).alias("starts"))
    gone = F.flatten(F.transform("starts", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))
    return runs.select("doc", "body", "lines", F.array_except(F.sequence(F.lit(0), F.col("lines") - 1), gone).alias("kept"))


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n_chars: str | None = "n_chars", min_run: int = MIN_RUN, min_chars: int = MIN_CHARS, gram: int = GRAM, report: bool = False) -> DataFrame:
    """df without the runs of lines that stand earlier in the corpus.

    A run counts if it has ``min_run`` lines at least, or fewer that have ``min_chars`` characters (code points,
    line ends left out). A line goes exactly if it lies in such a run that isn't the run's first occurrence, be
    it in the same document or another. Order is by (doc_id, text hash, line), null ids first. Lines are
    compared as they are, by 64-bit hashes. A document that loses every line is dropped.

    Nulls: a null text passes through. Empty texts have one empty line and pass. Very long texts are taken
    whole. Rows that repeat both id and text are one document: they are not repeats of each other and lose the
    same lines. Rows that share an id but not a text are two documents. Ties can't occur otherwise. An empty
    table gives an empty table. Other columns pass through, whatever their names. n_chars is set anew where
    lines went. ``report`` adds n_lines and n_removed.
    """
    runs = repeated_runs(df, text, doc_id, min_run, min_chars, gram)
    names, n = df.columns, len(df.columns)
    t, d = names.index(text), names.index(doc_id)
    plain = df.toDF(*[f"c{i}" for i in range(n)])
    left = plain.select(*[F.split(F.col(f"c{i}").cast("string"), "\n", -1).alias("all") if i == t else F.col(f"c{i}") for i in range(n)], F.xxhash64(F.col(f"c{t}").cast("string")).alias("hash"))
    both = left.join(runs.hint("shuffle_hash"), F.col(f"c{d}").cast("bigint").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("body")), "left")
    both = both.where(F.col("kept").isNull() | (F.size("kept") > 0))
    new = F.when(F.col("kept").isNull(), F.array_join("all", "\n")).otherwise(F.array_join(F.transform("kept", lambda i: F.element_at("all", i + 1)), "\n"))
    both = both.withColumn(f"c{t}", new)
    at = names.index(n_chars) if n_chars in names else -1
    columns = [F.when(F.col("kept").isNull(), F.col(f"c{i}")).otherwise(F.length(f"c{t}").cast(df.schema[i].dataType)) if i == at else F.col(f"c{i}") for i in range(n)]
    if report:
        total = F.size("all")
        columns += [F.when(total >= 0, total), F.coalesce(total - F.size("kept"), F.lit(0))]
        names = [*names, "n_lines", "n_removed"]
    return both.select(*[c.alias(f"r{i}") for i, c in enumerate(columns)]).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its later repeated runs."""
    return dedup_lines(read(spark, sf_dir, "documents"), report=True)


SQL = f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
places AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split),
runs AS (
  SELECT doc_id, i, 3 AS size, md5(ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2]) AS run FROM places WHERE i + 2 <= len(ls)
  UNION ALL SELECT doc_id, i, 2, md5(ls[i] || chr(10) || ls[i + 1]) FROM places WHERE i + 1 <= len(ls) AND length(ls[i]) + length(ls[i + 1]) >= {MIN_CHARS}
  UNION ALL SELECT doc_id, i, 1, md5(ls[i]) FROM places WHERE length(ls[i]) >= {MIN_CHARS}
),
later AS (SELECT doc_id, i, size FROM (SELECT *, row_number() OVER (PARTITION BY size, run ORDER BY doc_id, i) AS nth FROM runs) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS i FROM later),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, k.text, d.lang, d.source, length(k.text) AS n_chars, k.n_lines::INT AS n_lines, k.n_removed::INT AS n_removed
FROM documents d JOIN kept k USING (doc_id) WHERE k.n_removed < k.n_lines
"""
