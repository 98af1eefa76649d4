"""Operator 8, SimHash near-dedup with a segment-popcount embedding.

A document's 192-bit fingerprint is cut into segments, and each segment is mapped to its bit count. The
Manhattan distance of two such vectors is never above the Hamming distance of the fingerprints; with
segments of one bit, as in the join, it is equal to it. Wider segments lose bits, so that a search over
them is either incomplete or compares nearly all pairs. The segments are taken in 16 groups of 12: of two
fingerprints at most 30 bits apart the counts differ by at most 1 in one of the first 15 groups, or not at
all in the last, as they would be 31 apart otherwise. A grid range-join finds the pairs that do so, group by
group, and each is then verified by its exact Hamming distance. So every pair is found. Components of the
verified pairs are the groups of copies.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.shared import LOWER, as_bytes, checkpointed, col, components, groups_of, joined, local_roots, mix, ragged, read, slices, small, span_hashes, word_spans

WORDS64 = 3
BITS = 64 * WORDS64
#: Fingerprints at most so many bits apart are copies (15.6 % of the bits).
MAX_DISTANCE = 30
#: Bits of a segment in the join.
SEGMENT_BITS = 1
#: Neighbouring groups whose bits are compared before whole fingerprints are.
SPAN = 4
#: A cell is its group's number from this bit on, and below it the group's counts, or a hash if the cell is split.
CELL_BITS = 50
#: Fingerprints at home in a cell that one task compares with each other; larger cells are split into blocks.
BLOCK = 20_000
#: Rows of a tile in which pairs are compared.
TILE = 1024
#: Pairs of a cell that are held before a star for each of their components replaces them.
HELD_PAIRS = 1 << 20

#: Four 16-bit counters in a 64-bit value, one for each bit of a nibble.
_SPREAD = np.array([sum(((n >> i) & 1) << (16 * i) for i in range(4)) for n in range(16)], np.uint64)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """(n, WORDS64) fingerprints: each bit is the majority over the distinct words of a text.

    Words are runs without white space, ASCII letters in lower case. A text without words has zeros.
    """
    out = np.zeros((len(texts), WORDS64), np.uint64)
    for i, j in slices(texts):
        buf, begin, end = joined(texts[i:j])
        buf = LOWER[buf]
        starts, ends = word_spans(buf)
        if not len(starts):
            continue
        h = span_hashes(buf, starts, ends)
        doc = np.searchsorted(end, starts, side="right")
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size = np.diff(np.r_[first, len(doc)])
        # 16-bit counters hold 65535 words: longer documents are summed in parts
        cuts = np.unique(np.concatenate([first, *[np.arange(f + 60_000, f + n, 60_000) for f, n in zip(first, size) if n > 60_000]]))
        part_doc = np.searchsorted(first, cuts, side="right") - 1
        for w in range(WORDS64):
            bits = mix(h + np.uint64((w + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            word = np.zeros(len(first), np.uint64)
            for nibble in range(16):
                sums = np.add.reduceat(_SPREAD[((bits >> np.uint64(4 * nibble)) & np.uint64(15)).astype(np.intp)], cuts)
                for b in range(4):
                    counts = ((sums >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                    if len(cuts) != len(first):
                        counts = np.bincount(part_doc, counts, len(first)).astype(np.int64)
                    word |= (2 * counts > size).astype(np.uint64) << np.uint64(4 * nibble + b)
            out[i + doc[first], w] = word
    return out


def has_words(texts: list[bytes]) -> np.ndarray:
    return np.fromiter((bool(t.split()) for t in texts), bool, len(texts))


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        texts = as_bytes(batch.column(0))
        some = has_words(texts)
        f = fingerprints(texts).view(np.int64)
        out = pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *[pa.array(np.ascontiguousarray(f[:, w])) for w in range(WORDS64)]], ["doc", "body", "f0", "f1", "f2"])
        yield out.filter(pa.array(some))


def segment_counts(f: np.ndarray, width: int = 4) -> np.ndarray:
    """(n, BITS / width) bit counts of the segments of so many bits."""
    bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1, bitorder="little")
    return bits if width == 1 else bits.reshape(len(f), -1, width).sum(axis=2, dtype=np.uint8)


def grouping(most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The segments of each group and its radius, 1 or 0: fingerprints at most so many bits apart are within the radius of some group.

    The radii plus 1 add up to ``most`` + 1; so fingerprints beyond the radius of every group are further apart than ``most``.
    """
    most = min(most, BITS)
    groups = np.array_split(np.arange(BITS // SEGMENT_BITS), most // 2 + 1)
    return groups, (np.arange(len(groups)) < most + 1 - len(groups)).astype(np.int64)


def _places(f: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each group the counts of each fingerprint, its cell, and what a count adds to the cell's name.

    Groups of over 40 segments share names between cells, which adds pairs to verify and loses none.
    """
    counts = segment_counts(f, SEGMENT_BITS)
    for number, group in enumerate(grouping(most)[0]):
        place = (SEGMENT_BITS + 1) ** (np.arange(len(group)) % 40)
        own = counts[:, group]
        yield own, (number << CELL_BITS) + own.astype(np.int64) @ place, place


def _windows(cell: np.ndarray, f: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row up to 64 bits around its cell's group, and how far apart those of a pair may be.

    Pairs within ``most`` are, in some SPAN of groups, within the sum of the radii plus 1, less 1, and then within the radius of one of these groups.
    """
    groups, radii = grouping(most)
    spans = [range(i, min(i + SPAN, len(groups))) for i in range(0, len(groups), SPAN)]
    begin = np.array([groups[s[0]][0] for s in spans]) * SEGMENT_BITS
    size = np.array([min(64, sum(len(groups[g]) for g in s) * SEGMENT_BITS) for s in spans])
    near = np.array([sum(radii[g] + 1 for g in s) - 1 for s in spans])
    at = (cell >> CELL_BITS) // SPAN
    word, off, row = begin[at] // 64, (begin[at] % 64).astype(np.uint64), np.arange(len(f))
    above = np.where(word + 1 < WORDS64, f[row, np.minimum(word + 1, WORDS64 - 1)], np.uint64(0))
    bits = f[row, word] >> off | above << np.uint64(1) << (np.uint64(63) - off)
    return bits & (np.uint64(2**64 - 1) >> (64 - size).astype(np.uint64))[at], near[at]


def _home_counts(most: int):
    def home_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cell, n) of each batch."""
        for batch in batches:
            f = np.stack([batch.column(w).to_numpy() for w in range(WORDS64)], axis=1)
            cell, n = np.unique(np.concatenate([home for _, home, _ in _places(f, most)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    return home_counts


def _split(rows: pa.RecordBatch, large: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Rows of large cells in every cell of two blocks that holds their own; others as they are."""
    cells, blocks = large
    cell = rows.column(0).to_numpy()
    if not len(cells):
        return rows
    at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
    times = np.where(cells[at] == cell, blocks[at], 1)
    if (times == 1).all():
        return rows
    out = rows.take(pa.array(np.repeat(np.arange(len(cell)), times)))
    other, many = ragged(times), np.repeat(times, times)
    own = (mix(out.column(2).to_numpy().view(np.uint64)) % many.astype(np.uint64)).astype(np.int64)
    pair = (np.minimum(own, other) << 31 | np.maximum(own, other)).astype(np.uint64)
    whole = out.column(0).to_numpy()
    name = (mix(mix(whole.view(np.uint64)) ^ pair) >> np.uint64(64 - CELL_BITS)).view(np.int64)
    now = np.where(many > 1, whole >> CELL_BITS << CELL_BITS | name | 1 << CELL_BITS - 1, whole)  # the bit is not set in other cells
    return pa.RecordBatch.from_arrays([pa.array(now), *out.columns[1:]], out.schema.names)


def _cells(most: int, large: object):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each fingerprint in its own cell of each group, and as a probe in the cells one count below if the radius is 1."""
        names, radii = ["cell", "probe", "id", "f0", "f1", "f2"], grouping(most)[1]
        for batch in batches:
            f = np.stack([batch.column(1 + w).to_numpy() for w in range(WORDS64)], axis=1)
            for (own, home, place), radius in zip(_places(f, most), radii):
                yield _split(pa.RecordBatch.from_arrays([pa.array(home), pa.array(np.zeros(len(f), bool)), *batch.columns], names), large.value)
                if radius:
                    row, segment = np.nonzero(own)
                    cell = pa.array(home[row] - place[segment])
                    yield _split(pa.RecordBatch.from_arrays([cell, pa.array(np.ones(len(row), bool)), *batch.take(pa.array(row)).columns], names), large.value)

    return cells


def close_pairs(f: np.ndarray, window: np.ndarray, homes: int, near: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at most so many bits apart of a home with a later home or a probe, or as many with the same components.

    The first ``homes`` rows are homes; only pairs whose windows are at most ``near`` apart are looked at.
    """
    left, right, held = [], [], 0
    for i in range(0, homes, TILE):
        a = window[i : min(homes, i + TILE)]
        for j in range(i, len(f), 4 * TILE):
            b = window[j : j + 4 * TILE]
            x, y = np.divmod(np.flatnonzero(np.bitwise_count(a[:, None] ^ b[None]) <= near), len(b))
            x, y = x + i, y + j
            keep = y > x
            x, y = x[keep], y[keep]
            d = np.zeros(len(x), np.uint8)
            for w in range(WORDS64):
                d += np.bitwise_count(f[x, w] ^ f[y, w])
            keep = d <= most
            left.append(x[keep])
            right.append(y[keep])
            held += len(left[-1])
            if held > HELD_PAIRS:
                root = local_roots(len(f), np.concatenate(left), np.concatenate(right))
                moved = np.flatnonzero(root != np.arange(len(f)))
                left, right, held = [root[moved]], [moved], 0
    return np.concatenate(left), np.concatenate(right)


def _pairs(most: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Verified pairs of each cell, as a star for each of their local components: that keeps components whole."""
        for table in groups_of(batches, "cell"):
            for a, b in _cell_edges(table, most):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return pairs


def _cell_edges(table: pa.Table, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    cell = table.column("cell").to_numpy()
    probe = table.column("probe").to_numpy(zero_copy_only=False)
    ids = table.column("id").to_numpy()
    f = np.stack([table.column(f"f{w}").to_numpy() for w in range(WORDS64)], axis=1).view(np.uint64)
    window, near = _windows(cell, f, most)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    for i, j in itertools.pairwise([*first.tolist(), len(cell)]):
        homes = j - i - int(probe[i:j].sum())
        if not homes or j - i < 2:
            continue
        order = i + np.argsort(probe[i:j], kind="stable")
        x, y = close_pairs(f[order], window[order], homes, int(near[i]), most)
        if len(x):
            root = local_roots(j - i, x, y)
            moved = np.flatnonzero(root != np.arange(j - i))
            own = ids[order]
            yield own[moved], own[root[moved]]


def near_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", max_distance: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """(doc, body, keep_doc, keep_body): the documents to remove and the one of their group that stays.

    The sizes of crowded cells only come to the driver; a cell with more than ``block`` fingerprints is split into
    blocks, of which every two make a cell, and the result is the same.
    """
    docs = df.select(col(text).cast("string").alias("text"), col(doc_id).cast("bigint").alias("doc"), F.xxhash64(col(text).cast("string")).alias("body"))
    prints = checkpointed(docs.mapInArrow(_fingerprint_rows, "doc bigint, body bigint, f0 bigint, f1 bigint, f2 bigint"))
    name = F.xxhash64("f0", "f1", "f2")
    nodes = prints.groupBy("f0", "f1", "f2").agg(F.min(F.struct("doc", "body")).alias("least"), F.max(F.struct("doc", "body")).alias("most"))
    slim = nodes.select(name.alias("id"), "f0", "f1", "f2")
    sizes = slim.select("f0", "f1", "f2").mapInArrow(_home_counts(max_distance), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    crowded = sizes.where(F.col("n") > block).orderBy("cell").toArrow()
    large = df.sparkSession.sparkContext.broadcast((crowded.column("cell").to_numpy(), -(-crowded.column("n").to_numpy() // block)))
    cells = slim.mapInArrow(_cells(max_distance, large), "cell bigint, probe boolean, id bigint, f0 bigint, f1 bigint, f2 bigint")
    edges = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_pairs(max_distance), "a bigint, b bigint")
    roots = components(edges)
    # a lone fingerprint matters only where several documents share it
    placed = nodes.select(name.alias("id"), "f0", "f1", "f2", "least", "most").join(roots.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.where(F.col("root").isNotNull() | (F.col("least") != F.col("most"))).select("f0", "f1", "f2", "least", F.coalesce("root", "id").alias("root"))
    keep = placed.groupBy("root").agg(F.min("least").alias("keep"))
    member = placed.join(keep, "root").select("f0", "f1", "f2", "keep")
    out = prints.join(member, ["f0", "f1", "f2"]).select("doc", "body", F.col("keep.doc").alias("keep_doc"), F.col("keep.body").alias("keep_body"))
    return out.where(~(F.col("doc").eqNullSafe(F.col("keep_doc")) & (F.col("body") == F.col("keep_body")))).distinct()


def near_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """df with one document of each group of near copies: that with the least (doc_id, text hash), null ids first.

    Two documents are near copies if their fingerprints differ in at most ``max_distance`` of 192 bits;
    groups are the components of that relation. The range-join finds every such pair, or others that
    connect the two, and never reports a pair that is further apart.

    Nulls: a null or blank text has no fingerprint and always stays. Rows that repeat both id and text
    are one document: they stay or go together. Rows that share an id but not a text are two documents.
    Very long texts are taken whole.
    Ties: equal fingerprints are distance 0; the least id stays. An empty table gives an empty table.
    Other columns pass through, whatever their names.
    """
    gone = near_groups(df, text, doc_id, max_distance).select("doc", "body").distinct()
    names, n = df.columns, len(df.columns)
    t, d = names.index(text), names.index(doc_id)
    plain = df.toDF(*[f"c{i}" for i in range(n)])
    same = F.col(f"c{d}").cast("bigint").eqNullSafe(F.col("doc")) & (F.xxhash64(F.col(f"c{t}").cast("string")) == F.col("body"))
    return plain.join(gone.hint("shuffle_hash"), same, "left_anti").toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, copy_of): every document that goes, and the one of its group that stays."""
    return near_groups(read(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), F.col("keep_doc").alias("copy_of"))
