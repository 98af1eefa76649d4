"""Operator 6, substring dedup: paragraph MinHash banding.

Paragraphs are cut at content, not at line ends: of each stretch of word triples the least one is an anchor
(winnowing), and a paragraph is a fixed number of words from an anchor on. So a repeated passage holds the same
paragraphs wherever it stands. Paragraphs that share their anchor and two of their MinHashes collide and fall into one
bucket, with those that they are linked to by such collisions. There the exact Jaccard similarity of their triples
is verified, and the components of verified pairs are classes of which the first document's paragraphs stay.

The text is read twice. The first scan sends a short record for each paragraph to the part of its anchor, where
collisions are found; the second fetches places, neighbouring words and triples of those paragraphs only that
collided. Paragraphs that overlap make up a passage, which is reported if it is long enough.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.llm.shared import LOWER, Recent, as_bytes, blocked, checkpointed, col, components, groups_of, joined, local_roots, mix, ragged, read, sequence_hashes, signed, slices, sliding_least, span_hashes, word_spans

#: A verbatim passage of so many words is always found, and a shorter one isn't reported.
MIN_WORDS = 51
#: Words of a paragraph.
WINDOW = 37
#: Words in a shingle.
SHINGLE = 3
#: Paragraphs at least so similar (Jaccard, of their sets of shingles) are copies.
MIN_JACCARD = 0.7
#: Of so many MinHashes, two that agree (besides the anchor) make a collision; see ``recall``.
HASHES = 6
#: Up to so many collided paragraphs are named to the executors (8 bytes each); more are joined instead.
BROADCAST_IDS = 4_000_000
#: Members of a bucket that one task verifies at once; larger buckets are split into blocks.
BLOCK = 20_000
#: Bytes of text, and texts, whose paragraphs a task holds at once.
PIECE_BYTES, PIECE_ROWS = 1 << 18, 256

_FACTORS = np.random.default_rng(61).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1


def recall(jaccard: float, hashes: int = HASHES) -> float:
    """The chance that paragraphs with the same anchor and that similarity collide: two hashes at least agree."""
    return 1 - sum(math.comb(hashes, k) * jaccard**k * (1 - jaccard) ** (hashes - k) for k in (0, 1))


def _record(hashes: int) -> np.dtype:
    """What is sent of a paragraph: 4 bytes of its anchor, its hash, 2 bytes of each MinHash, whether several texts hold it."""
    return np.dtype([("anchor", "<u4"), ("key", "<u8"), ("least", "<u2", (hashes,)), ("many", "u1")])


def anchors(grams: np.ndarray, text: np.ndarray, stretch: int, shingle: int, window: int) -> np.ndarray:
    """Words at which paragraphs begin: the last least gram of every ``stretch`` grams in a row that lie in one text."""
    reach = stretch + shingle - 1
    if len(grams) < max(reach, window):
        return np.zeros(0, np.int64)
    base = np.flatnonzero(text[: len(text) - reach + 1] == text[reach - 1 :])
    at = np.unique(sliding_least(grams, stretch, base))
    at = at[at + window <= len(grams)]
    return at[text[at] == text[at + window - 1]]


class Paragraphs:
    """The paragraphs of some texts: row of the text, first word in it, hash of the words, anchor; ``words`` counts those of each text."""

    def __init__(self, texts: list[bytes], min_words: int, window: int, shingle: int):
        buf, _, end = joined(texts)
        starts, ends = word_spans(buf)
        words = span_hashes(LOWER[buf], starts, ends)
        of = np.searchsorted(end, starts, side="right")
        self.words = np.bincount(of, minlength=len(texts))
        edge = np.arange(len(starts))
        self.short = words.astype(np.uint16)
        self.grams = sequence_hashes(words, edge, np.minimum(edge + shingle, len(starts)))
        self.at = anchors(self.grams, of, min_words - window + 1, shingle, window)
        self.row = of[self.at]
        self.begin = self.at - (np.cumsum(self.words) - self.words)[self.row]
        self.key = sequence_hashes(words, self.at, self.at + window)
        self.anchor = self.grams[self.at]
        self.window, self.width = window, window - shingle + 1

    def around(self, which: np.ndarray, most: int) -> np.ndarray:
        """(n, 2 + 4 most) bytes: how many words stand before and after some paragraphs in their texts, ``most`` at most, and 2 bytes of each."""
        at = self.at[which]
        before = np.minimum(self.begin[which], most)
        after = np.minimum(self.words[self.row[which]] - self.begin[which] - self.window, most)
        places = np.concatenate([at[:, None] + np.arange(-most, 0), at[:, None] + self.window + np.arange(most)], axis=1)
        near = self.short[np.clip(places, 0, len(self.short) - 1)]
        return np.concatenate([np.stack([before, after], axis=1).astype(np.uint8), near.view(np.uint8)], axis=1)

    def sets(self, which: np.ndarray) -> np.ndarray:
        """(n, width) 32-bit hashes of the shingles of some paragraphs."""
        return self.grams[self.at[which][:, None] + np.arange(self.width)].astype(np.uint32)

    def least(self, which: np.ndarray, hashes: int) -> np.ndarray:
        """(n, hashes) 16 bits of the MinHashes of some paragraphs."""
        out = np.empty((len(which), hashes), np.uint16)
        for i in range(0, len(which), 4096):
            own = self.grams[self.at[which[i : i + 4096]][:, None] + np.arange(self.width)]
            for k in range(hashes):
                out[i : i + 4096, k] = mix((own * _FACTORS[k]).min(axis=1)).astype(np.uint16)
        return out


def _cut(batches: Iterator[pa.RecordBatch], how: tuple) -> Iterator[tuple[Paragraphs, np.ndarray]]:
    """The paragraphs of each slice of (text, body), and the bodies of its texts; a text that was met shortly before is left out."""
    met = Recent(16)
    for batch in batches:
        body = batch.column(1).to_numpy().view(np.uint64)
        _, one = np.unique(body, return_index=True)
        one = np.sort(one)
        one = one[met.new(body[one])]
        for k in range(0, len(one), PIECE_ROWS):
            some = one[k : k + PIECE_ROWS]
            raw = as_bytes(batch.column(0).take(pa.array(some)))
            for i, j in slices(raw, PIECE_BYTES):
                yield Paragraphs(raw[i:j], *how), body[some[i:j]]


def _banded(how: tuple, hashes: int, parts: int):
    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, records) of the paragraphs by the part of their anchor.

        Each goes once for a slice of text, and twice in a task if it isn't forgotten in between: that is enough to
        know that several texts hold it, however many do.
        """
        once, twice = Recent(20), Recent(18)
        for p, _ in _cut(batches, how):
            key, one, which = np.unique(p.key, return_index=True, return_inverse=True)
            low, high = np.full(len(key), len(p.words)), np.zeros(len(key), np.int64)
            np.minimum.at(low, which, p.row)
            np.maximum.at(high, which, p.row)
            goes = once.new(key)
            goes[~goes] = twice.new(key[~goes])
            at = one[goes]
            out = np.empty(len(at), _record(hashes))
            spread = mix(p.anchor[at])
            out["anchor"], out["key"], out["least"], out["many"] = spread, key[goes], p.least(at, hashes), (low < high)[goes]
            part = (spread >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            part, out = part[order], out[order]
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
            blobs = [(int(part[x]), out[x:y].tobytes()) for x, y in itertools.pairwise([*first.tolist(), len(part)])]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], ["part", "records"])

    return banded


def _linked(rows: np.ndarray, hashes: int) -> np.ndarray:
    """For records of distinct paragraphs the first of those that they are linked to by collisions, maybe over others.

    Two collide if they share the anchor and two MinHashes.
    """
    base = mix(rows["anchor"].astype(np.uint64))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in itertools.combinations(range(hashes), 2):
        band = base ^ (rows["least"][:, i].astype(np.uint64) << np.uint64(16) | rows["least"][:, j])
        order = np.argsort(band, kind="stable")
        same = np.flatnonzero(band[order[1:]] == band[order[:-1]])
        a.append(order[same])
        b.append(order[same + 1])
    return local_roots(len(rows), np.concatenate(a), np.concatenate(b))


def _collisions(hashes: int):
    def collisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, bucket) of the paragraphs that several texts hold, or that collide with others: those have a bucket, and only one."""
        for table in groups_of(batches, "part"):
            part, blobs = table.column("part").to_numpy(), table.column("records").to_pylist()
            for x, y in itertools.pairwise([*np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist(), len(part)]):
                rows = np.frombuffer(b"".join(blobs[x:y]), _record(hashes))
                if not len(rows):
                    continue
                rows = rows[np.lexsort((rows["key"], rows["anchor"]))]
                first = np.flatnonzero(np.r_[True, (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["key"][1:] != rows["key"][:-1])])
                met = (np.diff(np.r_[first, len(rows)]) > 1) | np.maximum.reduceat(rows["many"], first).astype(bool)
                rows = rows[first]
                alone = np.r_[True, rows["anchor"][1:] != rows["anchor"][:-1], True]
                crowd = np.flatnonzero(~(alone[1:] & alone[:-1]))
                bucket, root = np.zeros(len(rows), np.uint64), _linked(rows[crowd], hashes)
                several = np.bincount(root, minlength=len(crowd))[root] > 1
                near = np.zeros(len(rows), bool)
                near[crowd[several]] = True
                bucket[crowd[several]] = rows["key"][crowd[root[several]]]
                at = np.flatnonzero(met | near)
                yield pa.RecordBatch.from_arrays([signed(np.ascontiguousarray(rows["key"][at])), pa.array(bucket[at].view(np.int64), mask=~near[at])], ["key", "bucket"])

    return collisions


def _wanted(keys: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which keys are among the names, which are sorted."""
    if not len(names):
        return np.zeros(len(keys), bool)
    return names[np.minimum(np.searchsorted(names, keys), len(names) - 1)] == keys


def _places(how: tuple, wanted: object | None, near: object | None):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, body, begin, around, shingles): where the wanted paragraphs stand, and the sets of those that are to be compared.

        A row without a key tells the number of words of a text.
        """
        told = Recent(20)
        for p, body in _cut(batches, how):
            key = p.key.view(np.int64)
            at = np.arange(len(key)) if wanted is None else np.flatnonzero(_wanted(key, wanted.value))
            sets: list[bytes | None] = [None] * len(at)
            if near is not None:
                _, one = np.unique(key[at], return_index=True)
                one = one[_wanted(key[at[one]], near.value)]
                one = one[told.new(p.key[at[one]])]
                for n, s in zip(one.tolist(), p.sets(at[one])):
                    sets[n] = np.unique(s).tobytes()
            texts = np.flatnonzero(p.words >= how[1])
            count = len(texts)
            mask = np.arange(len(at) + count) >= len(at)
            around = [x.tobytes() for x in p.around(at, how[0] - how[1])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[key[at], np.zeros(count, np.int64)], mask=mask), signed(np.r_[body[p.row[at]], body[texts]]), pa.array(np.r_[p.begin[at], p.words[texts]].astype(np.int32)),
                    pa.array([*around, *[None] * count], pa.binary()), pa.array([*sets, *[None] * count], pa.binary()),
                ],
                ["key", "body", "begin", "around", "shingles"],
            )

    return places


def _picked(how: tuple):
    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, shingles) of (text, keys)."""
        for batch in batches:
            raw, lists = as_bytes(batch.column(0)), batch.column(1).to_pylist()
            for text, keys in zip(raw, lists):
                p = Paragraphs([text], *how)
                names, one = np.unique(p.key.view(np.int64), return_index=True)
                one = one[_wanted(names, np.sort(np.array(keys, np.int64)))]
                yield pa.RecordBatch.from_arrays([signed(p.key[one]), pa.array([np.unique(s).tobytes() for s in p.sets(one)], pa.binary())], ["key", "shingles"])

    return picked


def _extended(most: int, wanted: object | None):
    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(whole, body, begin) of the wanted (key, body, begin, around): a hash of each passage of ``most`` more words that holds the paragraph."""
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(_wanted(batch.column(0).to_numpy(), wanted.value)))
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy().view(np.uint64)
            raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, 2 + 4 * most)
            near = np.ascontiguousarray(raw[:, 2:]).view(np.uint16).astype(np.uint64)
            whole, row = [], []
            for left in range(most + 1):
                some = np.flatnonzero((raw[:, 0] >= left) & (raw[:, 1] >= most - left))
                h = mix(key[some] ^ np.uint64(left + 1))
                for k in range(most - left, 2 * most - left):
                    h = mix(h * np.uint64(_STEP) + near[some, k])
                whole.append(h)
                row.append(some)
            at = np.concatenate(row)
            rest = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([signed(np.concatenate(whole)), rest.column(1), rest.column(2)], ["whole", "body", "begin"])

    return extended


def similar(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Edges that connect the components of the pairs with at least that Jaccard similarity.

    A search from each set in turn: every set that is reached is compared with those that aren't yet and share
    a value with it. So each component is found whole, close copies cost one comparison each, and unlike sets
    none but for what they have in common. The index of values is made anew when half of its sets are reached.
    """
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if both and both >= threshold * (len(sets[0]) + len(sets[1]) - both) - 1e-9 else []
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, values = np.unique(np.concatenate(sets), return_inverse=True)
    ends, total = np.cumsum(sizes), int(values.max()) + 1
    everywhere = np.bincount(values, minlength=total) == n  # as the anchor is: counted, but not sought
    common = int(everywhere.sum())
    left, edges = np.ones(n, bool), []
    post = first = np.zeros(0, np.int64)
    indexed = 0  # sets in the index, some of which may have been reached since
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            rest = int(left.sum())
            if not rest:
                return edges
            if not indexed or rest * 2 <= indexed:
                keep = left[owner] & ~everywhere[values]
                order = np.argsort(values[keep], kind="stable")
                post, first = owner[keep][order], np.searchsorted(values[keep][order], np.arange(total + 1))
                indexed = rest
            v = queue.pop()
            mine = values[ends[v] - sizes[v] : ends[v]]
            mine = mine[~everywhere[mine]]
            many = first[mine + 1] - first[mine]
            hit = post[np.repeat(first[mine], many) + ragged(many)]
            if common and common >= threshold * (sizes[left].min() + sizes[v] - common) - 1e-9:
                which, both = np.arange(n), np.bincount(hit, minlength=n)  # what all have may be enough
            else:
                which, both = np.unique(hit, return_counts=True)
            both = both + common
            near = which[left[which] & (both > 0) & (both >= threshold * (sizes[which] + sizes[v] - both) - 1e-9)]
            left[near] = False
            edges += [(v, x) for x in near.tolist()]
            queue += near.tolist()
    return edges


def _edges(threshold: float):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, root, whole): the components of the similar paragraphs of each cell, as stars; ``whole`` says that the cell is a whole bucket."""
        for table in groups_of(batches, "cell"):
            cell, key, whole = (table.column(c).to_numpy() for c in ("cell", "key", "whole"))
            sets = [np.frombuffer(x, np.uint32) for x in table.column("shingles").to_pylist()]
            nodes, roots = [], []
            for i, j in itertools.pairwise([*np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]).tolist(), len(cell)]):
                links = similar(sets[i:j], threshold) if j - i > 1 else []
                if links:
                    x, y = np.array(links).T
                    root = local_roots(j - i, x, y)
                    at = np.flatnonzero(root != np.arange(j - i))
                    nodes.append(i + at)
                    roots.append(i + root[at])
            at, up = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (nodes, roots))
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(key[up]), pa.array(whole[at])], ["node", "root", "whole"])

    return edges


def _shared(names: DataFrame, most: int) -> object | None:
    """The sorted keys as a broadcast, or None if there are more than ``most``."""
    some = names.limit(most + 1).toArrow().column("key").to_numpy()
    return names.sparkSession.sparkContext.broadcast(np.sort(some)) if len(some) <= most else None


def repeated_passages(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, window: int = WINDOW, shingle: int = SHINGLE, min_jaccard: float = MIN_JACCARD, hashes: int = HASHES, broadcast_ids: int = BROADCAST_IDS, block: int = BLOCK
) -> DataFrame:
    """(doc, body, begin, words, keep_doc, keep_body): every passage that goes, and the documents in which a copy stays.

    A passage is a run of words (runs of bytes without ASCII white space; ASCII letters in lower case) that is
    covered by paragraphs of a class that an earlier document holds too; begin counts from the text's first word.
    It is reported if it has ``min_words`` words, or if with its neighbours it has so many in common with another
    document, word for word. There is a row for each document that keeps a copy of one of its paragraphs.
    Two paragraphs are of one class if they are equal, or if they share the anchor and the Jaccard similarity of
    their sets of ``shingle`` words in a row is at least ``min_jaccard``, or by a chain of such pairs. Of each
    class all paragraphs of the first document stay, by (doc_id, text hash), null ids first.

    Any passage of ``min_words`` words that two documents share word for word is found, whatever stands around
    it. Similar paragraphs with the same anchor meet with the probability ``recall``; equal ones always do. Nothing
    less similar is ever paired, and what is equal word for word but shorter isn't reported.

    Ties: equal texts are one text, whose least id is the document; each other id with that text goes whole, in
    one row. Rows that repeat both id and text are one document; rows that share an id but not a text are two.
    Repeats within one document are not reported. Nulls, empty texts and texts of fewer than ``window`` words
    have no paragraphs. Very long texts are taken whole. An empty table gives no rows. Only the named columns
    are read, so others can't clash.
    """
    if not shingle <= window <= min_words:
        raise ValueError("a shingle must fit into a window, and that into the passages")
    how, spark = (min_words, window, shingle), df.sparkSession
    docs = df.select(col(text).cast("string").alias("text"), col(doc_id).cast("bigint").alias("doc"), F.xxhash64(col(text).cast("string")).alias("body")).where("text IS NOT NULL")
    texts = docs.select("text", "body")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = texts.mapInArrow(_banded(how, hashes, parts), "part int, records binary")
    met = checkpointed(sent.repartition(parts // 4, "part").sortWithinPartitions("part").mapInArrow(_collisions(hashes), "key bigint, bucket bigint"))
    names, near = met.select("key"), met.where("bucket IS NOT NULL").select("key")
    wanted = _shared(names, broadcast_ids)
    shape = "key bigint, body bigint, begin int, around binary, shingles binary"
    if wanted is not None:
        found = checkpointed(texts.mapInArrow(_places(how, wanted, _shared(near, broadcast_ids)), shape))
        sets = found.where("shingles IS NOT NULL").groupBy("key").agg(F.first("shingles").alias("shingles"))  # equal keys have equal sets
    else:
        found = texts.mapInArrow(_places(how, None, None), shape)
        found = checkpointed(found.join(names, "key", "left_semi").unionByName(found.where("key IS NULL")))
        one = found.join(near, "key", "left_semi").groupBy("key").agg(F.min("body").alias("body")).groupBy("body").agg(F.collect_list("key").alias("keys"))
        sets = texts.dropDuplicates(["body"]).join(one, "body").select("text", "keys").mapInArrow(_picked(how), "key bigint, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))
    cells = blocked(met.where("bucket IS NOT NULL"), "bucket", "key", block).join(sets, "key").select("cell", "key", (F.col("cell") == F.col("bucket")).alias("whole"), "shingles")
    stars = checkpointed(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_edges(min_jaccard), "node bigint, root bigint, whole boolean"))
    # a paragraph is in one bucket, so only the buckets that were split have components over several cells
    roots = stars.where("whole").select("node", "root").unionByName(components(stars.where("NOT whole").select(F.col("node").alias("a"), F.col("root").alias("b"))))

    bodies = docs.groupBy("body").agg(F.min(F.struct("doc")).alias("first"), F.max(F.struct("doc")).alias("last"))
    bodies = checkpointed(bodies)
    spots = found.where("key IS NOT NULL").select("key", "body", "begin").repartition("body").dropDuplicates(["body", "begin"]).join(bodies.select("body", "first"), "body")
    least = spots.groupBy("key").agg(F.min(F.struct("first", "body")).alias("least"))
    # only paragraphs with similar ones need the first document of their class; for the others it's that of their own
    member = roots.select(F.col("node").alias("key"), "root").unionByName(roots.select(F.col("root").alias("key"), "root").distinct())
    member = member.join(least, "key")
    keep = member.groupBy("root").agg(F.min("least").alias("keep"))
    own = least.join(member.select("key", "root").join(keep, "root").select("key", "keep"), "key", "left").select("key", F.coalesce("keep", "least").alias("keep"))
    goes = spots.join(own, "key").where(F.col("body") != F.col("keep.body"))
    goes = checkpointed(islands(goes.select("key", "body", "begin", "keep"), window))
    doubtful = goes.where(F.col("words") < min_words)
    names = doubtful.select("key").distinct()
    few, places = _shared(names, broadcast_ids), found.where("key IS NOT NULL").select("key", "body", "begin", "around")
    again = (places if few is not None else places.join(names, "key", "left_semi")).mapInArrow(_extended(min_words - window, few), "whole bigint, body bigint, begin int")
    again = again.join(bodies.select("body", "first"), "body")
    whole = again.groupBy("whole").agg(F.min(F.struct("first", "body")).alias("other"), F.max("body").alias("most"), F.min("body").alias("least")).where("most <> least").select("whole", "other")
    sure = again.join(whole, "whole").where(F.col("body") != F.col("other.body")).groupBy("body", "begin").agg(F.min("other").alias("other"))
    told = doubtful.join(sure, ["body", "begin"]).select("body", "start", "words", F.col("other").alias("keep"))
    passages = goes.where(F.col("words") >= min_words).select("body", "start", "words", "keep").unionByName(told).distinct().withColumnRenamed("start", "begin")
    parted = passages.join(bodies.select("body", "first"), "body").select(F.col("first.doc").alias("doc"), "body", "begin", "words", F.col("keep.first.doc").alias("keep_doc"), F.col("keep.body").alias("keep_body"))

    sizes = found.where("key IS NULL").groupBy("body").agg(F.max("begin").alias("words"))
    twice = bodies.where(~F.col("first").eqNullSafe(F.col("last"))).join(sizes, "body").select("body", "first", "words")
    copies = docs.select("doc", "body").join(twice, "body").where(~F.col("doc").eqNullSafe(F.col("first.doc"))).distinct()
    return parted.unionByName(copies.select("doc", "body", F.lit(0).alias("begin"), "words", F.col("first.doc").alias("keep_doc"), F.col("body").alias("keep_body")))


def islands(goes: DataFrame, window: int) -> DataFrame:
    """rows (body, begin, ...) with start and words of the passage that they make up: paragraphs that touch or overlap are one."""
    order = Window.partitionBy("body").orderBy("begin")
    new = F.coalesce(F.col("begin") > F.lag("begin").over(order) + window, F.lit(True))
    number = F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy("body", "nth")
    rows = goes.withColumn("new", new).withColumn("nth", number).withColumn("start", F.min("begin").over(whole))
    return rows.withColumn("words", F.max("begin").over(whole) - F.col("start") + window).drop("new", "nth")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words from begin to end of each span; the white space around them stays."""
    raw = text.encode()
    starts, ends = word_spans(np.frombuffer(raw, np.uint8))
    out, done = [], 0
    for begin, end in sorted(spans):
        low = int(starts[begin])
        if low > done:
            out.append(raw[done:low])
        done = max(done, int(ends[end - 1]))
    return b"".join([*out, raw[done:]]).decode()


def dedup_passages(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n_chars: str | None = "n_chars", **how: object) -> DataFrame:
    """df without the passages that ``repeated_passages`` names; documents of which only white space is left go.

    Other columns pass through, whatever their names; n_chars is set anew where passages went. Null, empty and
    blank texts stay as they are.
    """

    @F.pandas_udf("string")
    def shortened(texts, begins, ends):
        import pandas as pd

        return pd.Series([t if b is None else cut(t, list(zip(b, e))) for t, b, e in zip(texts, begins, ends)], dtype=object)

    shortened.func.__annotations__ = {}
    gone = repeated_passages(df, text, doc_id, **how).groupBy("doc", "body").agg(F.collect_set(F.struct("begin", (F.col("begin") + F.col("words")).alias("end"))).alias("gone"))
    names, n = df.columns, len(df.columns)
    t, d = names.index(text), names.index(doc_id)
    plain = df.toDF(*[f"c{i}" for i in range(n)])
    same = F.col(f"c{d}").cast("bigint").eqNullSafe(F.col("doc")) & (F.xxhash64(F.col(f"c{t}").cast("string")) == F.col("body"))
    both = plain.join(gone.hint("shuffle_hash"), same, "left")
    both = both.withColumn("new", shortened(F.col(f"c{t}").cast("string"), F.col("gone.begin"), F.col("gone.end")))
    both = both.where(F.col("gone").isNull() | F.col("new").rlike(r"[^\t\n\x0b\x0c\r\x1c-\x1f ]"))
    at = names.index(n_chars) if n_chars in names else -1
    columns = [F.col("new") if i == t else F.when(F.col("gone").isNull(), F.col(f"c{i}")).otherwise(F.length("new").cast(df.schema[i].dataType)) if i == at else F.col(f"c{i}") for i in range(n)]
    return both.select(*[c.alias(f"r{i}") for i, c in enumerate(columns)]).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, first_word, n_words, copy_of): every passage that a document repeats, and the documents that keep parts of it."""
    found = repeated_passages(read(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("begin").alias("first_word"), F.col("words").alias("n_words"), F.col("keep_doc").alias("copy_of"))
