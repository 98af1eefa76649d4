"""Operator 3, benchmark decontamination by pigeonhole edit matching.

An item with an error budget of e edits is split into e + 1 pieces: a passage within e edits of it holds
one of the pieces untouched. An automaton finds every piece in every text, and Myers' bit-parallel
algorithm verifies the passage around each hit.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.shared import col, read

#: Edits allowed, as a share of the item's length.
ERROR_RATE = 0.06
#: Items shorter than this (normalised) say little: they count only where they stand unchanged and as whole words.
SHORT_CHARS = 20
#: Characters of benchmark text that are sent to the executors at once; a larger benchmark takes several passes.
CHUNK_CHARS = 4_000_000


def normalised(text: str) -> str:
    """Lower case, each run of white space as one blank, none at the ends."""
    return " ".join(text.lower().split())


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def pattern_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    return dict(masks)


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of text, and the first end at which it is reached.

    Myers (1999) in the form for approximate search: the first row is all zeros. The bit vectors are
    arbitrary-length integers, so a pattern of any length takes one pass.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """The pieces of some items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float, short_chars: int = SHORT_CHARS):
        self.short_chars = short_chars
        self.items = [(i, t, budget(t, rate) if len(t) >= short_chars else 0, pattern_masks(t)) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, errors, _) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                where[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, least distance, end) of each item that occurs in a normalised text within its budget."""
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if not self.items:
            return []
        for last, (size, at) in self.automaton.iter(text):
            begin = last + 1 - size
            for n, offset in at:
                _, item, errors, _ = self.items[n]
                if size == len(item) < self.short_chars:  # the whole item; it counts only between signs that aren't letters or digits
                    if n not in windows and not text[max(0, begin - 1) : begin].isalnum() and not text[last + 1 : last + 2].isalnum():
                        windows[n].append((begin, last + 1))
                    continue
                low = begin - offset - errors
                windows[n].append((max(0, low), min(len(text), low + len(item) + 2 * errors)))
        found = []
        for n, spans in windows.items():
            i, item, errors, masks = self.items[n]
            best, end = errors + 1, 0
            spans.sort()
            low, high = spans[0]
            for a, b in [*spans[1:], (len(text) + 1, 0)]:
                if a <= high:
                    high = max(high, b)
                    continue
                at = text.find(item, low, high)
                d, e = (0, at - low + len(item)) if at >= 0 else myers(masks, len(item), text[low:high])
                if d < best:
                    best, end = d, low + e
                if not best:
                    break
                low, high = a, b
            if best <= errors:
                found.append((i, best, end))
        return found


def item_chunks(benchmark: DataFrame, item_id: str, text: str, chunk_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's distinct normalised items, in lists of at most so many characters; one at least."""
    chunk: list[tuple[int, str]] = []
    size = 0
    for i, t in benchmark.select(col(item_id).cast("bigint"), col(text).cast("string")).where(col(text).isNotNull()).distinct().toLocalIterator():
        t = normalised(t)
        if not t:
            continue
        if chunk and size + len(t) > chunk_chars:
            yield chunk
            chunk, size = [], 0
        chunk.append((i, t))
        size += len(t)
    yield chunk


_matchers: dict[str, Matcher] = {}


def _matcher(name: str, shared: object, rate: float, short_chars: int) -> Matcher:
    """The automaton of that name, built once in each Python worker."""
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(shared.value, rate, short_chars)
    return _matchers[name]


def _hits(shared: object, rate: float, short_chars: int):
    name = uuid.uuid4().hex  # an object's address may come again in a worker

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, shared, rate, short_chars)
        for batch in batches:
            out = []
            for text, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is not None:
                    out += [(doc, *x) for x in matcher.find(normalised(text))]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "distance", "end"])

    return hits


def _clean(shared: object, rate: float, short_chars: int, at: int):
    name = uuid.uuid4().hex

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, shared, rate, short_chars)
        for batch in batches:
            yield batch.filter(pa.array([t is None or not matcher.find(normalised(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

    return clean


def contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, short_chars: int = SHORT_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, end): each item that occurs in a document within its error budget.

    Both sides are compared ``normalised``. The budget is ``rate`` edits for each character of the item;
    distance is the least over the document and end the place, in its normalised text, where that passage
    ends (the first such place in the first window that reaches it). Nothing within the budget is missed.

    An item of fewer than ``short_chars`` characters is looked for too, but has no budget and counts only as
    whole words, with no letter or digit next to it.

    Nulls: null texts and null items match nothing; a null id is carried. Empty texts and items match nothing.
    Very long texts are taken whole. Repeated rows give repeated results; ties: equal items under several ids
    are each reported. Empty tables give an empty table. Only the named columns are read, so others don't clash.

    The items go to the executors in chunks of at most ``chunk_chars`` characters, one pass for each.
    """
    sc = df.sparkSession.sparkContext
    docs = df.select(col(text).cast("string"), col(doc_id).cast("bigint"))
    out = None
    for chunk in item_chunks(benchmark, item_id, item_text, chunk_chars):
        part = docs.mapInArrow(_hits(sc.broadcast(chunk), rate, short_chars), "doc_id bigint, item_id bigint, distance int, end int")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, short_chars: int = SHORT_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """df without the documents in which a benchmark item occurs (see ``contaminated``, also for all odd cases). No shuffle.

    Documents with a null or empty text stay; repeated rows go or stay together; other columns pass through,
    whatever their names.
    """
    sc, names = df.sparkSession.sparkContext, df.columns
    out = df.toDF(*[f"c{i}" for i in range(len(names))])
    schema = out.schema
    for chunk in item_chunks(benchmark, item_id, item_text, chunk_chars):
        out = out.mapInArrow(_clean(sc.broadcast(chunk), rate, short_chars, names.index(text)), schema)
    return out.toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the distance."""
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "distance", F.col("end").alias("end_char"))
