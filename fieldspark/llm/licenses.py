"""Operator 9, license scans: a generalised suffix automaton of licence tokens.

The automaton holds every run of words of every template. A text is streamed through it, word by word,
which gives the matching statistics: at each word, the longest run ending there that some template holds.
Long matches are then chained, template by template, into spans that cover the template in order.
"""

from __future__ import annotations

import bisect
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm.license_texts import TEMPLATES
from fieldspark.llm.shared import LOWER, as_bytes, col, joined, read, slices, span_hashes

#: Matches of fewer words in a row are not chained (whole templates that are shorter are).
MIN_MATCH = 3
#: Templates of more words are long: of those, matches must have so many words.
LONG_WORDS, LONG_MATCH = 200, 8
#: A span is reported if it covers at least this share of its template's words.
MIN_COVER = 0.8
#: Between two chained matches, at most so many words of the text may stand that aren't the template's.
MAX_GAP = 12

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ASCII letters, digits and bytes of other signs."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = _WORD[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


class Automaton:
    """A generalised suffix automaton over lists of integers.

    length: of the longest run that leads to a state; link: the state of its longest suffix that occurs
    elsewhere; next: transitions; ends: (list, position) at which a state's runs end.
    """

    def __init__(self, lists: list[list[int]]):
        self.length, self.link, self.next = [0], [-1], [{}]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for n, symbols in enumerate(lists):
            last = 0
            for at, x in enumerate(symbols):
                last = self._extend(last, x)
                self.ends[last].append((n, at))
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[s]] += self.ends[s]
        self.ends[0] = []

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, x: int, q: int) -> int:
        """The runs of q that p + x makes get a state of their own."""
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, x: int) -> int:
        q = self.next[last].get(x)
        if q is not None:  # an earlier list holds this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, x, q)
        now = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = now
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, x, q)
        return now

    def stream(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """(state, matched length) after each symbol."""
        state = size = 0
        for x in symbols:
            while state and x not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if x in self.next[state]:
                state = self.next[state][x]
                size += 1
            yield state, size


class Taken:
    """Ranges that don't overlap."""

    def __init__(self):
        self.begins: list[int] = []
        self.ends: list[int] = []

    def take(self, begin: int, end: int) -> bool:
        """Whether a range is free; then it is taken."""
        at = bisect.bisect_left(self.ends, begin + 1)
        if at < len(self.begins) and self.begins[at] < end:
            return False
        self.begins.insert(at, begin)
        self.ends.insert(at, end)
        return True


class Kind:
    """Some of the templates: their automaton, the pairs of words that they hold, and the words of their shortest match."""

    def __init__(self, lists: list[list[int]], members: list[int], words: int, least: int):
        self.members, self.least = members, least
        self.automaton = Automaton([lists[n] for n in members])
        self.pairs = np.unique(np.array([a * (words + 1) + b for n in members for a, b in zip(lists[n], lists[n][1:])], np.int64))


class Scanner:
    """The templates' automaton and what is looked for with it."""

    def __init__(self, templates: list[tuple[str, str]], min_match: int, min_cover: float, max_gap: int):
        self.names = [name for name, _ in templates]
        self.min_cover, self.max_gap = min_cover, max_gap
        raw = [np.frombuffer(text.encode(), np.uint8) for _, text in templates]
        hashed = [span_hashes(LOWER[b], *words_of(b)) for b in raw]
        self.sizes = [len(h) for h in hashed]
        if not all(self.sizes):
            raise ValueError("a template has no words")
        self.vocabulary = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, np.uint64)
        self.lists = [np.searchsorted(self.vocabulary, h).tolist() for h in hashed]
        self.min_match = [min(max(min_match, LONG_MATCH) if n > LONG_WORDS else min_match, n) for n in self.sizes]
        # short and long templates have an automaton each, so that common runs of few words needn't be sought in the long ones
        kinds = [[n for n, size in enumerate(self.sizes) if (size > LONG_WORDS) == long] for long in (False, True)]
        self.kinds = [Kind(self.lists, some, len(self.vocabulary), min(self.min_match[n] for n in some)) for some in kinds if some]

    def symbols(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the words in the templates' vocabulary; those that it doesn't have get its size."""
        none = len(self.vocabulary)
        h = span_hashes(LOWER[buf], starts, ends)
        at = np.minimum(np.searchsorted(self.vocabulary, h), none - 1)
        return np.where(self.vocabulary[at] == h, at, none)

    def stretches(self, kind: Kind, symbols: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words outside of which no match with a kind of templates can be long enough.

        Each word of a match of k words but the first makes a pair with the one before that some template
        holds, so the automaton need only see runs of such pairs; what it finds there is the same.
        """
        n = len(self.vocabulary) + 1
        if kind.least == 1:
            good = symbols < n - 1
            edge = np.flatnonzero(np.diff(np.r_[False, good, False].astype(np.int8)))
            return list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        pair = symbols[:-1] * n + symbols[1:]
        at = np.minimum(np.searchsorted(kind.pairs, pair), len(kind.pairs) - 1)
        edge = np.flatnonzero(np.diff(np.r_[False, kind.pairs[at] == pair, False].astype(np.int8)))
        low, high = edge[::2], edge[1::2] + 1
        long = high - low >= kind.least
        return list(zip(low[long].tolist(), high[long].tolist()))

    def matches(self, kind: Kind, symbols: list[int], shift: int) -> Iterator[tuple[int, int, int, int]]:
        """(template, its first word, text's first word, words) of each maximal long match.

        At each word, the suffix links lead from the longest run to those that end elsewhere too, so each
        place of a template is met with the longest run that ends there.
        """
        a = kind.automaton
        for i, (state, size) in enumerate(a.stream(symbols)):
            after = symbols[i + 1] if i + 1 < len(symbols) else -1
            met: set[tuple[int, int]] = set()
            while state and size >= kind.least:
                for place in a.ends[state]:
                    if place not in met:
                        met.add(place)
                        n, at = kind.members[place[0]], place[1]
                        more = at + 1 < self.sizes[n] and self.lists[n][at + 1] == after
                        if not more and size >= self.min_match[n]:
                            yield n, at - size + 1, shift + i - size + 1, size
                state = a.link[state]
                size = a.length[state]

    def chains(self, found: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
        """(first word, end, words covered) of the best chains of one template's matches (at, place, size).

        A match may follow another if it begins later in the text and in the template; where the two
        overlap, the later one is cut. Chains that share words compete: the one that covers most stays.
        """
        found = sorted({(p, -s, a) for a, p, s in found})
        held: list[tuple[int, int, int]] = []
        far: dict[int, int] = {}
        for p, s, a in found:  # a match inside another on the same diagonal adds nothing
            if p - s > far.get(p - a, -1):
                far[p - a] = p - s
                held.append((p - a, p, p - s))
        best: list[tuple[int, int]] = []  # covered, first word
        for k, (d, p, e) in enumerate(held):
            cover, begin = e - p, p
            for m in range(k - 1, -1, -1):
                d0, p0, e0 = held[m]
                if p - e0 > self.max_gap:
                    if p - p0 > self.max_gap + self.sizes[n]:
                        break
                    continue
                cut = max(0, e0 - p, (e0 - d0) - (p - d))  # words that the earlier one has, in the text or the template
                if e > e0 and e - d > e0 - d0 and p - d > p0 - d0 and cut < e - p and (c := best[m][0] + e - p - cut) > cover:
                    cover, begin = c, best[m][1]
            best.append((cover, begin))
        out, taken = [], Taken()
        for k in sorted(range(len(held)), key=lambda k: (-best[k][0], best[k][1], held[k][2])):
            cover, begin = best[k]
            end = held[k][2]
            if cover >= self.min_cover * self.sizes[n] and taken.take(begin, end):
                out.append((begin, end, cover))
        return out

    def scan(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, template, first byte, end byte, words covered), where spans compete: most words first, then the fuller template."""
        buf, begin, _ = joined(texts)
        starts, ends = words_of(buf)
        if not len(starts) or not self.sizes:
            return []
        symbols = self.symbols(buf, starts, ends)
        text_of = np.searchsorted(begin, starts, side="right") - 1
        # a word of no template parts two texts
        new = np.flatnonzero(text_of[1:] != text_of[:-1]) + 1
        where = np.arange(len(symbols)) + np.searchsorted(new, np.arange(len(symbols)), side="right")
        apart = np.full(len(symbols) + len(new), len(self.vocabulary), np.int64)
        apart[where] = symbols
        place = np.full(len(apart), -1, np.int64)
        place[where] = np.arange(len(symbols))
        by: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        for kind in self.kinds:
            for low, high in self.stretches(kind, apart):
                shift = int(place[low])
                for n, at, p, size in self.matches(kind, apart[low:high].tolist(), shift):
                    by[int(text_of[p]), n].append((at, p, size))
        spans: dict[int, list[tuple[int, float, int, int, int]]] = defaultdict(list)
        for (t, n), found in by.items():
            if sum(size for _, _, size in found) >= self.min_cover * self.sizes[n]:
                spans[t] += [(-cover, -cover / self.sizes[n], n, a, b) for a, b, cover in self.chains(found, n)]
        out = []
        for t in sorted(spans):
            taken = Taken()
            for cover, _, n, a, b in sorted(spans[t]):
                if taken.take(a, b):
                    out.append((t, n, int(starts[a] - begin[t]), int(ends[b - 1] - begin[t]), -cover))
        return out


_scanners: dict[str, Scanner] = {}


def _scanner(name: str, shared: object, how: tuple) -> Scanner:
    """The scanner of that name, built once in each Python worker."""
    if name not in _scanners:
        _scanners.clear()
        _scanners[name] = Scanner(shared.value, *how)
    return _scanners[name]


def _scan(shared: object, *how: float):
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(name, shared, how)
        for batch in batches:
            raw = as_bytes(batch.column(0))
            for i, j in slices(raw):
                found = scanner.scan(raw[i:j])
                text, n, begin, end, cover = (np.array([f[k] for f in found], np.int64) for k in range(5))
                share = np.array([f[4] / scanner.sizes[f[1]] for f in found])
                ids = batch.column(1).slice(i, j - i).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([ids, pa.array([scanner.names[k] for k in n.tolist()], pa.string()), *[pa.array(x.astype(np.int32)) for x in (begin, end, cover)], pa.array(share)], ["id", "license", "begin", "end", "words", "share"])

    return scan


def scan_licenses(df: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: list[tuple[str, str]] | None = None, min_match: int = MIN_MATCH, min_cover: float = MIN_COVER, max_gap: int = MAX_GAP) -> DataFrame:
    """(doc_id, license, begin, end, words, share): every span of a text that covers a template.

    Words are runs of ASCII letters and digits and of all other signs beyond ASCII; case and what stands
    between them don't count. Matches are maximal runs of at least ``min_match`` words (or a whole
    shorter template; LONG_MATCH words of a template of more than LONG_WORDS); a chain of them, in order in both, with at most ``max_gap`` foreign words between
    two, is a span if it covers at least ``min_cover`` of the template. begin and end are bytes of the
    UTF-8 text, words the template's words that are covered, share their part of the template.
    Where spans overlap, that with most words stays; ties go to the fuller template, then to the one
    listed first, then to the earlier span.

    Nulls, empty texts and texts without licences give no rows. Repeated rows give repeated results; a
    null id is carried. An empty table gives no rows. Only the two named columns are read. Whole texts
    are streamed, whatever their length. One pass without a shuffle; the automaton's size is that of
    the templates.
    """
    shared = df.sparkSession.sparkContext.broadcast([*(TEMPLATES if templates is None else templates)])
    scan = _scan(shared, min_match, min_cover, max_gap)
    kind = df.select(col(doc_id)).schema[0].dataType.simpleString()
    out = df.select(col(text).cast("string"), col(doc_id)).mapInArrow(scan, f"id {kind}, license string, begin int, end int, words int, share double")
    return out.withColumnRenamed("id", doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence span of every document."""
    return scan_licenses(read(spark, sf_dir, "documents"))
