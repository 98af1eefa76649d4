"""Operator 7, byte-level BPE encoding and decoding without a regex.

Pre-tokenisation is vectorised: code points are mapped to classes, each class is a transition function
on eight states, and an associative scan of those functions over blocks of text gives the state, and so
the boundaries, everywhere at once. The slices between boundaries are looked up in a cache of merged
pieces; those that are new are merged together, pair by pair, and long ones alone, by a heap of their
pairs. Byte offsets are kept for decoding.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import unicodedata
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.shared import as_bytes, col, ragged, read, slices, small, span_hashes

#: Rank file of the vocabulary: a base64 token and its rank on each line. It is read on the driver and sent to the executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text encoded at once.
SLICE = 1 << 20
#: Merged pieces that a worker remembers before it starts anew.
CACHE_PIECES = 600_000
#: Bytes from which on a piece is merged alone.
LONG_PIECE = 64
#: Rows of an output batch; arrays of tokens are long.
OUT_ROWS = 1000

LETTER, NUMBER, OTHER, BLANK, EDGE, SPACE_IN, CONTRACT2, CONTRACT3 = range(8)
_FREE, _LETTERS, _NUMBERS, _OTHERS, _PREFIX, _SPACES, _ONE, _TWO = range(8)
_BLOCK = 128


def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE_IN
    return out


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by symbol (8 more: first of a text) and state.

    BLANK is a blank before a sign other than white space, EDGE other white space there, SPACE_IN white
    space before white space or the end. CONTRACT2 and 3 are apostrophes that could begin a contraction.
    """
    step = np.zeros((16, 8), np.uint8)
    begin = np.ones((16, 8), np.uint8)
    for s in range(8):
        runs = ((LETTER, _LETTERS), (NUMBER, _NUMBERS), (OTHER, _OTHERS), (SPACE_IN, _SPACES))
        for symbol, state in runs:
            step[symbol, s] = state
            begin[symbol, s] = s != state and not (s == _PREFIX and symbol != SPACE_IN)
        if s in (_ONE, _TWO):
            step[LETTER, s], begin[LETTER, s] = (_FREE if s == _ONE else _ONE), 0
        step[BLANK, s], step[EDGE, s] = _PREFIX, _FREE
        for symbol, state in ((CONTRACT2, _ONE), (CONTRACT3, _TWO)):
            inside = s in (_OTHERS, _PREFIX)
            step[symbol, s], begin[symbol, s] = (_OTHERS, 0) if inside else (state, 1)
    step[8:] = step[:8, [_FREE]]
    begin[8:] = 1
    return step, begin


def scan(symbols: np.ndarray, step: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each symbol.

    Three passes: compose the transition functions of each block, for all blocks at once; compose those
    over the blocks; run each block from its now known state, again for all blocks at once.
    """
    n = len(symbols)
    blocks = -(-n // _BLOCK)
    grid = np.zeros(blocks * _BLOCK, np.uint8)
    grid[:n] = symbols << 3
    grid = np.ascontiguousarray(grid.reshape(blocks, _BLOCK).T)
    table = step.ravel()
    state = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for row in grid:
        state = table[row[:, None] | state]
    enter, now = np.zeros(blocks, np.uint8), _FREE
    for i, function in enumerate(state.tolist()):
        enter[i] = now
        now = function[now]
    out, flags = np.empty((_BLOCK, blocks), np.uint8), begin.ravel()
    for j, row in enumerate(grid):
        at = row | enter
        out[j] = flags[at]
        enter = table[at]
    return out.T.ravel()[:n].astype(bool)


class Encoder:
    """A vocabulary with its cache of merged pieces."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.token_len = np.array([len(t) for t in self.tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = size
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * size + b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.classes = _classes()
        self.step, self.begin = _machine()
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def boundaries(self, buf: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
        """Byte positions at which pieces begin; doc_starts are the starts of the texts that aren't empty."""
        if buf.max(initial=0) < 128:
            points, at = buf, None
        else:
            text = buf.tobytes().decode("utf-8", "surrogateescape")
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            width = np.ones(len(points), np.int64)
            for least in (0x80, 0x800, 0x10000):
                width += points >= least
            width[(points >= 0xDC80) & (points <= 0xDCFF)] = 1
            at = np.cumsum(width) - width
            doc_starts = np.searchsorted(at, doc_starts)
        kind = self.classes[points]
        n = len(points)
        space = kind == SPACE_IN
        last = np.zeros(n, bool)
        last[doc_starts[1:] - 1] = True
        last[-1] = True
        bound = np.zeros(n, bool)
        bound[:-1] = space[:-1] & ~space[1:]
        bound &= ~last
        kind[bound] = np.where(points[bound] == 32, BLANK, EDGE)
        marks = np.flatnonzero(points == 39)
        if len(marks):
            ends = np.append(doc_starts[1:], n)
            room = ends[np.searchsorted(doc_starts, marks, side="right") - 1] - marks
            padded = np.append(points, np.zeros(2, points.dtype))
            c1, c2 = padded[marks + 1], padded[marks + 2]
            two = (room > 1) & np.isin(c1, [ord(c) for c in "sdmt"])
            three = (room > 2) & (((c1 == 108) & (c2 == 108)) | (((c1 == 118) | (c1 == 114)) & (c2 == 101)))
            kind[marks[two]] = CONTRACT2
            kind[marks[three & ~two]] = CONTRACT3
        kind[doc_starts] += 8
        found = np.flatnonzero(scan(kind, self.step, self.begin))
        return found if at is None else at[found]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces one after the other, and how many each has."""
        long = [k for k, p in enumerate(pieces) if len(p) >= LONG_PIECE]
        if not long:
            return self._merge_rounds(pieces)
        ids, sizes = self._merge_rounds([b"" if len(p) >= LONG_PIECE else p for p in pieces])
        alone = [self._merge_heap(pieces[k]) for k in long]
        parts = np.split(ids, np.cumsum(sizes)[long])
        sizes[long] = [len(x) for x in alone]
        return np.concatenate([x for pair in itertools.zip_longest(parts, alone) for x in pair if x is not None]), sizes

    def _merge_heap(self, piece: bytes) -> np.ndarray:
        """Token ids of one piece, in a time of about n log n: the pair of least rank, leftmost first, until none is left."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        keys = ids[:-1] * self.size + ids[1:]
        i = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        ok = np.flatnonzero(self.pair_keys[i] == keys)
        now = np.full(n + 1, -1)  # rank of the pair that begins here
        now[ok] = self.pair_rank[i[ok]]
        heap = sorted((now[ok] << 32 | ok).tolist())
        now, ids = now.tolist(), ids.tolist()
        after, before = [*range(1, n + 1), n], list(range(-1, n))
        tokens, rank = self.tokens, self.ranks.get
        while heap:
            entry = heapq.heappop(heap)
            at, best = entry & 0xFFFFFFFF, entry >> 32
            if now[at] != best:
                continue
            gone = after[at]
            next_ = after[gone]
            ids[at], ids[gone], now[gone], after[at], before[next_] = best, -1, -1, next_, at
            token = tokens[best]
            now[at] = r = rank(token + tokens[ids[next_]], -1) if next_ < n else -1
            if r >= 0:
                heapq.heappush(heap, r << 32 | at)
            left = before[at]
            if left >= 0:
                now[left] = r = rank(tokens[ids[left]] + token, -1)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | left)
        return np.array([x for x in ids if x >= 0], np.int32)

    def _merge_rounds(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge``, for short pieces. Each round merges, in every piece that isn't done, the leftmost pair of least rank."""
        none = np.iinfo(np.int64).max
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), lens)
        done_ids, done_piece = [], []

        def rank_at(where: np.ndarray) -> np.ndarray:
            """Rank of the pair that begins at each place; none at the last of a piece."""
            out = np.full(len(where), none)
            ok = where < len(ids) - 1
            ok[ok] = piece[where[ok]] == piece[where[ok] + 1]
            w = where[ok]
            keys = ids[w] * self.size + ids[w + 1]
            i = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            out[ok] = np.where(self.pair_keys[i] == keys, self.pair_rank[i], none)
            return out

        rank = rank_at(np.arange(len(ids)))
        while len(ids):
            first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.r_[first, len(ids)])
            stays = np.repeat(least < none, count)
            if not stays.all():
                done_ids.append(ids[~stays])
                done_piece.append(piece[~stays])
                ids, piece, rank = ids[stays], piece[stays], rank[stays]
                keep = least < none
                least, count = least[keep], count[keep]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, count))
            p = piece[hit]
            hit = hit[np.r_[True, p[1:] != p[:-1]]]
            ids[hit] = rank[hit]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, piece, rank = ids[keep], piece[keep], rank[keep]
            hit = hit - np.arange(len(hit))
            touched = np.concatenate([hit, hit[hit > 0] - 1])
            rank[touched] = rank_at(touched)
        ids, piece = np.concatenate([*done_ids, np.zeros(0, np.int64)]), np.concatenate([*done_piece, np.zeros(0, np.int64)])
        order = np.argsort(piece, kind="stable")
        return ids[order].astype(np.int32), np.bincount(piece, minlength=len(pieces))

    def _slots(self, hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places in the cache of sorted distinct hashes; pieces that are new are merged first."""
        if len(self.keys) > CACHE_PIECES:
            self._forget()
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = buf.tobytes()
            ids, sizes = self.merge([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            offsets = np.cumsum(sizes) - sizes + len(self.flat)
            self.flat = np.concatenate([self.flat, ids])
            places = np.searchsorted(self.keys, hashes[new])
            self.keys = np.insert(self.keys, places, hashes[new])
            self.starts = np.insert(self.starts, places, offsets)
            self.sizes = np.insert(self.sizes, places, sizes)
            at = np.searchsorted(self.keys, hashes)
        return at

    def encode(self, texts: list[bytes], counts_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of each text, all ids, all byte offsets in their text). The last two are empty for counts_only."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        per_text = np.zeros(len(texts), np.int64)
        none = np.zeros(0, np.int32)
        if not lens.sum():
            return per_text, none, none
        buf = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum(lens) - lens
        starts = self.boundaries(buf, begin[lens > 0])
        ends = np.append(starts[1:], len(buf))
        hashes, first, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        slot = self._slots(hashes, buf, starts[first], ends[first])[which]
        sizes = self.sizes[slot]
        text_of = np.searchsorted(begin + lens, starts, side="right")
        per_text = np.bincount(text_of, sizes, len(texts)).astype(np.int64)
        if counts_only:
            return per_text, none, none
        ids = self.flat[np.repeat(self.starts[slot], sizes) + ragged(sizes)]
        width = self.token_len[ids]
        offsets = np.cumsum(width) - width - np.repeat(begin, per_text)
        return per_text, ids, offsets.astype(np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens."""
        width = self.token_len[ids]
        return self.token_bytes[np.repeat(self.token_at[ids], width) + ragged(width)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, data: bytes | None = None) -> Encoder:
    """One for each vocabulary in each worker; made of the file's bytes where they were sent."""
    if path not in _encoders:
        _encoders[path] = Encoder(Path(path).read_bytes() if data is None else data)
    return _encoders[path]


def shipped(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """What gives the encoder in a task: the vocabulary, a file of fixed size, goes to the executors as a broadcast."""
    sent = spark.sparkContext.broadcast(Path(path).read_bytes())
    return lambda: encoder(path, sent.value)


def _encode(coder_of: Callable[[], Encoder], at: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of()
        for batch in small(batches, OUT_ROWS):
            raw = as_bytes(batch.column(at))
            null = batch.column(at).is_null().to_numpy(zero_copy_only=False)
            for lo, hi in slices(raw, SLICE):
                for i in range(lo, hi, OUT_ROWS):
                    j = min(hi, i + OUT_ROWS)
                    counts, ids, offsets = coder.encode(raw[i:j])
                    whole = np.frombuffer(b"".join(raw[i:j]), np.uint8)
                    back = coder.decode(ids)
                    lens = np.fromiter(map(len, raw[i:j]), np.int64, j - i)
                    same = np.ones(j - i, bool)
                    if len(back) != len(whole) or (back != whole).any():
                        same = np.array([coder.decode(ids[a : a + n]).tobytes() == t for t, a, n in zip(raw[i:j], np.cumsum(counts) - counts, counts)])
                    mask = pa.array(null[i:j])
                    ends = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                    lists = [pa.ListArray.from_arrays(ends, pa.array(x), mask=mask if null[i:j].any() else None) for x in (ids, offsets)]
                    out = [pa.array(counts.astype(np.int32), mask=null[i:j]), *lists, pa.array(lens.astype(np.int32), mask=null[i:j]), pa.array(same, mask=null[i:j])]
                    rest = [c for k, c in enumerate(batch.slice(i, j - i).columns) if k != at]
                    yield pa.RecordBatch.from_arrays([*rest, *out], [f"r{k}" for k in range(len(rest) + 5)])

    return encode


def encode(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text, by default) and n_tokens, tokens, offsets, n_bytes, lossless.

    offsets are the byte at which each token begins in the UTF-8 text, so that tokens i to j stand for
    the bytes offsets[i] to offsets[j]. lossless says whether decoding gives the text back (always).
    No special tokens: their strings are ordinary text.

    Nulls: a null text gives nulls; an empty one gives no tokens. Texts of any length are taken whole, and a
    long piece without a boundary takes n log n. Ties of rank go to the leftmost pair. Rows stay as they are, repeated or not; an empty table gives an empty table. An output column whose
    name df has already (whatever the case) replaces it.
    """
    made = ("n_tokens", "tokens", "offsets", "n_bytes", "lossless")
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in made and c != text]
    plain = df.select(*[col(c) for c in names], col(text).cast("string")).toDF(*[f"c{i}" for i in range(len(names) + 1)])
    kinds = ", ".join([f"r{i} {f.dataType.simpleString()}" for i, f in enumerate(plain.schema[:-1])] + [f"r{len(names) + i} {k}" for i, k in enumerate(("int", "array<int>", "array<int>", "int", "boolean"))])
    return plain.mapInArrow(_encode(shipped(df.sparkSession, vocabulary), len(names)), kinds).toDF(*names, *made)


def decode(df: DataFrame, tokens: str = "tokens", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the text of its tokens in column ``text`` (which replaces one of that name).

    Null tokens give a null text; an unknown or null token makes the text null. Bytes that aren't UTF-8,
    as after cutting a list of tokens, become the replacement sign.
    """

    coder_of = shipped(df.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def back(lists):
        import pandas as pd

        coder = coder_of()

        def one(ids) -> str | None:
            if ids is None:
                return None
            ids = np.asarray(ids)
            if not len(ids):
                return ""
            if ids.dtype.kind != "i" or ids.min() < 0 or ids.max() >= coder.size:
                return None
            return coder.decode(ids).tobytes().decode("utf-8", "replace")

        return pd.Series([one(x) for x in lists], dtype=object)

    back.func.__annotations__ = {}
    made = back(col(tokens))
    names = [c for c in df.columns if c.lower() != text.lower()]
    return df.select(*[col(c) for c in names], made.alias(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens and offsets."""
    return encode(read(spark, sf_dir, "documents"), keep=["doc_id"])
