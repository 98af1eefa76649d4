"""Operator 10, language identification of mixed-language text.

Each word's script narrows the languages it may be in, a model of byte n-grams scores the word in each of
them, and the Viterbi algorithm with a penalty for each switch labels the spans of a text. The model is
fitted here, on a bounded sample of labelled documents.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.shared import SPACE, Recent, as_bytes, col, mix, ragged, read, slices, small, span_hashes

#: Labelled documents that the model is fitted on, for each language at most; those of the least hashes.
FIT_DOCS = 1500
#: Buckets of hashed n-grams of 1 to 4 bytes.
BUCKETS = 1 << 17
GRAMS = (1, 2, 3, 4)
#: Cost of a switch, in nats: about two clear words of another language.
SWITCH = 12.0
#: A word scores at most so many nats better in one language than in another, so no single word outweighs a switch.
CLIP = 8.0
#: Bytes of text labelled at once.
SLICE = 2 << 20
#: Scores of words that a task remembers, by slots of a table; a word whose slot was taken is scored anew.
KNOWN_BITS = 17
#: Of ten parts of the distinct texts, by hash, the query's model is fitted on all but the first; so the README's accuracy is of texts that it never saw.
HELD_OUT_PARTS = 10

#: First code point, last code point and script; all else is Common.
RANGES = [
    (0x41, 0x5A, "Latn"), (0x61, 0x7A, "Latn"), (0xAA, 0xAA, "Latn"), (0xBA, 0xBA, "Latn"), (0xC0, 0xD6, "Latn"), (0xD8, 0xF6, "Latn"), (0xF8, 0x2B8, "Latn"), (0x370, 0x3FF, "Grek"), (0x400, 0x52F, "Cyrl"), (0x531, 0x58F, "Armn"), (0x591, 0x5F4, "Hebr"), (0x600, 0x6FF, "Arab"), (0x750, 0x77F, "Arab"), (0x900, 0x97F, "Deva"), (0x980, 0x9FF, "Beng"), (0xA00, 0xA7F, "Guru"), (0xA80, 0xAFF, "Gujr"), (0xB80, 0xBFF, "Taml"), (0xC00, 0xC7F, "Telu"), (0xC80, 0xCFF, "Knda"), (0xD00, 0xD7F, "Mlym"), (0xD80, 0xDFF, "Sinh"), (0xE00, 0xE7F, "Thai"), (0xE80, 0xEFF, "Laoo"), (0x10A0, 0x10FF, "Geor"), (0x1100, 0x11FF, "Hang"), (0x1200, 0x137F, "Ethi"), (0x1780, 0x17FF, "Khmr"), (0x1E00, 0x1EFF, "Latn"), (0x1F00, 0x1FFF, "Grek"), (0x3040, 0x30FF, "Jpan"), (0x3131, 0x318E, "Hang"), (0x3400, 0x4DBF, "Hani"), (0x4E00, 0x9FFF, "Hani"), (0xAC00, 0xD7A3, "Hang"), (0xF900, 0xFAFF, "Hani"), (0x20000, 0x2FFFF, "Hani"),
]
SCRIPTS = ["Zyyy", *sorted({s for _, _, s in RANGES})]
#: The language of a script that few others use; the rest are named und-Script, unless the model knows languages of them.
SOLE = {"Grek": "el", "Armn": "hy", "Hebr": "he", "Thai": "th", "Laoo": "lo", "Geor": "ka", "Hang": "ko", "Jpan": "ja", "Hani": "zh", "Khmr": "km", "Sinh": "si", "Taml": "ta", "Telu": "te", "Knda": "kn", "Mlym": "ml", "Guru": "pa", "Gujr": "gu"}
#: Label of a text without a word in any script.
NONE = "und"

_CUTS = sorted({x for a, b, _ in RANGES for x in (a, b + 1)})
_CUT_SCRIPT = np.array([0, *[next((SCRIPTS.index(s) for a, b, s in RANGES if a <= x <= b), 0) for x in _CUTS]], np.uint8)
_TABLE = _CUT_SCRIPT[np.searchsorted(_CUTS, np.arange(0x3000), side="right")]
_ASCII = _TABLE[:128]


def script(char: str) -> str:
    """The script of one sign."""
    return SCRIPTS[_CUT_SCRIPT[bisect.bisect_right(_CUTS, ord(char))]]


def scripts_of(points: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.uint8)
    low = points < len(_TABLE)
    out[low] = _TABLE[points[low]]
    out[~low] = _CUT_SCRIPT[np.searchsorted(_CUTS, points[~low], side="right")]
    return out


class Words:
    """The words of some texts: spans in the buffer and the script of each (0: without letters).

    A word is a run without ASCII white space; ASCII letters are taken in lower case. Its script is that of
    most of its letters, and the earlier in SCRIPTS if there are as many.
    """

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_ends = np.cumsum(lens + 1) - 1
        self.text_begins = self.text_ends - lens
        self.buf = np.where((self.raw >= 65) & (self.raw <= 90), self.raw + 32, self.raw).astype(np.uint8)
        space = np.r_[True, SPACE[self.raw], True].astype(np.int8)
        step = np.diff(space)
        self.starts, self.ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        self.text_of = np.searchsorted(self.text_ends, self.starts, side="right")
        self.script = self._scripts()

    def _scripts(self) -> np.ndarray:
        n = len(self.starts)
        if not n:
            return np.zeros(0, np.uint8)
        letter = (self.raw >= 97) & (self.raw <= 122) | (self.raw >= 65) & (self.raw <= 90)
        latin = np.add.reduceat(letter, self.starts, dtype=np.int64) if len(self.raw) else np.zeros(n, np.int64)
        out = np.where(latin > 0, SCRIPTS.index("Latn"), 0).astype(np.uint8)
        high = np.flatnonzero(np.maximum.reduceat(self.raw, self.starts) >= 128)
        if len(high):
            # code points of the words that aren't ASCII
            size = self.ends[high] - self.starts[high]
            at = np.repeat(self.starts[high], size + 1) + ragged(size + 1)
            some = self.raw[at]
            some[np.cumsum(size + 1) - 1] = 10
            points = np.frombuffer(some.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            word = np.cumsum(points == 10) - (points == 10)
            counts = np.bincount(word * len(SCRIPTS) + scripts_of(points), minlength=len(high) * len(SCRIPTS)).reshape(len(high), -1)
            counts[:, 0] = 0
            best = counts.argmax(axis=1)
            out[high] = np.where(counts.max(axis=1) > 0, best, 0)
        return out

    def grams(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, index in some) of each n-gram of the given words, with a mark at both ends."""
        size = self.ends[some] - self.starts[some] + 2
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(some) else 0
        flat = np.full(total + max(GRAMS), 95, np.uint64)
        at = ragged(size)
        word = np.repeat(np.arange(len(some)), size)
        inner = (at > 0) & (at < size[word] - 1)
        flat[:total][inner] = self.buf[self.starts[some][word[inner]] + at[inner] - 1]
        left = size[word] - at
        buckets, owners = [], []
        key = np.zeros(total, np.uint64)
        for n in range(1, max(GRAMS) + 1):
            key = (key << np.uint64(8)) | flat[n - 1 : n - 1 + total]
            if n in GRAMS:
                ok = left >= n
                mixed = (key[ok] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
                buckets.append((mixed >> np.uint64(64 - 17)).astype(np.int64) % BUCKETS)
                owners.append(word[ok])
        return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """Languages in order; weights of each n-gram bucket in each (log of its frequency); scripts of each."""

    languages: list[str]
    weights: np.ndarray
    scripts: dict[str, list[int]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, script, bucket, n) sums of a task; bucket -1 counts the words of a script."""
    sums: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        raw, langs = as_bytes(batch.column(0)), np.array(batch.column(1).to_pylist())
        for lang in np.unique(langs).tolist():
            mine = [t for t, x in zip(raw, langs) if x == lang]
            for i, j in slices(mine, SLICE):
                words = Words(mine[i:j])
                for s in np.unique(words.script).tolist():
                    if s:
                        some = np.flatnonzero(words.script == s)
                        row = sums.setdefault((lang, s), np.zeros(BUCKETS + 1, np.int64))
                        row[:-1] += np.bincount(words.grams(some)[0], minlength=BUCKETS)
                        row[-1] += len(some)
    for (lang, s), row in sums.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), s, np.int32)), pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)), pa.array(row[at])], ["lang", "script", "bucket", "n"])


def fit(df: DataFrame, text: str = "text", lang: str = "lang", fit_docs: int = FIT_DOCS, min_share: float = 0.01) -> Model:
    """A model of the labelled rows of df: a uniform sample of at most ``fit_docs`` texts for each language.

    The sample is a bound on what a model of this size can use; it is drawn by hash of the text, so it is
    the same on every run, and equal texts count once. A language is a candidate in each script of at
    least ``min_share`` of its words. Rows with a null text or label are not used. Without any labelled
    row the model knows no languages, and scripts alone decide.
    """
    some = df.select(col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    marked = some.select("text", "lang", F.xxhash64("text").alias("h"))
    # the hash under which about fit_docs texts of a language lie, then the exact least ones among those
    # (one row for each language tag is broadcast)
    share = marked.groupBy("lang").agg(F.count("*").alias("n"))
    limit = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(2.0 * fit_docs + 200) / F.col("n"))
    near = marked.join(F.broadcast(share), "lang").where(F.col("h").cast("double") <= limit).drop("n")
    few = near.groupBy("lang", "h").agg(F.min("text").alias("text")).withColumn("nth", F.expr("row_number() OVER (PARTITION BY lang ORDER BY h)")).where(F.col("nth") <= fit_docs)
    found = few.select("text", "lang").mapInArrow(_count, "lang string, script int, bucket int, n bigint").groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs, script_of, bucket, n = (found.column(c).to_numpy() for c in ("lang", "script", "bucket", "n"))
    names = sorted(set(langs.tolist()))
    counts = np.zeros((len(names), BUCKETS))
    scripts: dict[str, list[int]] = {}
    for k, name in enumerate(names):
        mine = langs == name
        grams = mine & (bucket >= 0)
        np.add.at(counts[k], bucket[grams], n[grams])
        words = {int(s): int(x) for s, x in zip(script_of[mine & (bucket < 0)], n[mine & (bucket < 0)])}
        for s, x in words.items():
            if x >= min_share * sum(words.values()):
                scripts.setdefault(SCRIPTS[s], []).append(k)
    weights = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)) if names else counts
    return Model(names, np.ascontiguousarray(weights.T.astype(np.float32)), scripts)


class Labeller:
    """Labels: the model's languages, then one for each script that has none."""

    def __init__(self, model: Model, switch: float, clip: float):
        self.model, self.switch, self.clip = model, switch, clip
        self.labels = [*model.languages]
        self.of_script: dict[int, list[int]] = {}
        for s, name in enumerate(SCRIPTS[1:], 1):
            if name in model.scripts:
                self.of_script[s] = model.scripts[name]
            else:
                label = SOLE.get(name, f"und-{name}")
                if label not in self.labels:
                    self.labels.append(label)
                self.of_script[s] = [self.labels.index(label)]
        self.known = Recent(KNOWN_BITS)
        self.known_scores = np.zeros((1 << KNOWN_BITS, max(1, len(model.languages))), np.float32)

    def scores(self, words: Words) -> np.ndarray:
        """(words, labels) scores: 0 for a word's best language, at least -clip for its script's others, -2 clip elsewhere."""
        out = np.zeros((len(words.starts), len(self.labels)), np.float32)
        lettered = np.flatnonzero(words.script)
        out[lettered] = -2 * self.clip
        for s in np.unique(words.script[lettered]).tolist():
            mine = np.flatnonzero(words.script == s)
            allowed = self.of_script[s]
            if len(allowed) == 1:
                out[mine, allowed[0]] = 0
                continue
            # the script is part of a word's name, as the labels that are allowed depend on it
            hashes, first, which = np.unique(mix(span_hashes(words.buf, words.starts[mine], words.ends[mine]) ^ np.uint64(s)), return_index=True, return_inverse=True)
            slot = (hashes & self.known.mask).astype(np.int64)
            new = self.known.new(hashes)
            # of words that share a slot, the last one is remembered; so each is read before any is written
            each = self.known_scores[slot][:, : len(allowed)]
            each[new] = self._word_scores(words, mine[first[new]], allowed)
            self.known_scores[slot[new], : len(allowed)] = each[new]
            out[np.ix_(mine, allowed)] = each[which]
        return out

    def _word_scores(self, words: Words, some: np.ndarray, allowed: list[int]) -> np.ndarray:
        """Scores of some words in the allowed labels."""
        if not len(some):
            return np.zeros((0, len(allowed)), np.float32)
        buckets, owner = words.grams(some)
        each = np.zeros((len(some), len(allowed)), np.float32)
        for k, label in enumerate(allowed):
            each[:, k] = np.bincount(owner, self.model.weights[buckets, label], len(some))
        # n-grams overlap: the mean over their lengths counts each sign about once
        each /= len(GRAMS) / 2
        each -= each.max(axis=1, keepdims=True)
        return np.maximum(each, -self.clip)

    def label(self, words: Words, scores: np.ndarray | None = None) -> np.ndarray:
        """The label of each word on the best path of its text; ties go to staying, then to the first label.

        All texts take a step together, the longest first, so a step is one operation on arrays.
        """
        scores = self.scores(words) if scores is None else scores
        n = len(words.starts)
        if not n:
            return np.zeros(0, np.int64)
        first = np.flatnonzero(np.r_[True, words.text_of[1:] != words.text_of[:-1]])
        size = np.diff(np.r_[first, n])
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        come = np.zeros((n, len(self.labels)), bool)  # whether the best path to a label switches there
        source = np.zeros(n, np.int64)  # from which label, if so
        now = scores[first].astype(np.float64)
        final = np.zeros(len(first), np.int64)
        active = len(first)
        for t in range(1, int(size[0]) + 1):
            still = int(np.searchsorted(-size, -t, side="left"))
            if still < active:
                final[still:active] = now[still:active].argmax(axis=1)
                active = still
                now = now[:active]
            if not active:
                break
            at = first[:active] + t
            best = now.argmax(axis=1)
            jump = now[np.arange(active), best] - self.switch
            switched = jump[:, None] > now
            come[at], source[at] = switched, best
            now = np.where(switched, jump[:, None], now) + scores[at]
        out = np.zeros(n, np.int64)
        state, active = final.copy(), 0
        for t in range(int(size[0]) - 1, -1, -1):
            active = int(np.searchsorted(-size, -t, side="left"))
            at = first[:active] + t
            mine = state[:active]
            out[at] = mine
            state[:active] = np.where(come[at, mine], source[at], mine)
        return out


def _labelled(shared: object, switch: float, clip: float):
    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, switch, clip)
        names = np.array([*labeller.labels, NONE], dtype=object)
        for batch in small(batches, 1024):
            raw = as_bytes(batch.column(0))
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for i, j in slices(raw, SLICE):
                words = Words(raw[i:j])
                label = labeller.label(words)
                n = j - i
                spoken = words.script > 0
                if len(label):
                    new = np.r_[True, (label[1:] != label[:-1]) | (words.text_of[1:] != words.text_of[:-1])]
                    span = np.flatnonzero(new)
                    count = np.add.reduceat(spoken, span, dtype=np.int64)
                    last = np.r_[span[1:], len(label)] - 1
                    owner, kind = words.text_of[span], label[span]
                    keep = count > 0  # a span without letters says nothing
                    span, last, owner, kind, count = span[keep], last[keep], owner[keep], kind[keep], count[keep]
                else:
                    span = last = owner = kind = count = np.zeros(0, np.int64)
                begin, end = words.starts[span] - words.text_begins[owner], words.ends[last] - words.text_begins[owner]
                sums = np.bincount(owner * len(names) + kind, count, n * len(names)).reshape(n, -1).astype(np.int64)
                total = sums.sum(axis=1)
                best = np.where(total > 0, sums.argmax(axis=1), len(names) - 1)
                share = np.divide(sums.max(axis=1), total, out=np.zeros(n), where=total > 0)
                structs = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(names[kind].tolist(), pa.string()), pa.array(count.astype(np.int32))], ["begin", "end", "lang", "words"])
                ends = pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int32))
                mask = pa.array(null[i:j]) if null[i:j].any() else None
                spans = pa.ListArray.from_arrays(ends, structs, mask=mask)
                hide = {"mask": null[i:j]}
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, n), pa.array(names[best].tolist(), pa.string(), **hide), pa.array(share, **hide), pa.array(total.astype(np.int32), **hide), spans], ["id", "lang", "share", "words", "spans"])

    return labelled


def identify(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", switch: float = SWITCH, clip: float = CLIP) -> DataFrame:
    """(doc_id, lang, share, words, spans): the main language of each text and its spans.

    A span is a run of words with one label: bytes begin to end of the UTF-8 text, its language and how
    many of its words have letters. The labels maximise the sum of the words' scores less ``switch`` for
    each change. A word may only be in languages of its script (others cost twice ``clip``); where the
    model knows none, the script decides (``SOLE``, or und-Script). Words without letters join the span
    around them. The main language is that of most lettered words, its share their part; ties go to
    the earlier label in alphabetical order of the model's languages, then of the scripts.

    Nulls: a null text gives nulls. An empty text, or one without letters, is "und" with no span and
    share 0. Very long texts are labelled whole. Rows stay as they are, repeated or not; an empty table gives an empty table. Only the
    named columns are read. Whole texts are labelled. One pass without a shuffle; the model's size is fixed.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.select(col(doc_id)).schema[0].dataType.simpleString()
    out = df.select(col(text).cast("string"), col(doc_id)).mapInArrow(_labelled(shared, switch, clip), f"id {kind}, lang string, share double, words int, spans array<struct<begin:int,end:int,lang:string,words:int>>")
    return out.withColumnRenamed("id", doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, share, words, spans) of every document, those that the model was fitted on and the ``held_out`` tenth of texts alike."""
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs.where(~held_out(F.col("text")))))


def held_out(text: Column) -> Column:
    """Whether a text is kept from the query's fit; equal texts share their fate. A null text is not, but is never fitted on."""
    return F.coalesce(F.pmod(F.xxhash64(text), F.lit(HELD_OUT_PARTS)) == 0, F.lit(False))
