"""BPE, token counts, chats, licences, languages."""

from __future__ import annotations

import base64
import random
import time

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldspark.llm import bpe, chat, langid, licenses, tokencounts
from fieldspark.llm.license_texts import TEMPLATES
from fieldspark.llm.shared import read

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    with open(bpe.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_reference_tokenizer(spark, reference, corpus, sf):
    out = {r.doc_id: r for r in bpe.encode(read(spark, sf, "documents"), keep=["doc_id"]).collect()}
    for d, text, _ in corpus:
        assert out[d].tokens == reference.encode_ordinary(text), d
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(out[d].offsets, [*out[d].offsets[1:], len(raw)])) == raw and out[d].lossless


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n\r'sdmtlvre1a.é漢🙂  ́"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_bpe_on_any_text(texts):
    ref = _reference()
    coder = bpe.encoder(bpe.VOCABULARY)
    counts, ids, _ = coder.encode([t.encode() for t in texts])
    want = [ref.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    assert coder.decode(ids).tobytes() == "".join(texts).encode()


@pytest.mark.parametrize("kind", ("letter", "blanks", "base64", "letters", "han"))
def test_long_pieces(kind):
    """A megabyte without a boundary takes seconds, and what the public tokenizer can take is equal."""
    rng = random.Random(5)
    text = {
        "letter": lambda n: "a" * n, "blanks": lambda n: " " * n, "base64": lambda n: base64.b64encode(rng.randbytes(n)).decode()[:n],
        "letters": lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCXYZ") for _ in range(n)), "han": lambda n: "漢字語" * (n // 9),
    }[kind](1_000_000)
    coder = bpe.Encoder(open(bpe.VOCABULARY, "rb").read())
    began = time.process_time()
    counts, ids, offsets = coder.encode([text.encode(), b"and more"])
    assert time.process_time() - began < 30 and counts.sum() == len(ids) == len(offsets)
    assert coder.decode(ids[: counts[0]]).tobytes() == text.encode()
    part = text[:6000]
    assert coder.encode([b"x", part.encode(), b"", b"yz"])[1].tolist() == [t for x in ("x", part, "yz") for t in _reference().encode_ordinary(x)]


_made = {}


def _reference():
    if not _made:
        with open(bpe.VOCABULARY, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _made["x"] = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made["x"]


def test_bpe_awkward(awkward, empty):
    out = bpe.encode(awkward)
    assert out.count() == awkward.count() and "root" in out.columns
    rows = {r.doc_id: r for r in out.where("doc_id in (1, 2, 6)").collect()}
    assert rows[1].tokens is None and rows[1].n_tokens is None and rows[2].tokens == [] and rows[6].lossless
    back = bpe.decode(out)
    key = F.coalesce("doc_id", F.lit(-1))
    assert sorted(map(str, back.select(key, "text").collect())) == sorted(map(str, awkward.select(key, "text").collect()))
    assert bpe.encode(empty).count() == 0


def test_token_counts_equal_brute_force(spark, reference, corpus, sf):
    lengths = [len(reference.encode_ordinary(t)) for _, t, _ in corpus]
    report = {r.tokens: r for r in tokencounts.query(spark, sf).collect()}
    assert sorted(report) == sorted(set(lengths))
    for n, r in report.items():
        assert (r.docs, r.docs_over, r.tokens_over) == (lengths.count(n), sum(x > n for x in lengths), sum(x for x in lengths if x > n))
        assert (r.truncated_total, r.total_docs, r.total_tokens) == (sum(min(x, n) for x in lengths), len(lengths), sum(lengths))
        assert r.share == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    limits = [0, 1, 100, 512, 5000, 10**6]
    got = {r.limit: r for r in tokencounts.totals_at(tokencounts.query(spark, sf), limits).collect()}
    assert {n: (r.truncated_total, r.docs_over) for n, r in got.items()} == {n: (sum(min(x, n) for x in lengths), sum(x > n for x in lengths)) for n in limits}


def test_token_counts_awkward(awkward, empty):
    got = tokencounts.length_report(awkward).collect()
    assert sum(r.docs for r in got) == awkward.where("text is not null").count() and min(r.tokens for r in got) == 0
    assert tokencounts.length_report(empty).count() == 0


def test_chats_equal_the_fold(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for conv in range(60):
        events, seen = [], 0
        for seq in range(rng.randrange(1, 14)):
            turn = rng.randrange(min(seen + 1, 5))
            seen = max(seen, turn + 1)
            events.append((seq, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "b ", None, ""])))
        rows += [(conv, turn, role, text, seq, kind) for seq, kind, turn, role, text in events]
        want[conv] = brute.chat(events)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq long, kind string").repartition(4)
    got: dict[int, list] = {}
    for r in chat.final_messages(df, seq="seq", kind="kind").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert got == want


def test_chats_with_repeated_rows_and_clashing_columns(spark):
    log = [(1, 0, "user", "a", 0, "message"), (1, 0, None, "b", 1, "delta"), (1, 0, None, "b", 1, "delta"), (1, 1, "assistant", "c", 2, "message"), (1, 1, "assistant", "c", 2, "message")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in log], "conv_id long, turn long, role string, text string, seq long, kind string, conv string, events string, cut string")
    assert [tuple(r) for r in chat.final_messages(df, seq="seq", kind="kind").orderBy("turn").collect()] == [(1, 0, "user", "abb"), (1, 1, "assistant", "c")]


def test_event_log_has_every_kind_and_leads_to_the_messages(spark, sf):
    rows = read(spark, sf, "conversations")
    log = chat.event_log(rows).collect()
    assert {r.kind for r in log} == {"message", "delta", "edit", "regenerate"} and len(log) > 4 * rows.count()
    by: dict[int, list] = {}
    for r in log:
        by.setdefault(r.conv_id, []).append((r.seq, r.kind, r.turn, r.role, r.text))
    want = {}
    for r in rows.collect():
        want.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    assert {c: brute.chat(e) for c, e in by.items()} == {c: sorted(x) for c, x in want.items()}


def test_chats_awkward(spark):
    rows = [(1, 0, "user", "hi <|user|>"), (1, 1, None, None), (None, 0, "user", "x"), (2, None, "user", ""), (2, 0, "user", "y" * 100_000)]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out[1].rendered == "<|user|>\nhi <user|>\n<|end|>\n<|unknown|>\n\n<|end|>\n" and out[1].n_messages == 2
    assert out[None].n_messages == 1 and out[2].rendered.startswith("<|user|>\n\n<|end|>\n<|user|>\nyy")
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        chat.final_messages(spark.createDataFrame([(1, 0, "u", "t", "nonsense")], "conv_id long, turn long, role string, text string, kind string"), kind="kind").collect()


def test_matching_statistics_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        lists = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 5))]
        a, q = licenses.Automaton(lists), [rng.randrange(4) for _ in range(30)]
        for i, (state, size) in enumerate(a.stream(q)):
            runs = [n for n in range(i + 2) if n == 0 or any(x[k : k + n] == q[i - n + 1 : i + 1] for x in lists for k in range(len(x) - n + 1))]
            assert size == max(runs)
            if size:
                assert set(a.ends[state]) == {(n, k + size - 1) for n, x in enumerate(lists) for k in range(len(x) - size + 1) if x[k : k + size] == q[i - size + 1 : i + 1]}


def test_chains_equal_all_chains():
    """The first span covers as much of a template as any chain of its maximal matches can."""
    rng = random.Random(14)
    spans = 0
    for _ in range(300):
        template = [rng.randrange(6) for _ in range(rng.randrange(4, 14))]
        text = [x for x in template if rng.random() < 0.8] if rng.random() < 0.8 else [rng.randrange(6) for _ in range(12)]
        text = [rng.randrange(7) for _ in range(rng.randrange(3))] + [y for x in text for y in ([x, rng.randrange(6)] if rng.random() < 0.15 else [x])]
        scanner = licenses.Scanner([("T", " ".join(f"w{x}" for x in template))], 2, 0.6, 4)
        n, m = len(template), len(text)
        equal = lambda a, p: 0 <= a < n and 0 <= p < m and template[a] == text[p]  # noqa: B023, E731
        found = []
        for a in range(n):
            for p in range(m):
                size = 0
                while equal(a + size, p + size):
                    size += 1
                if size >= 2 and not equal(a - 1, p - 1):
                    found.append((a, p, size))

        def most(a, p, size):
            """The most that a chain ending with this match covers."""
            best = size
            for b, q, other in found:  # noqa: B023
                cut = max(0, q + other - p, b + other - a)
                if (b, q) != (a, p) and b < a and q < p and b + other < a + size and q + other < p + size and p - (q + other) <= 4 and cut < size:
                    best = max(best, most(b, q, other) + size - cut)
            return best

        want = max((most(*x) for x in found), default=0)
        got = scanner.scan([" ".join(f"w{x}" for x in text).encode()])
        assert bool(got) == (want >= 0.6 * n)
        if got:
            spans += 1
            assert max(x[4] for x in got) == want
            assert all(x[3] <= y[2] for x, y in zip(sorted(got, key=lambda s: s[2]), sorted(got, key=lambda s: s[2])[1:]))
    assert spans > 100


def test_licenses_of_equal_spans_go_to_the_first(spark):
    same = [("A", "one two three four"), ("B", "one two three four"), ("C", "two three four")]
    rows = licenses.scan_licenses(spark.createDataFrame([(1, "x one two three four y")], "doc_id long, text string"), templates=same).collect()
    assert [(r.license, r.words) for r in rows] == [("A", 4)]


def test_every_template_is_found():
    scanner = licenses.Scanner(TEMPLATES, licenses.MIN_MATCH, licenses.MIN_COVER, licenses.MAX_GAP)
    for name, text in TEMPLATES:
        found = scanner.scan([f"before the\n// {text.upper()}\nof after".encode()])
        assert [scanner.names[f[1]] for f in found] == [name], text[:50]
    long = dict(TEMPLATES)["Unlicense"].split()
    damaged = " ".join(long[:10] + ["XX"] + long[11:20] + long[21:])
    assert [scanner.names[f[1]] for f in scanner.scan([damaged.encode()])] == ["Unlicense"]
    assert not scanner.scan([" ".join(long[: len(long) // 2]).encode(), b"the of and in this software", b""])


def test_licenses_of_documents(spark, sf):
    docs = read(spark, sf, "documents")
    phrases = {"Apache-2.0": "Licensed under the Apache License, Version 2.0", "MIT": "Released under the MIT License", "GPL-3.0": "GNU General Public License, version 3", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0"}
    want = {(r.doc_id, n) for n, p in phrases.items() for r in docs.where(F.col("text").contains(p)).collect()}
    rows = licenses.query(spark, sf).collect()
    assert {(r.doc_id, r.license) for r in rows} == want and want
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert all(b"icense" in texts[r.doc_id][r.begin : r.end] or b"CC BY" in texts[r.doc_id][r.begin : r.end] for r in rows)


def test_licenses_awkward(spark, awkward, empty):
    assert licenses.scan_licenses(awkward).count() == 0 and licenses.scan_licenses(empty).count() == 0
    twice = "under the MIT License " * 3 + "x " * 50_000 + "under the MIT License"
    out = licenses.scan_licenses(spark.createDataFrame([(1, twice), (1, twice), (None, "under the MIT license")], "doc_id long, text string")).collect()
    assert len(out) == 9 and {r.license for r in out} == {"MIT"} and sum(r.doc_id is None for r in out) == 1


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(read(spark, "/root/testdata/sf0.01", "documents").where("doc_id % 4 <> 0"), fit_docs=150)


def test_held_out_accuracy(spark, model):
    docs = read(spark, "/root/testdata/sf0.01", "documents").where("doc_id % 4 = 0")
    out = langid.identify(docs, model).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").collect()
    assert sum(r.lang == r.true for r in out) >= 0.98 * len(out)


def test_viterbi_equals_all_paths(model):
    labeller = langid.Labeller(model, langid.SWITCH, langid.CLIP)
    rng = random.Random(6)
    words = langid.Words([b"der und the", b"", b"le de mot que und", b"the"])
    import itertools

    import numpy as np

    for _ in range(20):
        scores = np.array([[rng.uniform(-10, 0) for _ in range(3)] + [-99.0] * (len(labeller.labels) - 3) for _ in words.starts], np.float32)
        got = labeller.label(words, scores)
        at = 0
        for n in (3, 5, 1):
            value = lambda path, at=at: sum(scores[at + i, p] for i, p in enumerate(path)) - labeller.switch * sum(a != b for a, b in itertools.pairwise(path))
            assert value(got[at : at + n].tolist()) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=n)), abs=1e-4)
            at += n


def _plain_labels(model, text: str) -> list[tuple[int, int, str, int]]:
    """Spans by plain Python: words, scripts, n-gram scores and the best of all paths, word by word."""
    import math
    import re

    import numpy as np

    labels = langid.Labeller(model, langid.SWITCH, langid.CLIP).labels
    found = []
    for m in re.finditer(rb"[^\t\n\x0b\x0c\r\x1c-\x1f ]+", text.encode()):
        scripts = [langid.script(c) for c in m.group().decode()]
        counts = {s: scripts.count(s) for s in set(scripts) - {"Zyyy"}}
        name = min(counts, key=lambda s: (-counts[s], langid.SCRIPTS.index(s))) if counts else None
        if name is None:
            found.append((m, [0.0] * len(labels), 0))
            continue
        sole = langid.SOLE.get(name, f"und-{name}")
        allowed = model.scripts.get(name) or [labels.index(sole)]
        word = b"_" + m.group().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) + b"_"
        sums = np.zeros(len(model.languages))
        for n in langid.GRAMS:
            for i in range(len(word) - n + 1):
                key = int.from_bytes(word[i : i + n], "big") + (n << 40)
                sums += model.weights[(key * 0x9E3779B97F4A7C15 % 2**64 >> 47) % langid.BUCKETS].astype(float)
        sums /= len(langid.GRAMS) / 2
        row = [-2 * langid.CLIP] * len(labels)
        for a in allowed:
            row[a] = max(sums[a] - max(sums[b] for b in allowed), -langid.CLIP) if len(allowed) > 1 else 0.0
        found.append((m, row, 1))
    best = [(0.0, [])] * len(labels)
    for k, (_, row, _) in enumerate(found):
        top = max(range(len(labels)), key=lambda x: best[x][0])
        best = [max((best[x][0], best[x][1]), (best[top][0] - langid.SWITCH if k else -math.inf, best[top][1]), key=lambda p: p[0]) for x in range(len(labels))]
        best = [(v + row[x], [*path, x]) for x, (v, path) in enumerate(best)]
    path = max(best, key=lambda p: p[0])[1] if found else []
    spans: list[list] = []
    for (m, _, spoken), x in zip(found, path):
        if not spans or spans[-1][2] != labels[x]:
            spans.append([m.start(), m.end(), labels[x], 0])
        spans[-1][1] = m.end()
        spans[-1][3] += spoken
    return [tuple(s) for s in spans if s[3]]


def test_spans_equal_plain_python(spark, model):
    rng = random.Random(12)
    rows = read(spark, "/root/testdata/sf0.01", "documents").where("n_chars > 400").select("text").limit(60).collect()
    parts = [" ".join(r.text.split()[:14]) for r in rows] + ["Привет всем людям", "漢字 漢字です 漢字", "καλημέρα κόσμε 12", "12 -- 34", "שלום לכולם", "x1 Ωmega Éa"]
    docs = [(k, "  \n".join(rng.choice(parts) for _ in range(rng.randrange(0, 6)))) for k in range(80)]
    got = {r.doc_id: [(s.begin, s.end, s.lang, s.words) for s in r.spans] for r in langid.identify(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), model).collect()}
    want = {k: _plain_labels(model, t) for k, t in docs}
    assert sum(len(x) > 1 for x in want.values()) > 30
    assert got == want


def test_the_query_is_right_about_texts_that_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents")
    out = langid.query(spark, sf).join(docs.select("doc_id", F.col("lang").alias("true"), langid.held_out(F.col("text")).alias("unseen")), "doc_id").collect()
    unseen = [r for r in out if r.unseen]
    assert len(out) == docs.count() and len(unseen) > 50
    assert sum(r.lang == r.true for r in unseen) >= 0.97 * len(unseen)


def test_mixed_languages_and_scripts(spark, model):
    texts = {r.lang: r.text for r in read(spark, "/root/testdata/sf0.01", "documents").where("doc_id % 4 = 0 and n_chars > 500").collect()}
    de, en = (" ".join(texts[x].split()[:40]) for x in ("de", "en"))
    mixed = f"{de} {en} Привет всем людям 漢字 漢字です καλημέρα κόσμε"
    got = langid.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert [s.lang for s in got.spans] == [s[2] for s in _plain_labels(model, mixed)] and [s.lang for s in got.spans][:3] == ["de", "en", "und-Cyrl"]
    cut = mixed.encode()[got.spans[1].begin : got.spans[1].end].decode()
    assert abs(len(cut.split()) - 40) <= 4


def test_languages_awkward(spark, awkward, empty, model):
    out = langid.identify(awkward, model)
    rows = {r.doc_id: r for r in out.where("doc_id in (1, 2, 3, 6)").collect()}
    assert out.count() == awkward.count()
    assert rows[1].lang is None and rows[1].spans is None and rows[2].lang == "und" and rows[3].spans == [] and len(rows[6].spans) >= 1
    assert langid.identify(empty, model).count() == 0
    bare = langid.fit(empty)
    got = langid.identify(spark.createDataFrame([(1, "word καλημέρα")], "doc_id long, text string"), bare).first()
    assert bare.languages == [] and {s.lang for s in got.spans} <= {"und-Latn", "el"}
