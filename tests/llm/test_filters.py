"""Line dedup, quality rules, near-dedup, decontamination, paragraph dedup: brute force and awkward inputs."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import decontaminate, linededup, passages, quality, simhash
from fieldspark.llm.shared import components, read

FILTERS = {
    "quality": quality.quality_rules,
    "lines": linededup.dedup_lines,
    "simhash": simhash.near_dedup,
    "passages": passages.dedup_passages,
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns_on_awkward_rows(awkward, name):
    out = FILTERS[name](awkward)
    assert out.columns == awkward.columns
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert 6 in ids and 7 in ids  # long and odd texts stay
    assert all(r.root == "root" and r.c0 == "c0" for r in rows)
    if name != "quality":
        assert {1, 2, 3} <= set(ids)  # null, empty and blank texts pass
    else:
        assert not {1, 2, 3} & set(ids)


@pytest.mark.parametrize("name", FILTERS)
def test_filters_of_nothing(empty, name):
    out = FILTERS[name](empty)
    assert out.columns == empty.columns and out.count() == 0


def test_simhash_ties_and_repeated_rows(awkward):
    ids = [(r.doc_id, r.text[:3]) for r in simhash.near_dedup(awkward).where("text like 'w0 %'").collect()]
    assert ids == [(None, "w0 ")]  # of equal texts the null id comes first; the repeated row went with its twin
    assert {tuple(r) for r in simhash.near_groups(awkward).select("doc", "keep_doc").collect()} == {(4, None), (5, None)}


def test_lines_awkward(awkward):
    out = {r.doc_id: r.text for r in linededup.dedup_lines(awkward).where("doc_id in (8, 9)").collect()}
    assert out == {8: "one\ntwo\nthree\nfour", 9: "zero\nfive"}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    docs = [(d, "\n".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))) for d in range(60)]
    want = brute.line_dedup(docs)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == want
    for run, gram in ((2, 1), (4, 2), (5, 3)):
        got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_run=run, gram=gram).collect()}
        assert got == brute.line_dedup(docs, run)
    for chars in (1, 2, 4):
        docs = [(d, "\n".join(rng.choice(["a", "bé", "ccc", "漢字漢字", "", *map(str, range(40))]) for _ in range(rng.randrange(0, 12)))) for d in range(60)]
        got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), min_chars=chars).collect()}
        assert got == brute.line_dedup(docs, chars=chars)


def test_long_lines_are_runs_of_their_own(spark):
    long = "word " * 80
    docs = [(1, f"head\n{long}\ntail"), (2, f"other\n{long}"), (3, long), (4, "x" * 200 + "\n" + "y" * 200), (5, "z\n" + "x" * 200 + "\n" + "y" * 200), (6, "x" * 200 + "\nend")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "other", 4: docs[3][1], 5: "z", 6: docs[5][1]}


def test_quality_by_broadcast_and_by_join(spark):
    rng = random.Random(5)
    docs = [(d, "\n".join([rng.choice(["Home |  About", "home | about", f"only here {d}", "Footer", ""]) for _ in range(5)]), rng.choice("ab")) for d in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    want = brute.quality(docs, 10, 0.2, 0.3)
    for limit in (1000, 0):
        out = quality.quality_rules(df.withColumn("tags", F.create_map("source", "doc_id")), min_docs=10, min_share=0.2, min_kept=0.3, broadcast_lines=limit)
        assert all(r.tags == {r.source: r.doc_id} for r in out.collect())
        assert {r.doc_id: r.text for r in out.collect()} == want
    assert 0 < len(want) < 120


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(70)]
    root = brute.roots(2000, edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root[n] for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_recall_and_precision(spark):
    df = read(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    raw = [t.encode() for _, t in rows]
    prints = simhash.fingerprints(raw)
    some = simhash.has_words(raw)
    bits = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    near = (bits <= simhash.MAX_DISTANCE) & some[:, None] & some[None]
    a, b = np.nonzero(np.tril(near, -1))
    # every group that is found is a component of pairs within the distance, and at least 0.9 of the pairs are found
    groups = {r.doc: r.keep_doc for r in simhash.near_groups(df).collect()}
    ids = [d for d, _ in rows]
    whole = brute.roots(len(ids), list(zip(a.tolist(), b.tolist())))
    place = {d: i for i, d in enumerate(ids)}
    assert all(whole[place[d]] == whole[place[k]] for d, k in groups.items())
    top = lambda i: groups.get(ids[i], ids[i])
    assert np.mean([top(i) == top(j) for i, j in zip(a.tolist(), b.tolist())]) >= 0.9


def test_simhash_loses_no_pair(spark):
    docs = brute.edited_copies(400, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    prints = simhash.fingerprints([t.encode() for _, t in docs]).tolist()
    for most in (simhash.MAX_DISTANCE, 23, 0):
        root = brute.roots(len(docs), brute.near_pairs(prints, most))
        want = {(d, root[d]) for d, _ in docs if root[d] != d}
        for block in (simhash.BLOCK, 3):
            assert {tuple(r) for r in simhash.near_groups(df, max_distance=most, block=block).select("doc", "keep_doc").collect()} == want
        assert bool(want) == bool(most)


@pytest.mark.parametrize("most", [0, 1, 2, 5, 6, 29, 30, 31, 64, 97])
def test_simhash_groups_leave_no_pair_out(most):
    """However so many bits are spread, the two fingerprints share a cell as home and home or home and probe, and pass the window."""
    rng = np.random.default_rng(most)
    a = rng.integers(0, 1 << 63, (300, 3), dtype=np.uint64)
    flips = np.array([rng.permutation(simhash.BITS) < most for _ in a])
    b = a ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    met = np.zeros(len(a), bool)
    for (own, home, place), (other, away, _), radius in zip(simhash._places(a, most), simhash._places(b, most), simhash.grouping(most)[1]):
        wa, near = simhash._windows(home, a, most)
        wb, _ = simhash._windows(home, b, most)
        within = (own != other).sum(axis=1) <= radius
        one = (home[within] == away[within]) | np.isin(np.abs(home[within] - away[within]), place)
        assert one.all()
        met |= within & (np.bitwise_count(wa ^ wb) <= near)
    assert met.all()


def test_simhash_crowded_cell_of_copies(monkeypatch):
    """Pairs that are replaced by stars on the way leave the components as they are."""
    monkeypatch.setattr(simhash, "HELD_PAIRS", 50)
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(2)
    flips = rng.random((120, simhash.BITS)) < rng.uniform(0, 0.12, (120, 1))
    f = np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    x, y = simhash.close_pairs(f, f[:, 0], 120, 64, simhash.MAX_DISTANCE)
    pairs = brute.near_pairs(f.tolist(), simhash.MAX_DISTANCE)
    assert brute.roots(120, list(zip(x.tolist(), y.tolist()))) == brute.roots(120, pairs) and len(pairs) > 1000


def test_large_cells_are_split_without_loss(spark, sf):
    df = read(spark, sf, "documents")
    whole, split = ({tuple(r) for r in simhash.near_groups(df, block=b).collect()} for b in (simhash.BLOCK, 2))
    assert whole == split and whole


def test_fingerprints_equal_plain_python():
    texts = ["a b c", "The the THE cat", "", "word " * 5000 + "other", " ".join(f"w{i}" for i in range(70_000)), "ü é 漢字 \n x"]
    table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64).tolist()
    full = 2**64 - 1

    def mixed(h: int) -> int:
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ h >> 27) * 0x94D049BB133111EB & full
        return h ^ h >> 31

    def word_hash(w: bytes) -> int:
        total = sum((table[c] * 2 + 1) * pow(0x9E3779B97F4A7C15, i, 2**64) for i, c in enumerate(w))
        return mixed(total + len(w) * 0xD6E8FEB86659FD93 & full)

    for text, got in zip(texts, simhash.fingerprints([t.encode() for t in texts]).tolist()):
        hashes = [word_hash(w.encode()) for w in set(brute.words(text))]
        for k, value in enumerate(got):
            bits = [mixed((h + (k + 1) * 0x9E3779B97F4A7C15) & full) for h in hashes]
            assert value == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in bits) > len(bits))


def test_segment_counts_are_a_lower_bound():
    f = np.random.default_rng(0).integers(0, 1 << 63, (200, 3), dtype=np.uint64)
    counts = simhash.segment_counts(f).astype(int)
    l1 = np.abs(counts[:, None] - counts[None]).sum(axis=2)
    hamming = np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2)
    assert (l1 <= hamming).all() and counts.shape == (200, 48)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(2, 6)))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(8)] + [(8, "short"), (9, None)]

    def damaged(text: str, n: int) -> str:
        for _ in range(n):
            at, kind = rng.randrange(len(text)), rng.random()
            text = text[:at] + (rng.choice("abcdxy") if kind < 0.66 else "") + text[at + (kind > 0.33) :]
        return text

    docs = []
    for d in range(60):
        body = [word() for _ in range(25)]
        if d % 2:
            body.insert(rng.randrange(25), damaged(rng.choice(items[:8])[1], rng.randrange(6)))
        docs.append((d, "  ".join(body).upper() if d % 3 else "\n".join(body)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = set()
    for d, text in docs:
        for i, item in items[:8]:
            item = decontaminate.normalised(item)
            least = brute.least_distance(item, decontaminate.normalised(text))
            if least <= decontaminate.budget(item, 0.06):
                want.add((d, i, least))
    assert 5 < len(want) < 60
    want |= {(d, 8, 0) for d, text in docs if "short" in brute.words(text)}
    for chunk in (10**6, 60):
        got = decontaminate.contaminated(df, bench, chunk_chars=chunk)
        assert {tuple(r)[:3] for r in got.collect()} == want
        assert {r.doc_id for r in decontaminate.decontaminate(df, bench, chunk_chars=chunk).collect()} == {d for d, _ in docs} - {d for d, _, _ in want}


def test_short_items_count_as_whole_words(spark):
    items = spark.createDataFrame([(1, "Paris"), (2, "42"), (3, "a b"), (4, " "), (5, "x")], "item_id long, text string")
    docs = [(1, "the answer is paris."), (2, "parish 420 ca b"), (3, "(42) A  B"), (4, "x"), (5, ""), (6, "xx yx x1 \u00e9x"), (7, "pariss paris")]
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1, 0), (3, 2, 0), (3, 3, 0), (4, 5, 0), (7, 1, 0)}


def test_decontamination_awkward(spark, awkward, empty):
    bench = spark.createDataFrame([(1, brute_item := "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (2, None), (3, ""), (4, brute_item)], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.contaminated(awkward, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.distance) for r in found) == sorted((d, i, 0) for d in (4, 4, 5, 0) for i in (1, 4))
    assert decontaminate.decontaminate(awkward, bench).count() == awkward.count() - 4
    assert decontaminate.decontaminate(awkward, none).count() == awkward.count()
    assert decontaminate.contaminated(empty, bench).count() == 0


def test_myers_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 90))) for _ in range(2))
        assert decontaminate.myers(decontaminate.pattern_masks(a), len(a), b)[0] == brute.least_distance(a, b)


def _spread(rng, tag, n):
    return [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]


@pytest.mark.parametrize("limit", (passages.BROADCAST_IDS, 0))
def test_passages_against_all_runs_of_words(spark, corpus, limit):
    """Every run of 51 words that an earlier document holds is covered; documents without a run of 30 stay out."""
    rng = random.Random(4)
    docs = [(d, t) for d, t, _ in corpus]
    for k in range(60):  # passages inside lines, across lines, and cut off by the end of the text
        own = _spread(rng, f"p{k % 20}x", 0) + [f"p{k % 20}x{i}" for i in range(51 + k % 20)]
        words = [*_spread(rng, "a", rng.randrange(50)), *own, *_spread(rng, "b", rng.randrange(50) * (k % 3 > 0))]
        docs.append((10_000 + k, "".join(w + rng.choice("    \n") for w in words)))
    runs = brute.repeated_runs(docs, 51)
    strangers = {d for d, _ in docs} - set(brute.repeated_runs(docs, 30)) - {e for x in brute.repeated_runs(docs, 30).values() for _, e in x}
    found = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), broadcast_ids=limit).collect()
    assert len(runs) > 40 and len(strangers) > 50
    covered = {}
    for r in found:
        covered.setdefault(r.doc, set()).update(range(r.begin, r.begin + r.words))
        assert r.keep_doc < r.doc and r.words <= len(brute.words(dict(docs)[r.doc]))
    for d, places in runs.items():
        assert all(covered[d] & set(range(i, i + 51)) for i, _ in places)
    assert not strangers & ({r.doc for r in found} | {r.keep_doc for r in found})


def test_passages_word_for_word_are_exactly_those_long_enough(spark):
    rng = random.Random(8)
    docs = []
    for k in range(80):
        shared = [f"s{k // 2}x{i}" for i in range(38 + k // 2)]
        docs.append((k, " ".join(_spread(rng, "a", 60) + shared + _spread(rng, "b", 40))))
    got = {(r.doc, r.keep_doc) for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), min_jaccard=1.0).collect()}
    assert got == {(k, k - 1) for k in range(80) if k % 2 and 38 + k // 2 >= passages.MIN_WORDS}


def test_passages_with_edits(spark):
    rng = random.Random(9)
    docs = []
    for k in range(60):
        for side in range(2):
            passage = [f"n{k}x{i}" if not side or i % 30 != 15 else "other" for i in range(120)]
            docs.append((2 * k + side, " ".join(_spread(rng, "a", 60) + passage + _spread(rng, "c", 30))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert passages.repeated_passages(df, min_jaccard=1.0).count() == 0
    for block in (passages.BLOCK, 1):
        got = {(r.doc, r.keep_doc) for r in passages.repeated_passages(df, block=block).collect()}
        assert got <= {(2 * k + 1, 2 * k) for k in range(60)} and len(got) >= 57
    assert passages.recall(passages.MIN_JACCARD) > 0.98


def test_similar_sets_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        base = rng.integers(0, 60, (4, 12))
        sets = [np.unique(np.where(rng.random(12) < 0.2, rng.integers(0, 60, 12), base[rng.integers(4)])) for _ in range(14)]
        near = [(i, j) for i in range(14) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))]
        assert brute.roots(14, passages.similar(sets, 0.5)) == brute.roots(14, near)
        if _ % 2:  # all hold the same values besides
            sets = [np.r_[x, 100 + np.arange(_)] for x in sets]
            near = [(i, j) for i in range(14) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))]
            assert brute.roots(14, passages.similar(sets, 0.5)) == brute.roots(14, near)


def test_passages_awkward(spark, awkward, empty):
    got = {(r.doc, r.keep_doc, r.begin, r.words) for r in passages.repeated_passages(awkward).collect()}
    assert got == {(4, None, 0, 60), (5, None, 0, 60)}  # equal texts: the null id comes first
    out = passages.dedup_passages(awkward).where("text like 'w0 %'").collect()
    assert [r.doc_id for r in out] == [None]
    assert passages.repeated_passages(empty).count() == 0
    own = spark.createDataFrame([(1, "a " * 500), (2, "\u00e9 " * 30)], "doc_id long, text string")
    assert passages.repeated_passages(own).count() == 0  # repeats within one document, and short texts


def test_passages_are_cut_out(spark):
    words = [f"q{i}" for i in range(60)]
    docs = [(1, "first\n" + " ".join(words)), (2, "head\n" + " ".join(words[:30]) + "\n" + " ".join(words[30:]) + " tail\nend")]
    out = {r.doc_id: (r.text, r.n_chars) for r in passages.dedup_passages(spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, n_chars long")).collect()}
    assert out[1] == (docs[0][1], 0)
    left = out[2][0].split()
    assert left[0] == "head" and left[-2:] == ["tail", "end"] and len(left) < 63 - 37 and out[2][1] == len(out[2][0])
