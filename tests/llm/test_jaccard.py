import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexiforge.llm import common, jaccard
from lexiforge.llm.jaccard import jaccard_components, link_sets, op6_jaccard


def shingles(text, k=5):
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return Counter((d, len(s), None if d is None else low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near(rng, n):
    words = [f"w{i}" for i in range(3000)]
    common = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(0, 90))]
        if rng.random() < 0.4:
            w = w[: rng.randint(0, 30)] + common[rng.randint(0, 9) :]
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i * 3 + 1, " ".join(w)))
    return rows


def test_edges(spark, folder, empty, docs):
    assert Counter(map(tuple, op6_jaccard(spark, folder).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert op6_jaccard(spark, empty).count() == 0


@pytest.mark.parametrize("kwargs", [{}, {"part_classes": 7, "sketch": 1 << 14}])
def test_brute_force(spark, kwargs):
    rows = near(random.Random(5), 500)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(r[:3] for r in jaccard_components(df, **kwargs).collect()) == brute(rows)


def test_tree_bounds():
    rng = random.Random(1)
    sets = [np.unique(np.array([rng.getrandbits(64) for _ in range(rng.randint(1, 80))], np.uint64)) for _ in range(200)]
    sets += [np.unique(np.append(s[: int(len(s) * 0.9)], np.uint64(rng.getrandbits(64)))) for s in sets]
    comp = link_sets(sets, 75)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
                assert comp[i] == comp[j]


def test_edited_copies_of_one_text_are_hardly_compared(monkeypatch):
    """A block of copies with more and fewer edits, many too far from all others: bounds tell most pairs apart."""
    rng, found, search = np.random.default_rng(1), [], jaccard.CountTree.search

    def counted(*args):
        found.append(len(out := search(*args)))
        return out

    base, edits = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (400, 1_000_000))
    sets = [np.unique(np.concatenate([base[rng.random(400) > share], rng.choice(edits, int(400 * share))])) for share in rng.uniform(0, 0.25, 300)]
    monkeypatch.setattr(jaccard.CountTree, "search", counted)
    comp = link_sets(sets, 75)
    overlap = np.array([[len(np.intersect1d(a, b)) for b in sets[:60]] for a in sets[:60]])
    size = np.array([len(s) for s in sets[:60]])
    a, b = np.nonzero(175 * overlap >= 75 * (size[:, None] + size))
    assert (comp[a] == comp[b]).all()
    assert sum(found) < len(sets) ** 2 / 8


@pytest.mark.parametrize("core", [1, 16, 1000])
def test_overlaps(monkeypatch, core):
    monkeypatch.setattr(jaccard, "CORE", core)
    rng = np.random.default_rng(2)
    sets = [np.unique(np.minimum(rng.integers(0, 900, rng.integers(1, 60)), rng.integers(1, 900))).astype(np.uint64) << np.uint64(54) for _ in range(150)]
    comp, want = link_sets(sets, 75), np.arange(150)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
                want[want == want[i]] = want[j]
    assert len(set(zip(comp, want))) == len(set(comp)) == len(set(want))


def test_hot_classes_components_and_stars(spark, monkeypatch):
    """Large groups of copies, a component of many classes and a star go the way of hot keys; the result is the same."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_PARTS", 10)
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    rows = [(i, " ".join(base[: 58 + i % 3])) for i in range(30)] + [(100 + i, " ".join([*base[:50], *(f"x{i}y{k}" for k in range(3))])) for i in range(30)]
    rows += [(200 + i, " ".join(f"z{rng.randrange(900)}" for _ in range(20))) for i in range(40)] + [(300 + i, "") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(r[:3] for r in jaccard_components(df).collect()) == brute(rows)


def test_text_hash(spark):
    df = spark.createDataFrame([(1, "abc d"), (2, ""), (3, None), (4, "é \U0001f600"), (5, "x " * 3000)], "doc_id long, text string")
    want = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64(coalesce(text, '')) as h").collect()}
    assert {r.doc_id: r.text_hash for r in jaccard_components(df).collect()} == want


def test_recurring_keys_are_sent_a_few_times():
    rng, r, sent = np.random.default_rng(1), common.Recurring(), 0
    for _ in range(100):
        keys = np.unique(np.append(rng.integers(10, 1 << 60, 50), [3, 7]).astype(np.uint64))
        known = r.known(keys)
        assert not known[keys > 7].any()
        sent += 2 - known[:2].sum()
    assert sent == 4


def test_sketch_counts_are_bytes_in_order(monkeypatch):
    """What tells common shingles from rare ones takes a byte a bucket, so that large tables have many buckets."""
    assert 1 << 26 <= jaccard.SKETCH <= 1 << 27
    n = np.array([0, 1, 2, 127, 128, 140, 300, 70_000, 1 << 31, 0xFFFFFFFF], np.uint32)
    got = jaccard.levels(n)
    assert got.dtype == np.uint8 and got[:5].tolist() == [0, 1, 2, 127, 128] and (np.diff(got.astype(int)) >= 0).all() and len(set(got[:8])) == 8
    monkeypatch.setattr(jaccard, "COUNTED", 500)
    size, part = 1 << 17, 1 << 16
    text = pa.array([" ".join(f"w{(i * 7 + j) % 90}" for j in range(40)) for i in range(200)] + ["a b c d e"] * 300)
    want = np.bincount((jaccard.shingle_sets(text, 5)[0] & np.uint64(size - 1)).astype(np.int64), minlength=size)
    sums = list(jaccard._add_counts(part)(jaccard._sketch(5, size, part)(pa.table({"text": text}).to_batches(max_chunksize=20))))
    counts = np.zeros(size, np.uint8)
    for k, data in ((k, d) for b in sums for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
        counts[k * part : (k + 1) * part] = np.frombuffer(data, np.uint8)
    assert (counts == jaccard.levels(want)).all() and counts.max() > 128
