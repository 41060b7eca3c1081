import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexiforge.llm.search import SHIFT, RangeTree, _trees, impacts, lexical_search, op12_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, k=20):
    """docs: (doc_id, text) rows; items: (item_id, text) rows."""
    ts = [terms_of(t) for _, t in docs]
    n, length = sum(map(bool, ts)), sum(map(len, ts))
    df = Counter(t for x in ts for t in set(x))
    queries: dict = {}
    for i, t in items:
        queries.setdefault(i, Counter()).update(terms_of(t))
    out = []
    for i, q in queries.items():
        scores = []
        for (d, _), x in zip(docs, ts, strict=True):
            m, tf, s = 75 + 25 * len(x) * n // max(length, 1), Counter(x), 0
            for t, c in q.items():
                if tf[t]:
                    s += c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m))
            if s:
                scores.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return out


ORDER = lambda x: (str(x[0]), x[1])


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=ORDER)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["été", "X1", "漢字", "a-b"]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 40))) for _ in range(400)]
    docs = [(i * 7 % 400, t) for i, t in enumerate(texts)] + [(3, texts[5]), (None, texts[9]), (None, None)] + [(1000 - i, "tie w1 tie") for i in range(50)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(30)] + [(99, "tie"), (100, None), (101, ""), (102, "none of these"), (5, "W3 w3"), (None, "w7")]
    return docs, items


def test_against_brute_force(spark, corpus):
    docs, items = corpus
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, shard string").repartition(5)
    q = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, query string")
    want = sorted(brute(docs, items), key=ORDER)
    assert rows(lexical_search(d, q)) == want
    # many ranges, many blocks of queries
    assert rows(lexical_search(d, q, range_docs=7, block_terms=60)) == want
    assert rows(lexical_search(d, q, k=3)) == sorted(brute(docs, items, 3), key=ORDER)


def test_odd_texts_and_empty_tables(spark, docs):
    items = [(1, "one two"), (2, "naïve 漢字 \U0001f600"), (3, "long7 long140000 rep rep"), (4, "example")]
    q = spark.createDataFrame(items, "item_id long, text string")
    assert rows(lexical_search(docs, q)) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()], items), key=ORDER)
    assert lexical_search(docs.limit(0), q).count() == 0 and lexical_search(docs, q.limit(0)).count() == 0


def tree_of(postings, sizes, n_terms):
    """A range's tree from its (term, doc, tf), as the job builds it."""
    import pyarrow as pa

    postings = sorted(postings)
    count = Counter(t for t, _, _ in postings)
    row = {
        "shard": "s",
        "ids": np.arange(len(sizes), dtype="<i8").tobytes() + np.packbits(np.zeros(len(sizes), bool)).tobytes(),
        "sizes": np.array(sizes, "<i8").tobytes(),
        "terms": sorted(count),
        "counts": [count[t] for t in sorted(count)],
        "docs": np.array([d for _, d, _ in postings], "<i4").tobytes(),
        "tfs": np.array([f for _, _, f in postings], "<i4").tobytes(),
    }
    built = next(_trees(len(sizes), sum(sizes))(iter([pa.RecordBatch.from_pylist([row])])))
    return RangeTree(built.to_pylist()[0])


def test_the_tree_is_opened_best_first_and_no_more_than_needed():
    rng = random.Random(3)
    n = 3000
    sizes = [rng.randint(1, 50) for _ in range(n)]
    postings = {(t, d): rng.randint(1, 3) for t in range(6) for d in rng.sample(range(n), 200 * (t + 1))}
    postings |= {(0, d): 40 for d in (5, 6, 700, 2222, 2223)}  # some documents stand out
    tree = tree_of([(t, d, f) for (t, d), f in postings.items()], sizes, 6)
    terms, weights = np.array([0, 2, 5, 77]), np.array([9000, 500, 100, 1])
    m = [75 + 25 * s * n // sum(sizes) for s in sizes]
    score = Counter()
    for (t, d), f in postings.items():
        w = dict(zip(terms.tolist(), weights.tolist(), strict=True)).get(t, 0)
        score[d] += w * int(impacts(np.array([f]), np.array([m[d]]))[0])
    want = sorted(((-s, d) for d, s in score.items() if s))[:5]
    opened: list = []
    got = sorted(((-s, -d) for s, _, d in tree.search(terms, weights, 5, 1, opened)))
    assert got == want
    bounds = [b for b, _, _ in opened]
    assert bounds == sorted(bounds, reverse=True)
    assert all(b >= -want[-1][0] for b in bounds)  # nothing below the fifth score is opened
    leaves = sum(level == 1 for _, level, _ in opened)
    assert leaves < (n >> SHIFT) / 2
    # a threshold from elsewhere leaves only what reaches it
    assert sorted(((-s, -d) for s, _, d in tree.search(terms, weights, 5, -want[1][0]))) == want[:2]


def test_equal_bounds_are_opened():
    """All documents score the same: the smallest ids win, wherever they stand."""
    tree = tree_of([(0, d, 2) for d in range(500)], [3] * 500, 1)
    tree.ids = np.arange(500)[::-1]
    got = tree.search(np.array([0]), np.array([10]), 4, 1)
    assert sorted(-d for _, _, d in got) == [0, 1, 2, 3]


def test_query(spark, folder):
    items = spark.createDataFrame([(1, "call mail 4111"), (2, "a b c")], "item_id long, text string")
    items.write.parquet(f"{folder}/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert rows(op12_search(spark, folder)) == sorted(brute(docs, [tuple(r) for r in items.collect()]), key=ORDER)
