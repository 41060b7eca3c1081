import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexiforge.llm.collocations import Buckets, Words, _merge, bits_for, collocations, frequent_phrases, has, keys, op11_collocations


def counts(docs, longest):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    return f, n


def brute(docs, longest=4, least=30, top=2000, cover=80):
    f, n = counts(docs, longest)
    cands = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longer: Counter = Counter()
    for (lang, w), a in cands.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[lang, w[i : i + m]] = max(longer[lang, w[i : i + m]], a)
    out: dict = {}
    for (lang, w), a in cands.items():
        if longer[lang, w] and 100 * longer[lang, w] >= cover * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(25)] + ["Été", "漢字", "X\x1cy", "a\xa0b"]
    texts = ["".join(rng.choice(words) + rng.choice(["  ", " ", "\t", " ", " ", " ", ". ", ",", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs = [(rng.choice(["en", "de", None, "und"]), t) for t in texts]
    return docs + [("en", "one template of words, again")] * 90 + [(None, None), ("en", ""), ("x", "a b c d e f")]


@pytest.mark.parametrize("bits", [20, 21])
def test_against_brute_force(spark, corpus, bits):
    df = spark.createDataFrame([(*r, 1, "x") for r in corpus], "lang string, text string, n long, phrase string").repartition(4)
    got = rows(collocations(df, least=4, top=40, bits=bits))
    assert got == brute(corpus, least=4, top=40) and len(got) > 80


def test_every_frequent_phrase_and_no_other(spark, corpus):
    df = spark.createDataFrame(corpus, "lang string, text string").repartition(3)
    levels, totals = frequent_phrases(df, longest=5, least=8)
    f, n = counts(corpus, 5)
    for k, level in enumerate(levels, 1):
        assert {((r.lang, tuple(r.phrase.split(" "))), r.f) for r in level.collect()} == {(p, a) for p, a in f.items() if len(p[1]) == k and a >= 8}
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in n.items() if v}


def test_odd_texts_and_empty_tables(spark, docs):
    want = [(r.lang, r.text) for r in docs.collect()]
    assert rows(collocations(docs, least=2)) == brute(want, least=2)
    assert collocations(docs.limit(0)).count() == 0


def test_buckets_add_up_and_stop_at_the_threshold():
    key = np.array([1 << 63, 1 << 63, 5 << 44, 6 << 44], np.uint64)
    tasks = [Buckets(20, 3), Buckets(20, 3)]
    for b in tasks:
        b.add(key)
    assert tasks[0].counts.max() == 2 and tasks[0].counts.sum() == 4
    rows = [r.select(["part", "data"]) for b in tasks for r in b.rows()]
    merged = {p: np.frombuffer(d, np.uint8) for r in _merge(3)(iter(rows)) for p, d in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True)}
    bitmap = merged[0]
    assert has(bitmap, key, 20).tolist() == [True, True, False, False]
    tasks[0].add(np.repeat(key[:1], 1000))
    assert tasks[0].counts.max() == 3
    assert bits_for(0) == 20 and bits_for(1 << 62) == 27


def test_pieces_and_words():
    w = Words(pa.array(["A b. c  D\td", None, "", "e", "f,g"]))
    assert w.phrases(np.array([0, 2, 3]), 2).to_pylist() == ["a b", "c d", "d d"]
    assert w.doc.tolist() == [0, 0, 0, 0, 0, 3, 4, 4] and len(set(w.piece.tolist())) == 5
    assert len(keys(w.hashes[:1], np.zeros(1, np.uint64), 2)) == 0


def test_query(spark, folder, empty):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert rows(op11_collocations(spark, folder)) == brute(docs)
    assert op11_collocations(spark, empty).count() == 0
