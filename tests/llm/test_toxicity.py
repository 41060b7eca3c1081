import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from lexiforge.llm.common import mix, word_hashes
from lexiforge.llm.toxicity import _HEAD, BlockMaxIndex, copy_weights, isotonic, op5_toxicity


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(60, rng.integers(1, 9), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum())))
    dense = np.zeros((700, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    at = np.concatenate(([0], np.cumsum([len(t) for t, _ in vectors])))
    index = BlockMaxIndex(at, np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors]), 60)
    for i in range(0, 700, 7):
        items, cos = index.nearest(*vectors[i], 10, skip=i)
        all_cos = dense @ dense[i]
        all_cos[i] = 0
        want = np.sort(all_cos)[::-1][: len(items)]
        assert np.allclose(np.sort(cos)[::-1], want) and (len(items) == 10 or (np.sort(all_cos)[::-1][len(items)] == 0))


def test_isotonic():
    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert y.tolist() == [0, 0.5, 0.5, 1]


def test_held_out_accuracy(spark, tmp_path):
    rng = random.Random(7)
    bad = ["grobble", "snarf", "blighter", "wretch"]
    words = [f"w{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(1200):
        w = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        toxic = int(rng.random() < 0.15)
        for _ in range(3 * toxic):
            w.insert(rng.randint(0, len(w)), rng.choice(bad))
        docs.append((i, " ".join(w)))
        if i % 2 or i < 300:
            labels.append((i, toxic))
    docs += [(None, "snarf"), (5000, None), (5001, ""), (5002, "Snarf, you WRETCH! " * 3000)]
    labels += [(5, None), (None, 1), (9999, 1)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in op5_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    wrong = [i for i, t in docs[:1200] if got[i].held_out and got[i].predicted != any(b in t.split() for b in bad)]
    assert len(wrong) <= 4
    assert got[5002].predicted == 1 and got[5000].predicted == got[5001].predicted == 0 and got[5002].neighbors


def test_edges(spark, folder, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for d in (folder, empty):
        labels.write.parquet(f"{d}/labels.parquet")
    assert op5_toxicity(spark, empty).count() == 0
    assert {r.predicted for r in op5_toxicity(spark, folder).collect()} == {0}


def test_copies_count_once():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 1 << 60, (4, 64))
    near = np.where(rng.random((5, 64)) < 0.2, rng.integers(0, 1 << 60, (5, 64)), rows[0])
    assert np.allclose(copy_weights(np.concatenate([rows, near])), [1 / 6, 1, 1, 1, *[1 / 6] * 5])
    assert len(copy_weights(np.zeros((0, 64), np.int64))) == 0


def test_all_terms_are_known(spark, tmp_path):
    """Copies of one toxic template, and of a toxic text whose words no other text has, are found."""
    rng = random.Random(3)
    text = lambda tag, n: " ".join(f"{rng.randrange(10**6):06d}{tag}" for _ in range(n))
    template, alone = text("t", 30), text("a", 40)
    taught = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = [(i, template if k < 60 else alone if k == 60 else text("c", 30), int(k <= 60)) for k, i in enumerate(taught[:600])]
    held = [i for i in range(3000, 4000) if zlib.crc32(str(i).encode()) % 3 == 1][:4]
    docs += [(held[0], template, None), (held[1], alone, None), (held[2], text("n", 30), None), (held[3], docs[100][1], None)]
    spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], d[2]) for d in docs if d[2] is not None], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in op5_toxicity(spark, str(tmp_path)).collect()}
    assert [got[i].predicted for i in held] == [1, 1, 0, 0]
    assert all(got[held[k]].cosines[0] == 1 for k in (0, 1, 3)) and got[held[1]].neighbors[0] == taught[60]


def test_score_against_brute_force(spark, tmp_path):
    """The whole way: terms, TF-IDF, cosines with every example, votes, leave-one-out calibration, prior; a doc_id
    with two rows has each term's largest count."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(120)]
    docs, labels = [], {}
    for i in range(420):
        w = [rng.choice(words) for _ in range(rng.randint(1, 30))]
        toxic = rng.random() < 0.3
        w += ["snarf", "grobble"] * toxic
        docs.append((i, " ".join(w)))
        if i < 300:
            labels[i] = int(toxic)
    docs += [(7, "W3 w3 w3 extra"), (500, docs[3][1]), (501, "nothing known"), (502, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels.items()), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((r.doc_id, round(r.score, 9)) for r in op5_toxicity(spark, str(tmp_path)).collect())

    taught = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 3 != 1)
    split = lambda t: re.findall(r"[0-9a-z]+", t.lower())

    def terms(t):
        c = Counter(split(t))
        return c + Counter({("head", h): n for h, n in Counter(w[:4] for w in split(t)).items()})

    tf = {i: Counter() for i in taught}
    for i, t in docs:
        if i in tf:
            tf[i] |= terms(t)
    ids = [i for i in taught if tf[i]]
    # near copies: the estimate of 64 minima, as the operator has it
    key = lambda w: int(word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0])
    code = lambda t: mix(np.array([key(t[1])], np.uint64) ^ _HEAD) if isinstance(t, tuple) else np.array([key(t)], np.uint64)
    seeds = mix(np.arange(1, 65).astype(np.uint64))
    codes = {t: int(code(t)[0]) for t in set().union(*tf.values())}
    minima = np.array([[min(int(mix(np.array([codes[t]], np.uint64) ^ s)[0]) for t in tf[i]) for s in seeds[:64]] for i in ids], np.uint64)
    say = dict(zip(ids, copy_weights(minima.astype(np.int64)), strict=True))
    n = [sum(say[i] for i in ids if labels[i] == c) for c in (0, 1)]
    idf, df = {}, Counter(t for _, text in docs for t in terms(text))
    for t in codes:
        b, a = (sum(say[i] for i in ids if labels[i] == c and t in tf[i]) for c in (0, 1))
        chi = sum(n) * (a * (n[0] - b) - b * (n[1] - a)) ** 2 / max(1e-9, (a + b) * (sum(n) - a - b) * max(1, n[1]) * max(1, n[0]))
        tells = chi >= 28.4 and a + b >= 4 and abs(math.log((a + 0.5) / (n[1] + 1) / ((b + 0.5) / (n[0] + 1)))) >= math.log(3)
        idf[t] = (math.log((len(docs) + 1) / (df[t] + 1)) + 1) * (1 if tells else 0.01)
    assert sum(x > 0.5 for x in idf.values()) == 4

    def vector(c):
        w = {t: (1 + math.log(k)) * idf[t] for t, k in c.items() if t in idf}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    vectors = {i: vector(tf[i]) for i in ids}

    def vote(v, skip=None):
        cos = sorted(((sum(x * vectors[i].get(t, 0) for t, x in v.items()), i) for i in ids if i != skip), reverse=True)[:15]
        cos = [(c, i) for c, i in cos if c > 0]
        w = [say[i] * c * c / max(1 - c * c, 1e-3) for c, i in cos]
        return sum(x * labels[i] for x, (_, i) in zip(w, cos, strict=True)) / sum(w)

    raw = [vote(vectors[i], i) for i in ids]
    curve = isotonic(np.array(raw), np.array([float(labels[i]) for i in ids]), np.ones(len(ids)))
    prior = sum(labels[i] for i in taught) / len(taught)
    want = []
    for i, t in docs:
        v = vector(terms(t))
        want.append((i, round(float(np.interp(vote(v), *curve)) if v else prior, 9)))
    assert [i for i, _ in got] == [i for i, _ in sorted(want)]
    off = [(g, w) for g, w in zip(got, sorted(want)) if abs(g[1] - w[1]) > 1e-6]
    assert not off, off[:5]
