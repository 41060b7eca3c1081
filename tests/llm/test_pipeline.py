import random
from collections import defaultdict

import corpus_pipeline
from lexiforge.llm.pii import base_spans
from tests_llm_brute import covered, near_groups  # noqa: I001


def corpus(rng):
    words = [f"w{i}" for i in range(800)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage = text(60)
    docs = [[i, text(rng.randint(30, 120))] for i in range(240)]
    for i in range(0, 60):
        docs[i][1][5:5] = ["grobble", "snarf", "wretch"]
    for i in range(60, 80):
        docs[i][1][3:3] = passage
    for i in range(80, 100):
        docs[i][1] += [f"bob.{i}@mail.example.com"]
    for i in range(100, 120):
        docs.append([1000 + i, [*docs[i][1][:-1], "changed"]])
    docs.append([2000, docs[130][1]])
    return [(i, " ".join(w), "en", "s", 0) for i, w in docs] + [(3000, None, "en", "s", None), (3001, "", "en", "s", None)], [(i, int(i < 60)) for i in range(200)]


def test_each_stage_against_brute_force(spark, tmp_path):
    docs, labels = corpus(random.Random(2))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = [df]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], str(tmp_path)).cache()
        if name != "packing":
            assert out.columns == df.columns
        seen.append(out)
    rows = [{r.doc_id: r.text for r in s.collect()} for s in seen[:5]]
    assert set(rows[1]) == {i for i in rows[0] if i >= 60}
    assert set(rows[2]) == {min(g) for g in near_groups(rows[1])}
    want = {i: covered(rows[2])[i] for i in rows[2]}
    assert rows[3] == {i: t for i, t in want.items() if t != "" or not rows[2][i]}
    assert set(rows[4]) == set(rows[3]) and not any(any(base_spans(t or "").values()) for t in rows[4].values())
    assert sum("<EMAIL>" in (t or "") for t in rows[4].values()) == 20
    bins = defaultdict(int)
    for r in seen[5].collect():
        bins[r.sequence_id] += r.length
    assert {r.doc_id for r in seen[5].collect()} == set(rows[4]) and max(bins.values()) <= 1024
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[5].count()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_share_a_doc_id(spark, tmp_path):
    """Near copies go by row: doc_ids with two texts, repeated rows, null ids."""
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(40))
    a, b, c, d = (text() for _ in range(4))
    near = lambda t: t + " more"
    rows = [(5, b), (5, near(a)), (2, a), (7, near(b)), (8, c), (8, c), (8, near(c)), (None, near(c)), (None, d), (None, d), (None, near(d)), (9, ""), (9, None), (9, ""), (None, " "), (4, "two words"), (4, "Two  words")]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns
    group = lambda t: (t or "").lower().removesuffix(" more").split()
    assert [(i, g) for i, g in sorted(((i or 99, group(t)) for i, t in got), key=str) if g] == sorted([(2, group(a)), (5, group(b)), (8, group(c)), (99, group(d)), (4, ["two", "words"])], key=str)
    assert sorted(t or "" for _, t in got if not group(t)) == ["", "", "", " "]
