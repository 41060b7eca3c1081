import hashlib
import random
from collections import Counter

from lexiforge.llm.substring import op10_substring, substring_dedup


def brute(rows, width=35):
    seen = Counter()
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in split:
        seen.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_edges(spark, folder, empty, docs):
    assert Counter(map(tuple, op10_substring(spark, folder).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert op10_substring(spark, empty).count() == 0
    out = substring_dedup(docs)
    assert out.columns == [*docs.columns, "__n_words", "__n_removed"] and out.count() == docs.count()


def test_overlapping_repeats(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (34, 35, 36, 60, 120)]
    rows = []
    for i in range(300):
        w = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            k = rng.randint(0, len(w))
            a = rng.randint(0, 5)
            w[k:k] = p[a:]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(900 + i, "again " * 500) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, op10_substring(spark, str(tmp_path)).collect())) == brute(rows)
