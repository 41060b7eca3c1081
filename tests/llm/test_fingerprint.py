import hashlib
import re
import time
from collections import Counter

from lexiforge.llm.fingerprint import PARAGRAPH, fingerprint_hex, lane_sums, op9_fingerprint, paragraphs, reduced, two_texts
from pyspark.sql import functions as F


def brute_lanes(text):
    out = [0] * 180
    for u, times in Counter(re.findall(PARAGRAPH, text)).items():
        h = hashlib.sha256(u.encode()).hexdigest()
        for i in range(3):
            w = int(h[15 * i : 15 * i + 15], 16)
            for s in range(60):
                out[60 * i + s] += times if w >> s & 1 else -times
    return [(x + 32768) % 65536 - 32768 for x in out]


def hexed(v):
    return "".join(f"{x % 65536:04x}" for x in v)


def like(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    if a == b:
        return 1.0
    size = dot(a, a) ** 0.5 * dot(b, b) ** 0.5
    return round(max(0.0, min(1.0, dot(a, b) / size)), 6) if size else 0.0


def brute(rows):
    ids = sorted({i for i, _ in rows if i is not None}, reverse=True)
    nxt = {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}
    first = {i: min((t or "") for j, t in rows if j == i) for i in ids}
    out = []
    for i, t in rows:
        t, n = t or "", "" if i is None else first[nxt[i]]
        k = len(t) // 3
        edited = t[: len(t) - k] + n[:k]
        a, b, c = map(brute_lanes, (t, edited, n))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), like(a, b), like(a, c)))
    return out


key = lambda r: (str(r[0]), *map(str, r[1:5]))


def test_query(spark, folder, empty, docs):
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=key)
    got = sorted(map(tuple, op9_fingerprint(spark, folder).collect()), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[k] - w[k]) < 2e-6 for g, w in zip(got, want) for k in (5, 6))
    assert op9_fingerprint(spark, empty).count() == 0


def prints(rows):
    units = two_texts(*(paragraphs(F.col(c)) for c in ("a", "b", "c")))
    sums = lane_sums(rows.select("i", units.alias("units")), ["i"], "units")
    sums = sums.select("i", *(reduced(F.col(c)).alias(c) for c in ("first", "second")))
    got = sums.select("i", *(fingerprint_hex(c).alias(c) for c in ("first", "second"))).orderBy("i").collect()
    return [tuple([int(f[i : i + 4], 16) for i in range(0, 720, 4)] for f in r[1:]) for r in got]


def test_order_free_and_incremental(spark):
    a, b, c = "One line.\n", "Another line.\n", "A third one!\n"
    rows = spark.createDataFrame([(0, a + b + c, "", ""), (1, c + a + b, "", ""), (2, a + b, c, ""), (3, c, "", a)], "i int, a string, b string, c string")
    (f0, _), (f1, _), (all3, two), (one, more) = prints(rows)
    assert f0 == f1 == all3 and [(x + y) % 65536 for x, y in zip(two, one)] == f0
    assert [(x + y) % 65536 for x, y in zip(brute_lanes(c), brute_lanes(a))] == more


def test_a_million_paragraphs(spark):
    n = (1 << 20) + 7
    t = time.time()
    first, second = prints(spark.createDataFrame([(0, "a." * n, "b.", "")], "i int, a string, b string, c string"))[0]
    one, other = brute_lanes("a."), brute_lanes("b.")
    assert first == [(n * x + y) % 65536 for x, y in zip(one, other)] and second == [n * x % 65536 for x in one]
    assert time.time() - t < 120


def test_reduced_lanes_give_the_likeness(spark, tmp_path):
    """Counts beyond 2**15 are read modulo 2**16, as the fingerprint has them."""
    rows = [(2, "a." * 40_000 + "other words. " * 10), (1, "a." * 50_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op9_fingerprint(spark, str(tmp_path)).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want] and all(abs(g[k] - w[k]) < 2e-6 for g, w in zip(got, want) for k in (5, 6))


def test_plan_is_native(spark, folder):
    plan = op9_fingerprint(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
