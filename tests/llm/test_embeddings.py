import numpy as np
import pytest

from lexiforge.llm.embeddings import Codes, embedding_components, op8_embed_dedup, rotation


def brute(ids, vectors, labels, least=0.93):
    n, comp = len(ids), list(range(len(ids)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    unit = []
    for v in vectors:
        a = None if v is None or any(x is None for x in v) else np.array(v, float)
        unit.append(a / np.linalg.norm(a) if a is not None and len(a) and np.isfinite(a).all() and a.any() else None)
    links = [0] * n
    for i in range(n):
        for j in range(i):
            if labels[i] is not None and labels[i] == labels[j] and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                comp[find(i)] = find(j)
    low = {}
    for i in range(n):
        low[find(i)] = min(ids[i], low.get(find(i), ids[i]))
    return {ids[i]: (links[i], low[find(i)]) for i in range(n)}


def rows_of(rng, n, dim=64):
    base = rng.standard_normal((n, dim)).astype(np.float32)
    out = []
    for i in range(n):
        v = base[rng.integers(0, max(1, i // 3 + 1))] + (0 if rng.random() < 0.3 else 1) * 0.2 * rng.standard_normal(dim) if rng.random() < 0.6 else base[i]
        out.append([float(np.float32(x)) for x in v])
    return out


@pytest.mark.parametrize("kwargs", [{}, {"per_cell": 50, "exact": 100}, {"part": 60}, {"exact": 310, "per_cell": 40, "part": 60}])
def test_recall_and_precision(spark, kwargs):
    rng = np.random.default_rng(3)
    vectors = rows_of(rng, 900)
    labels = [int(x) for x in rng.integers(0, 3, 900)]
    df = spark.createDataFrame(list(zip(range(900), vectors, labels)), "vec_id long, embedding array<float>, label int")
    want = brute(range(900), vectors, labels)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_components(df, **kwargs).collect()}
    assert got == want


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = x.mean(0)
    codes = Codes(x, c, rotation(64))
    r = (x - c) @ rotation(64) / codes.norm[:, None]
    true = r @ r.T
    got = (codes.signs(0, 500) @ r.T) / codes.factor[:, None]
    off = ~np.eye(500, dtype=bool)
    assert abs((got - true)[off].mean()) < 0.005
    assert (codes.upper(0, 500, codes, r, 3.5) >= x @ x.T - 1e-6)[off].mean() > 0.998


def test_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (13, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op8_embed_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert got[1] == (2, 1, True) and got[2] == got[3] == (2, 1, False) and got[None] == (0, None, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13))
    df.limit(0).write.parquet(f"{tmp_path}/e/embeddings.parquet")
    assert op8_embed_dedup(spark, f"{tmp_path}/e").count() == 0


def test_no_link_is_lost_between_cells(spark):
    """Pairs just above the threshold, and a dense cluster, over many cells."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((300, 64)))
    side = rng.standard_normal((300, 64))
    side = unit(side - (side * base).sum(1, keepdims=True) * base)
    cos = rng.uniform(0.931, 0.95, (300, 1))
    hot = unit(base[0] + 0.036 * rng.standard_normal((300, 64)))
    vectors = np.concatenate([base, cos * base + np.sqrt(1 - cos * cos) * side, hot]).tolist()
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    want = brute(range(900), vectors, [1] * 900)
    assert sum(w[0] for w in want.values()) > 2000
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_components(df, per_cell=15, exact=0).collect()} == want


def test_vectors_are_sent_in_rounds(spark, monkeypatch):
    """A label in many parts: no exchange has many times the vectors; vectors stay floats; links are the same."""
    from lexiforge.llm import embeddings

    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 16))
    x = (base[rng.integers(0, 40, 240)] + 0.08 * rng.standard_normal((240, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    made, real = [], embeddings.materialize
    monkeypatch.setattr(embeddings, "materialize", lambda d, **kw: made.append(real(d, **kw)) or made[-1])
    got = {r.vec_id: r.n_links for r in embedding_components(df, part=40).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert got == dict(enumerate(((u @ u.T >= 0.93).sum(1) - 1).tolist()))
    assert sum(d.columns == ["a", "b", "n"] for d in made) == 6
    assert "double" not in {t for d in made for _, t in d.dtypes if t.startswith("array")} and all("array<double>" not in t for d in made for _, t in d.dtypes)


@pytest.mark.parametrize("least", [0.93, 0.5, -0.2])
def test_around_the_origin_one_product_tells_pairs_apart(monkeypatch, least):
    """No link is excluded, hardly more is kept than by the bound, and the bound itself isn't computed."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 64))
    x = np.concatenate([base, base + 0.3 * rng.standard_normal((300, 64)), np.eye(64), -np.eye(64), base[:1]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, query = Codes(x, np.zeros(64), rotation(64)), (x @ rotation(64)).astype(np.float32)
    bound = codes.upper(0, len(x), codes, query) >= least - 1e-5
    monkeypatch.setattr(Codes, "upper", None)
    may = codes.may(0, len(x), codes, query, least)
    assert may[x @ x.T >= least].all() and may[bound].mean() > 0.999 and may.mean() < bound.mean() + 0.05


def test_a_label_beyond_fifty_thousand_is_not_dealt_to_cells(spark, monkeypatch):
    """6 GB have some 61,500 vectors a label, where visiting cells takes longer than to look at all pairs."""
    from lexiforge.llm import embeddings

    assert embeddings.EXACT >= 100_000
