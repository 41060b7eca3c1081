import math
import zlib
from collections import Counter

import numpy as np

from lexiforge.llm.lm import PER_CLASS, Gru, op2_lm_score


def small():
    net = Gru(np.array([9.0, 5, 4, 3, 2, 1, 1, 0, 7, 2] * 14), hidden=5)
    rng = np.random.default_rng(2)
    for a in net.w.values():
        a += (0.3 * rng.standard_normal(a.shape)).astype(np.float32)
    return net, rng


def naive(net, ids):
    """One token at a time, whole softmax."""
    h, total, before = np.zeros(5), 0.0, net.n
    w = {k: v.astype(float) for k, v in net.w.items()}
    for i in ids:
        gx, gh = w["x"][before], h @ w["u"]
        z, r = 1 / (1 + np.exp(-(gx[:5] + gh[:5]))), 1 / (1 + np.exp(-(gx[5:10] + gh[5:10])))
        n = np.tanh(gx[10:] + r * gh[10:])
        h = (1 - z) * n + z * h
        c = h @ w["c"][:-1] + w["c"][-1]
        cls, inside = divmod(net.place[i], PER_CLASS)
        o = w["o"][cls, :, :-1] @ h + w["o"][cls, :, -1]
        total += c[cls] - np.log(np.exp(c).sum()) + o[inside] - np.log(np.exp(o).sum())
        before = i
    return total


def test_state_is_carried_over_whole_texts():
    net, rng = small()
    n = [0, 1, 31, 32, 33, 200, 5, 64, 1]
    offs = np.concatenate(([0], np.cumsum(n)))
    ids = rng.integers(0, net.n, offs[-1])
    for lanes in (1, 3, 64):
        got = net.score(ids, offs, lanes)
        assert np.allclose(got, [naive(net, ids[i:j]) for i, j in zip(offs, offs[1:])], rtol=1e-4)


def test_gradients():
    net, rng = small()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    ids, goal = rng.integers(0, net.n, (6, 4)), rng.integers(0, net.n, (6, 4))

    def loss():
        states, gates = net.forward(ids, np.zeros((4, 5)))
        return states, gates, net.log_p(states[1:].reshape(-1, 5), goal.ravel())[0].sum()

    states, gates, base = loss()
    grads = {k: np.zeros_like(net.w[k]) for k in ("u", "c", "o")}
    _, dh = net.log_p(states[1:].reshape(-1, 5), goal.ravel(), grads)
    net.backward(ids, states, gates, dh.reshape(6, 4, 5), grads)
    x = np.zeros_like(net.w["x"])
    x[grads.pop("x_rows")] = grads["x"]
    grads["x"] = x
    for name, g in grads.items():
        for at in np.argsort(-np.abs(g).ravel())[:: max(1, g.size // 12)][:12]:
            w = net.w[name].reshape(-1)
            old = w[at]
            w[at] = old + 1e-2
            up = loss()[2]
            w[at] = old - 1e-2
            down = loss()[2]
            w[at] = old
            assert abs((up - down) / 2e-2 - g.ravel()[at]) < 2e-2 * max(1, abs(g.ravel()[at])), (name, at)


def words(text):
    return [*bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split(), None]


def brute(rows):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter()
    for i, t in rows:
        if i is not None and not out(i):
            count.update(words(t))
    n, v = sum(count.values()), len(count)
    return [(i, out(i), len(w := words(t)), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 4)) for i, t in rows]


def test_query(spark, folder, empty, docs):
    key = lambda r: tuple(map(str, r))
    got = op2_lm_score(spark, folder).collect()
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got], key=key) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=key)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert op2_lm_score(spark, empty).count() == 0


def test_held_out_texts_are_likelier_than_by_counts(spark):
    rows = op2_lm_score(spark, "/root/testdata/sf0.01").collect()
    base, score, n = (sum(getattr(r, k) for r in rows if r.held_out) for k in ("base_score", "score", "n_tokens"))
    print("held out, bits a token:", -base / n / math.log10(2), -score / n / math.log10(2))
    assert score > base


def test_the_network_keeps_its_width():
    """Speed is not to be bought with a smaller network."""
    from lexiforge.llm import lm

    assert lm.HIDDEN >= 24 and lm.Gru(np.ones(100)).w["u"].shape == (lm.HIDDEN, 3 * lm.HIDDEN)
