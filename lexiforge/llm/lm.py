"""Gated recurrent language model with a class-factored output.

1. Words are counted over all training texts (partial counts in each task, summed by hash bucket).
2. The WORDS commonest words have ids of their own; any other word has one of RARE ids, by its last two bytes,
   and within it the smoothed share of its count. The end of a text is a word.
3. A gated recurrent network is trained by truncated backpropagation through time in numpy. Each round, every
   task walks through its share of the training texts (each text is walked once over all rounds), starting from
   the common weights; the tasks' weights are then averaged. P(id) = P(class) P(id | class).
4. Scoring runs whole texts through windows and carries the state from one to the next. Words outside the
   FREQUENT commonest get their counts from the sharded count table, by a shuffle of their hashes.

Words are told apart by 64-bit hashes. Nothing that is broadcast or collected grows with the corpus: the weights,
the FREQUENT commonest words and the RARE ids' totals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _stream, buckets_for, crc_remainder, materialize, mix, slabs, small_batches, text_buffer, word_hashes

WORDS, RARE, FREQUENT, PER_CLASS, HIDDEN = 960, 64, 1 << 16, 32, 24
WINDOW, LANES, ROUNDS, RATE, CALM, SEGMENT = 32, 256, 3, 0.1, 1e-6, 512
END = int(_stream("end of text", 1)[0])
_PART = 1 << 14


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts with the end after each, the words' rare ids, and the n+1 offsets."""
    buf, offs = text_buffer(text)
    h, at, two = word_hashes(buf, offs, lower=True, tails=True)
    n = at[1:] - at[:-1]
    where = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
    out = np.full(len(h) + len(n), END, np.uint64)
    rare = np.zeros(len(out), np.int64)
    out[where] = h
    rare[where] = (mix(two.astype(np.uint64)) % np.uint64(RARE)).astype(np.int64)
    return out, rare, at + np.arange(len(at))


# ---- counts


def _count(n_buckets: int, keep: int = 400_000):
    """Partial counts: for each bucket hashes, counts and rare ids."""

    def run(batches):
        hs: list[np.ndarray] = []
        rs: list[np.ndarray] = []
        cs: list[np.ndarray] = []
        size = 0

        def flush():
            h, first, inv = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
            c, r = np.bincount(inv, np.concatenate(cs)).astype(np.int64), np.concatenate(rs)[first]
            bucket = ((h >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
            cut = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))
            some = [(b, i, j) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            data = [h[i:j].tobytes() + c[i:j].astype("<u4").tobytes() + r[i:j].astype(np.uint8).tobytes() for _, i, j in some]
            return h, c, r, pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in some], pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

        for _, text in slabs(batches, []):
            h, r, _ = tokens(text)
            u, first, c = np.unique(h, return_index=True, return_counts=True)
            hs.append(u)
            rs.append(r[first])
            cs.append(c)
            size += len(u)
            if size > 4 * keep:
                h, c, r, out = flush()
                hs, rs, cs, size = [h], [r], [c], len(h)
                if size > keep:
                    hs, rs, cs, size = [], [], [], 0
                    yield out
        if hs:
            yield flush()[3]

    return run


def _unpack(raw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = raw.size // 13
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64), np.frombuffer(raw, np.uint8, n, 12 * n)


def _sum_counts(top: int):
    """A partition's summed counts (kind 0), its commonest words (kind 1) and totals (kind 2)."""

    def run(batches):
        parts: dict[int, list] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                parts.setdefault(k, []).append(_unpack(data.as_buffer()))
        for k, got in parts.items():
            h, first, inv = np.unique(np.concatenate([g[0] for g in got]), return_index=True, return_inverse=True)
            c, r = np.bincount(inv, np.concatenate([g[1] for g in got])).astype(np.int64), np.concatenate([g[2] for g in got])[first]
            pack = lambda i: h[i].tobytes() + np.minimum(c[i], 0xFFFFFFFF).astype("<u4").tobytes() + r[i].tobytes()  # noqa: E731, B023
            rows = [(k, 0, pack(np.arange(len(h))))]
            best = np.lexsort((h, -c))[:top]
            rows += [(k, 1, h[best].tobytes() + c[best].tobytes() + r[best].astype(np.int64).tobytes())]
            total = np.concatenate(([c.sum(), len(c)], np.bincount(r, c, RARE).astype(np.int64), np.bincount(r, minlength=RARE)))
            rows += [(k, 2, total.astype(np.int64).tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.binary())], ["bucket", "kind", "data"])

    return run


def _commonest(top: int):
    """Of words dealt to a few tasks the commonest of each."""

    def run(batches):
        best = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for b in batches:
            for data in b.column(0):
                raw = data.as_buffer()
                n = raw.size // 24
                for k, t in enumerate(("<u8", "<i8", "<i8")):
                    best[k] = np.concatenate([best[k], np.frombuffer(raw, t, n, 8 * n * k)])
                order = np.lexsort((best[0], -best[1]))[:top]
                best = [x[order] for x in best]
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(x.tobytes() for x in best)], pa.binary())], ["data"])

    return run


class Lexicon:
    """The commonest words' counts and ids, and the rare ids' totals."""

    def __init__(self, h: np.ndarray, c: np.ndarray, r: np.ndarray, total: np.ndarray, words: int = WORDS):
        self.n, self.v = int(total[0]), int(total[1])
        end = np.flatnonzero(h == END)
        order = np.argsort(h)
        ids = np.full(len(h), -1, np.int64)
        ids[: words - 1] = np.arange(len(ids[: words - 1]))
        if len(end) and ids[end[0]] < 0:
            ids[end[0]] = words - 1
        self.h, self.c, self.id = h[order], c[order], ids[order]
        own = ids >= 0
        # what the words with ids of their own leave to the rare ids
        self.rare_n = total[2 : 2 + RARE] - np.bincount(r[own], c[own], RARE)[:RARE].astype(np.int64)
        self.rare_v = total[2 + RARE :] - np.bincount(r[own], minlength=RARE)[:RARE]
        self.words = words
        by_id = np.zeros(words + RARE)
        by_id[ids[own]] = c[own]
        by_id[words:] = self.rare_n
        self.by_id = by_id

    def find(self, h: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and counts (-1: not among the commonest)."""
        if not len(self.h):
            return self.words + rare, np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = self.h[at] == h
        ids = np.where(hit & (self.id[at] >= 0), self.id[at], self.words + rare)
        ids[h == END] = self.id[at][h == END] if hit[h == END].all() else self.words - 1
        return ids, np.where(hit, self.c[at], -1)


def count_words(docs: DataFrame) -> tuple[DataFrame, Lexicon]:
    """The sharded count table (bucket, data) of all texts of docs, and the lexicon."""
    n = buckets_for(docs, 0.6)
    table = materialize(docs.mapInArrow(_count(n), "bucket int, data binary").repartitionById(n, F.col("bucket")).mapInArrow(_sum_counts(FREQUENT), "bucket int, kind int, data binary"))
    top = table.where("kind = 1").select("data")
    while n > 64:  # a bucket's list has a fixed size, so merge a few dozen at a time
        n = -(-n // 64)
        top = top.repartition(n).mapInArrow(_commonest(FREQUENT), "data binary")
    best = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for r in top.repartition(1).mapInArrow(_commonest(FREQUENT), "data binary").collect():
        k = len(r.data) // 24
        best = [np.frombuffer(r.data, t, k, 8 * k * i) for i, t in enumerate(("<u8", "<i8", "<i8"))]
    total = np.zeros(2 + 2 * RARE, np.int64)
    sums = table.where("kind = 2").repartition(max(1, n)).mapInArrow(_total, "data binary")
    for r in sums.collect():
        total += np.frombuffer(r.data, "<i8")
    return table.where("kind = 0").select("bucket", "data"), Lexicon(*best, total)


def _total(batches):
    total = np.zeros(2 + 2 * RARE, np.int64)
    for b in batches:
        for data in b.column(b.schema.get_field_index("data")):
            total += np.frombuffer(data.as_buffer(), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])


# ---- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Gru:
    """z, r = sigmoid(x + h U); n = tanh(x + r h U); h' = (1 - z) n + z h. The input table holds each id's x."""

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        n, k = len(counts), -(-len(counts) // PER_CLASS)
        self.hidden, self.n, self.k = hidden, n, k
        # commonest ids first, so that classes hold ids of like counts
        order = np.argsort(-counts, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        share = np.full(k * PER_CLASS, 1e-9)
        share[:n] = counts[order] + 0.5
        share = share.reshape(k, PER_CLASS)
        f = np.float32
        self.w = {
            "x": (rng.standard_normal((n + 1, 3 * hidden)) * 0.1).astype(f),
            "u": (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f),
            "c": np.zeros((hidden + 1, k), f),
            "o": np.zeros((k, PER_CLASS, hidden + 1), f),
        }
        self.w["c"][hidden] = np.log(share.sum(1))
        self.w["o"][:, :, hidden] = np.log(share / share.sum(1, keepdims=True))

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.w.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name, a in self.w.items():
            self.w[name] = flat[at : at + a.size].reshape(a.shape).astype(np.float32)
            at += a.size

    def forward(self, ids: np.ndarray, h: np.ndarray):
        """ids (steps, lanes) read one after the other: the state before each, and what the backward pass needs."""
        d, x, u = self.hidden, self.w["x"], self.w["u"]
        t, b = ids.shape
        states = np.empty((t + 1, b, d), np.float32)
        gates = np.empty((t, b, 4 * d), np.float32)
        states[0] = h
        for i in range(t):
            gx = x[ids[i]]
            gh = states[i] @ u
            zr = _sigmoid(gx[:, : 2 * d] + gh[:, : 2 * d])
            n = np.tanh(gx[:, 2 * d :] + zr[:, d:] * gh[:, 2 * d :])
            z = zr[:, :d]
            states[i + 1] = n + z * (states[i] - n)
            gates[i, :, : 2 * d], gates[i, :, 2 * d : 3 * d], gates[i, :, 3 * d :] = zr, n, gh[:, 2 * d :]
        return states, gates

    def log_p(self, h: np.ndarray, ids: np.ndarray, grads: dict | None = None):
        """Natural log P(id | state) of each; with grads also their sum's gradients, and those of the states."""
        place = self.place[ids]
        cls, inside = place // PER_CLASS, place % PER_CLASS
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        h, cls, inside = h[order], cls[order], inside[order]
        rows = np.arange(len(h))
        # |h| is under 1, so logits stay far from what overflows unless weights run away; then they are cut
        logit = h @ self.w["c"][:-1]
        logit += self.w["c"][-1]
        np.minimum(logit, 80, out=logit)
        e = np.exp(logit)
        s = e.sum(1, keepdims=True)
        out = logit[rows, cls] - np.log(s[:, 0])
        dh = None
        if grads is not None:
            e /= -s
            e[rows, cls] += 1
            grads["c"][:-1] += h.T @ e
            grads["c"][-1] += e.sum(0)
            dh = e @ self.w["c"][:-1].T
        cut = np.searchsorted(cls, np.arange(self.k + 1))
        for c in np.flatnonzero(cut[1:] > cut[:-1]):
            i, j = cut[c], cut[c + 1]
            w = self.w["o"][c]
            logit = h[i:j] @ w[:, :-1].T
            logit += w[:, -1]
            np.minimum(logit, 80, out=logit)
            e = np.exp(logit)
            s = e.sum(1, keepdims=True)
            at = np.arange(j - i)
            out[i:j] += logit[at, inside[i:j]] - np.log(s[:, 0])
            if grads is not None:
                e /= -s
                e[at, inside[i:j]] += 1
                grads["o"][c, :, :-1] += e.T @ h[i:j]
                grads["o"][c, :, -1] += e.sum(0)
                dh[i:j] += e @ w[:, :-1]
        back = np.empty_like(out)
        back[order] = out
        if dh is None:
            return back, None
        dback = np.empty_like(dh)
        dback[order] = dh
        return back, dback

    def backward(self, ids: np.ndarray, states: np.ndarray, gates: np.ndarray, dstates: np.ndarray, grads: dict) -> None:
        """Adds the gradients through all steps; dstates: those of states[1:] from the outputs."""
        d, u = self.hidden, self.w["u"]
        t, b = ids.shape
        dx = np.empty((t, b, 3 * d), np.float32)
        dg = np.empty((t, b, 3 * d), np.float32)
        dh = np.zeros((b, d), np.float32)
        for i in range(t - 1, -1, -1):
            dh = dh + dstates[i]
            z, r, n, ghn = (gates[i, :, k * d : (k + 1) * d] for k in range(4))
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (states[i] - n) * z * (1 - z)
            dr = dn * ghn * r * (1 - r)
            dx[i, :, :d], dx[i, :, d : 2 * d], dx[i, :, 2 * d :] = dz, dr, dn
            dg[i, :, :d], dg[i, :, d : 2 * d], dg[i, :, 2 * d :] = dz, dr, dn * r
            dh = dh * z + dg[i] @ u.T
        grads["u"] += states[:-1].reshape(-1, d).T @ dg.reshape(-1, 3 * d)
        flat = ids.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        head = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
        grads["x_rows"] = flat[order][head]
        grads["x"] = np.add.reduceat(dx.reshape(-1, 3 * d)[order], head, axis=0)

    def windows(self, ids: np.ndarray, offs: np.ndarray, lanes: int, goes_on: np.ndarray | None = None):
        """Walk all texts in lanes, longest first; a lane takes the next text when its own ends.

        goes_on: texts that are the next part of the one before. Yields (steps x lanes inputs, targets, target's
        text (-1: none), lanes that begin a text)."""
        if goes_on is None:
            goes_on = np.zeros(len(offs) - 1, bool)
        begin, end = offs[:-1], offs[1:]
        todo = np.argsort(begin - end, kind="stable")
        todo = todo[(end - begin)[todo] > 0]
        lanes = max(1, min(lanes, len(todo)))
        text, at, nxt = np.full(lanes, -1), np.zeros(lanes, np.int64), 0
        steps = np.arange(WINDOW)[:, None]
        while True:
            idle = np.flatnonzero(text < 0)
            take = todo[nxt : nxt + len(idle)]
            nxt += len(take)
            fresh = idle[: len(take)]
            text[fresh], at[fresh] = take, begin[take]
            if (text < 0).all():
                return
            if len(take) < len(idle):  # fewer texts than lanes: go on with those that are left
                keep = np.flatnonzero(text >= 0)
            else:
                keep = np.arange(lanes)
            t, p = text[keep], at[keep]
            pos = p[None, :] + steps
            ok = pos < end[t][None, :]
            pos = np.minimum(pos, end[t][None, :] - 1)
            goal = ids[pos]
            before = np.where((pos > begin[t][None, :]) | goes_on[t][None, :], ids[np.maximum(pos - 1, 0)], self.n)  # n stands for the start
            yield before, goal, np.where(ok, t[None, :], -1), keep, np.isin(keep, fresh)
            at[keep] += WINDOW
            done = keep[at[keep] >= end[text[keep]]]
            text[done] = -1

    def score(self, ids: np.ndarray, offs: np.ndarray, lanes: int = 512) -> np.ndarray:
        """Natural log-likelihood of each text, its state carried across windows."""
        out = np.zeros(len(offs) - 1)
        h = np.zeros((lanes, self.hidden), np.float32)
        for before, goal, text, keep, fresh in self.windows(ids, offs, lanes):
            h[keep[fresh]] = 0
            # a token's state has read the one before it
            states, _ = self.forward(before, h[keep])
            h[keep] = states[-1]
            ok = text >= 0
            lp, _ = self.log_p(states[1:][ok], goal[ok])
            out += np.bincount(text[ok], lp, len(out))
        return out

    def train(self, ids: np.ndarray, offs: np.ndarray, memory: dict, rate: float = RATE, lanes: int = LANES) -> int:
        """One walk over the texts with Adagrad after each window; memory keeps its sums of squares.

        Long texts are walked in parts of SEGMENT tokens side by side, else one text would have the last word."""
        n = np.diff(offs)
        each = np.maximum(1, -(-n // SEGMENT))
        part = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        cut = np.append(np.repeat(offs[:-1], each) + part * SEGMENT, offs[-1])
        h = np.zeros((lanes, self.hidden), np.float32)
        for name, a in self.w.items():
            memory.setdefault(name, np.full(a.shape, CALM, np.float32))
        for before, goal, text, keep, fresh in self.windows(ids, cut, lanes, part > 0):
            h[keep[fresh]] = 0
            states, gates = self.forward(before, h[keep])
            h[keep] = states[-1]
            ok = text >= 0
            grads = {k: np.zeros_like(self.w[k]) for k in ("u", "c", "o")}
            _, dh = self.log_p(states[1:][ok], goal[ok], grads)
            d = np.zeros_like(states[1:])
            d[ok] = dh
            self.backward(before, states, gates, d, grads)
            scale = 1 / (WINDOW * lanes)  # the few lanes at the end weigh by their tokens
            rows = grads.pop("x_rows")
            for name, g in grads.items():
                g *= scale
                np.clip(g, -0.1, 0.1, out=g)
                if name == "x":
                    memory["x"][rows] += g * g
                    self.w["x"][rows] += rate * g / np.sqrt(memory["x"][rows])
                else:
                    memory[name] += g * g
                    self.w[name] += rate * g / np.sqrt(memory[name])
        return int(offs[-1] - offs[0])


def _flush_texts(batches, columns, lexicon, most: int):
    """Texts' tokens, about most at a time: (columns' values, hashes, rare ids, ids, counts, offsets)."""
    held: list = []
    size = 0

    def out():
        cols = [pa.concat_arrays([x[0][c] for x in held]) for c in range(len(columns))]
        h, r = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
        n = np.concatenate([np.diff(x[3]) for x in held])
        ids, counts = lexicon.find(h, r)
        return cols, h, r, ids, counts, np.concatenate(([0], np.cumsum(n)))

    for cols, text in slabs(batches, columns):
        h, r, offs = tokens(text)
        held.append((cols, h, r, offs))
        size += len(h)
        if size >= most:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _train(shared, lexicon, part: int = _PART, most: int = 1 << 21):
    """A task's weights after its texts, in parts, times its number of tokens."""

    def run(batches):
        lex = lexicon.value
        net, memory, n = Gru(lex.by_id), {}, 0
        net.load(shared.value)
        for _, _, _, ids, _, offs in _flush_texts(batches, [], lex, most):
            n += net.train(ids, offs, memory)
        if n:
            flat = net.flat().astype(np.float64) * n
            for k in range(0, len(flat), part):
                yield pa.RecordBatch.from_arrays([pa.array([k // part], pa.int32()), pa.array([n], pa.int64()), pa.array([flat[k : k + part].astype("<f4").tobytes()], pa.binary())], ["part", "n", "data"])

    return run


def _add(batches):
    sums: dict[int, list] = {}
    for b in batches:
        for k, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            v = np.frombuffer(data.as_buffer(), "<f4").astype(np.float64)
            into = sums.setdefault(k, [0, np.zeros(len(v))])
            into[0] += n
            into[1] += v
    for k, (n, v) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([v.astype("<f4").tobytes()], pa.binary())], ["part", "n", "data"])


def train_model(docs: DataFrame, lexicon_shared, lexicon: Lexicon, rounds: int = ROUNDS) -> np.ndarray:
    """The averaged weights after rounds; docs has text and key (a hash that deals each text to one round)."""
    spark = docs.sparkSession
    weights = Gru(lexicon.by_id).flat()
    schema = "part int, n long, data binary"
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(weights)
        got = docs.where(F.pmod(F.col("key"), F.lit(rounds)) == k).select("text").mapInArrow(_train(shared, lexicon_shared), schema)
        got = got.repartition(F.col("part"), F.pmod(F.xxhash64("data"), F.lit(16))).mapInArrow(_add, schema)
        rows = got.repartition(F.col("part")).mapInArrow(_add, schema).collect()  # the size of the weights
        if rows:
            weights = np.concatenate([np.frombuffer(r.data, "<f4") / r.n for r in sorted(rows, key=lambda r: r.part)]).astype(np.float32)
    return weights


def _score(shared, lexicon, n_buckets: int, most: int = 1 << 21):
    """Each text's score so far (kind 0), and for each bucket the hashes whose counts are still wanted (kind 1)."""

    def run(batches):
        lex = lexicon.value
        net = Gru(lex.by_id)
        net.load(shared.value)
        task, seen = TaskContext.get().partitionId() << 40, 0
        for (doc_id,), h, rare, ids, counts, offs in _flush_texts(batches, ["doc_id"], lex, most):
            m = len(offs) - 1
            doc = np.repeat(np.arange(m), np.diff(offs))
            score = net.score(ids, offs) / np.log(10)
            is_rare = ids >= lex.words
            # the rare id's share that is the word's: (c + 1) / (n + v + 1)
            score -= np.bincount(doc[is_rare], np.log10(lex.rare_n + lex.rare_v + 1)[rare[is_rare]], m)
            known = counts >= 0
            log_c = np.where(known, np.log10(np.maximum(counts, 0) + 1.0), 0.0)
            score += np.bincount(doc[is_rare], log_c[is_rare], m)
            base = np.bincount(doc, log_c, m)
            key = task + seen + np.arange(m)
            seen += m
            cols = [pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.int32()), pa.array(key), doc_id.cast(pa.int64()), pa.array(np.diff(offs)), pa.array(np.bincount(doc[known & (counts > 0)], minlength=m)), pa.array(base), pa.array(score), pa.nulls(m, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, _NAMES)
            ask = np.flatnonzero(~known)
            if len(ask):
                x, d = h[ask], doc[ask].astype("<u4")
                bucket = ((x >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
                order = np.argsort(bucket, kind="stable")
                x, d = x[order], d[order]
                cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=np.uint64))
                some = [(b, i, j) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
                k = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array([b for b, _, _ in some], pa.int32()), pa.array(np.full(k, key[0])), *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array([x[i:j].tobytes() + d[i:j].tobytes() for _, i, j in some], pa.binary())], _NAMES)

    return run


_SCORED = "kind int, bucket int, key long, doc_id long, n_tokens long, n_known long, base double, score double, data binary"
_NAMES = [c.split()[0] for c in _SCORED.split(", ")]


def _answer(batches):
    """A partition's count shards (kind 0) and wishes (kind 1): per chunk of texts their places, sums of
    log10(count + 1) and known tokens."""
    have, asks = [], []
    for b in batches:
        for kind, key, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            raw = data.as_buffer()
            if kind:
                n = raw.size // 12
                asks.append((key, np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n)))
            else:
                have.append(_unpack(raw)[:2])
    if not asks:
        return
    h = np.concatenate([x[0] for x in have]) if have else np.zeros(0, np.uint64)
    c = np.concatenate([x[1] for x in have]) if have else np.zeros(0, np.int64)
    order = np.argsort(h)
    h, c = np.append(h[order], np.uint64(_M64)), np.append(c[order], 0)
    for key, x, d in asks:
        at = np.minimum(np.searchsorted(h, x), len(h) - 1)
        n = np.where(h[at] == x, c[at], 0)
        texts, inv = np.unique(d, return_inverse=True)
        data = texts.astype("<u4").tobytes() + np.bincount(inv, n > 0).astype("<u4").tobytes() + np.bincount(inv, np.log10(n + 1.0)).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([data], pa.binary())], ["key", "data"])


def _gather(tbl: pa.Table) -> pa.Table:
    """A chunk's answers to its texts' sums."""
    texts, known, more = [], [], []
    for data in tbl.column("data"):
        raw = data.as_buffer()
        n = raw.size // 16
        texts.append(np.frombuffer(raw, "<u4", n))
        known.append(np.frombuffer(raw, "<u4", n, 4 * n))
        more.append(np.frombuffer(raw, "<f8", n, 8 * n))
    at, inv = np.unique(np.concatenate(texts), return_inverse=True)
    key = tbl.column("key")[0].as_py()
    return pa.table({"key": key + at.astype(np.int64), "more": np.bincount(inv, np.concatenate(more)), "known": np.bincount(inv, np.concatenate(known)).astype(np.int64)})


_M64 = (1 << 64) - 1


def score_texts(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text), the
    model learning from training (text, key). Null texts are empty: their one token is the end."""
    spark = docs.sparkSession
    small_batches(spark)
    table, lexicon = count_words(training.select("text"))
    shared_lexicon = spark.sparkContext.broadcast(lexicon)
    weights = spark.sparkContext.broadcast(train_model(training, shared_lexicon, lexicon))
    n = buckets_for(docs, 0.6)
    scored = materialize(docs.select("doc_id", "text").mapInArrow(_score(weights, shared_lexicon, n), _SCORED))
    # the table's shards were dealt by the training texts' own number of buckets; deal them like the wishes
    wishes = scored.where("kind = 1").select("bucket", "kind", "key", "data")
    shards = table.mapInArrow(_deal(n), "bucket int, kind int, key long, data binary")
    told = wishes.unionByName(shards).repartitionById(n, F.col("bucket")).mapInArrow(_answer, "key long, data binary")
    told = told.groupBy("key").applyInArrow(_gather, "key long, more double, known long")
    out = scored.where("kind = 0").select("key", "doc_id", "n_tokens", "n_known", "base", "score").join(told, "key", "left")
    more, floor = F.coalesce("more", F.lit(0.0)), float(np.log10(lexicon.n + lexicon.v + 1))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(lexicon.n).cast("long").alias("train_tokens"), (F.col("base") + more - F.col("n_tokens") * floor).alias("base_score"), (F.col("score") + more).alias("score"))


def _deal(n_buckets: int):
    def run(batches):
        for b in batches:
            for data in b.column(1):
                h, c, r = _unpack(data.as_buffer())
                bucket = ((h >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
                cut = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))
                some = [(k, i, j) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in some], pa.int32()), pa.array(np.zeros(len(some), np.int32)), pa.nulls(len(some), pa.int64()), pa.array([h[i:j].tobytes() + c[i:j].astype("<u4").tobytes() + r[i:j].tobytes() for _, i, j in some], pa.binary())], ["bucket", "kind", "key", "data"])

    return run


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    """log10 probability of every whole text under a model of the texts whose crc32(doc_id) mod 7 isn't 2.

    A row without doc_id has no crc32; it is not held out, but teaches nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    training = docs.where(crc_remainder("doc_id", 7) != 2).select("text", F.xxhash64("doc_id").alias("key"))
    held_out = F.coalesce(crc_remainder("doc_id", 7) == 2, F.lit(False))
    return score_texts(docs, training).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
