"""Toxicity by nearest labelled examples under exact TF-IDF cosine, over a block-max inverted index.

A bounded sample of labelled rows (EXAMPLES of each class, those with the smallest hash of doc_id) gives the
examples. All their terms are indexed: lower-cased words and the words' beginnings. A term weighs by TF-IDF, its
document frequency being counted over all documents, and FAINT times that unless its rates differ between the
classes of examples, near copies counting as one text there.
Texts are scored in batches: terms of few examples from their postings, the commonest from dense blocks of
examples; a block whose bound (with its largest weight of each common term) cannot reach the k-th best cosine is
never opened, and what reaches it is computed anew in double precision, so the k nearest are exact. Votes weigh
by the squared cotangent of the angle (a copy outvotes what is merely like it), near copies sharing one vote, and
are calibrated by isotonic regression on the examples' own leave-one-out votes, reweighted to the classes' shares
of the labels.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, materialize, mix, slabs, small_batches, text_buffer, trim, word_hashes

#: CHI: the chi-square of a chance of 1e-7, as about a million terms are tried.
#: MINIMA: hashes that estimate the similarity of two examples. DENSE: terms whose weights are kept as dense blocks.
#: POSTINGS: of each class, examples beyond the first with so many terms are left out.
#: SLICE: terms whose document counts are shuffled as one row.
EXAMPLES, BLOCK, PREFIX, CHI, MINIMA, FAINT, DENSE, POSTINGS, SLICE = 3000, 64, 4, 28.4, 64, 0.01, 2048, 3_000_000, 4096
_END = np.array([not (48 <= b < 58 or 97 <= b < 123 or 65 <= b < 91 or b >= 128) for b in range(256)])
_HEAD = np.uint64(0x5851F42D4C957F2D)
#: Examples that a task votes on at a time.
LOT = 256


def _terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, term) of every word and word beginning."""
    buf, offs = text_buffer(text)
    h, at, heads = word_hashes(buf, offs, lower=True, space=_END, prefix=PREFIX)
    doc = np.repeat(np.arange(len(offs) - 1), at[1:] - at[:-1])
    return np.concatenate([doc, doc]), np.concatenate([h, mix(heads ^ _HEAD)])


def _counted(doc: np.ndarray, term: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, tf = np.unique(doc * n_terms + term, return_counts=True)
    return key // n_terms, key % n_terms, tf


class Vocabulary:
    """Places of terms in a sorted list, found by a table of 2^22 slots, of those that share one by search."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(np.asarray(terms, np.uint64))
        self.slot = self.shared = None

    def __getstate__(self):
        return self.__dict__ | {"slot": None, "shared": None}

    def __call__(self, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.terms):
            return doc[:0], np.zeros(0, np.int64)
        if self.slot is None:
            own = (self.terms & np.uint64(0x3FFFFF)).astype(np.int64)
            self.slot = np.full(1 << 22, -1, np.int32)
            self.slot[own] = np.arange(len(own))
            self.shared = np.bincount(own, minlength=1 << 22) > 1
        low = (h & np.uint64(0x3FFFFF)).astype(np.int64)
        at = self.slot[low]
        may = np.flatnonzero(at >= 0)
        doc, h, low, at = doc[may], h[may], low[may], at[may].astype(np.int64)
        other = np.flatnonzero(self.shared[low])
        at[other] = np.minimum(np.searchsorted(self.terms, h[other]), len(self.terms) - 1)
        ok = self.terms[at] == h
        return doc[ok], at[ok]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], ..., start[0] + n[0] - 1, start[1], ..."""
    return np.arange(n.sum()) + np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(n) else np.zeros(0, np.int64)


class BlockMaxIndex:
    """Unit vectors by item, the postings of rarer terms, and dense blocks of items with each block's largest weight
    of the DENSE commonest terms. All but the vectors is made on first use."""

    def __init__(self, at: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int):
        """Vector i has the terms, which are sorted, and weights from at[i] to at[i + 1]."""
        self.n, self.n_terms = len(at) - 1, n_terms
        self.at, self.term, self.w = at, terms.astype(np.int32), weights
        self.made = None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def _make(self):
        if self.made is None:
            item = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.at))
            df = np.bincount(self.term, minlength=self.n_terms)
            common = np.argsort(-df, kind="stable")[:DENSE]
            row = np.full(self.n_terms, -1, np.int64)
            row[common] = np.arange(len(common))
            own = row[self.term] >= 0
            dense = np.zeros((-(-self.n // BLOCK), len(common), BLOCK), np.float32)
            dense[item[own] // BLOCK, row[self.term[own]], item[own] % BLOCK] = self.w[own]
            rare = np.flatnonzero(~own)
            rare = rare[np.argsort(self.term[rare], kind="stable")]
            df[common] = 0
            start = np.concatenate(([0], np.cumsum(df)))
            # single precision finds what is opened; _batch computes the cosines of that from w
            self.made = row, dense, np.ascontiguousarray(dense.max(2).T), start, item[rare], self.w[rare].astype(np.float32)
        return self.made

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k items of largest cosine over 0 (ties: the smaller item), without item skip."""
        return next(self.nearest_many(np.array([0, len(terms)]), terms, weights, k, np.array([skip])))

    def nearest_many(self, at: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, skip: np.ndarray | None = None, most: int = 500_000):
        """nearest of each vector terms[at[i] : at[i + 1]], those being different and sorted."""
        row, _, _, start, _, _ = self._make()
        visits = np.concatenate(([0], np.cumsum(start[terms + 1] - start[terms])))[at]
        i, n = 0, len(at) - 1
        while i < n:
            j = max(i + 1, min(i + 192, int(np.searchsorted(visits, visits[i] + most, "right")) - 1))
            yield from self._batch(at[i : j + 1] - at[i], terms[at[i] : at[j]], weights[at[i] : at[j]], k, np.full(j - i, -1) if skip is None else skip[i:j])
            i = j

    def _batch(self, at, terms, weights, k, skip):
        row, dense, tops, start, items, w = self._make()
        m, blocks = len(at) - 1, len(dense)
        if not blocks:
            yield from ((np.zeros(0, np.int64), np.zeros(0)) for _ in range(m))
            return
        text = np.repeat(np.arange(m), np.diff(at))
        common = row[terms] >= 0
        q = np.zeros((m, dense.shape[1]), np.float32)
        q[text[common], row[terms[common]]] = weights[common]
        t, x, d = terms[~common], weights[~common], text[~common]
        n = start[t + 1] - start[t]
        r = _ranges(start[t], n)
        part = np.bincount(np.repeat(d * (blocks * BLOCK), n) + items[r], np.repeat(x.astype(np.float32), n) * w[r], m * blocks * BLOCK).astype(np.float32).reshape(m, blocks, BLOCK)
        bound = part.max(2) + q @ tops
        cosine = np.zeros((m, blocks, BLOCK), np.float32)
        flat = cosine.reshape(m, -1)
        slack = np.float32(1e-5)  # more than single precision can be off

        def reach():
            hit = skip >= 0
            flat[np.flatnonzero(hit), skip[hit]] = 0
            return np.partition(flat, -k, axis=1)[:, -k] if flat.shape[1] > k else np.zeros(m, np.float32)

        done = np.zeros((m, blocks), bool)
        first = min(4, blocks)
        todo = np.zeros((m, blocks), bool)
        todo[np.arange(m)[:, None], np.argpartition(-bound, first - 1, axis=1)[:, :first]] = True
        for _ in range(2):
            for b in np.flatnonzero(todo.any(0)):
                some = np.flatnonzero(todo[:, b])
                cosine[some, b] = part[some, b] + (q if len(some) == m else q[some]) @ dense[b]
            done |= todo
            kth = reach()
            todo = (bound > 0) & (bound >= kth[:, None] - slack) & ~done
        full = np.zeros(self.n_terms)
        for i in range(m):
            near = np.flatnonzero((flat[i] >= kth[i] - slack) & (flat[i] > 0))
            mine = slice(at[i], at[i + 1])
            full[terms[mine]] = weights[mine]
            cos = np.array([full[self.term[a:b]] @ self.w[a:b] for a, b in zip(self.at[near].tolist(), self.at[near + 1].tolist(), strict=True)])
            full[terms[mine]] = 0
            best = np.lexsort((near, -cos))[:k]
            yield near[best], cos[best]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted non-decreasing fit (pool adjacent violators): values of x and the fit there."""
    xs, inv = np.unique(x, return_inverse=True)
    ws, ys = np.bincount(inv, w), np.bincount(inv, w * y)
    pools: list[list[float]] = []
    for i in range(len(xs)):
        pools.append([ys[i], ws[i], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a = pools.pop()
            pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2] + a[2]]
    return xs, np.concatenate([np.full(int(n), s / t) for s, t, n in pools])


@dataclass
class ToxicityModel:
    vocabulary: Vocabulary
    idf: np.ndarray  # times FAINT for terms that don't tell the classes
    index: BlockMaxIndex
    label: np.ndarray
    say: np.ndarray  # the examples' shares of their near copies' vote
    ids: np.ndarray
    k: int
    prior: float  # of a text without a known term
    curve: tuple[np.ndarray, np.ndarray] | None = None
    _seen: dict = field(default_factory=dict)

    def vectors(self, at: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """The unit vectors' weights; each has a term."""
        w = (1 + np.log(tf)) * self.idf[terms]
        return w / np.repeat(np.sqrt(np.add.reduceat(w * w, at[:-1])), np.diff(at)) if len(w) else w

    def vote(self, items: np.ndarray, cos: np.ndarray) -> float:
        if not len(items):
            return self.prior
        w = self.say[items] * cos * cos / np.maximum(1 - cos * cos, 1e-3)
        return float((w * self.label[items]).sum() / w.sum())

    def score(self, at: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> list[tuple[float, list[int], list[float]]]:
        keys = [hashlib.blake2b(terms[i:j].tobytes() + tf[i:j].tobytes(), digest_size=16).digest() if j > i else b"" for i, j in zip(at[:-1], at[1:], strict=True)]
        seen = self._seen
        if len(seen) > 50_000:
            seen.clear()
        seen[b""] = (self.prior, [], [])
        new = {key: i for i, key in enumerate(keys) if key not in seen}
        some = np.array(list(new.values()), np.int64)
        if len(some):
            n = at[some + 1] - at[some]
            r, cut = _ranges(at[some], n), np.concatenate(([0], np.cumsum(n)))
            found = self.index.nearest_many(cut, terms[r], self.vectors(cut, terms[r], tf[r]), self.k)
            for key, (items, cos) in zip(new, found, strict=True):
                raw = self.vote(items, cos)
                s = raw if self.curve is None or not len(items) else float(np.interp(raw, *self.curve))
                seen[key] = (s, self.ids[items[:3]].tolist(), np.round(cos[:3], 6).tolist())
        return [seen[key] for key in keys]

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}


def copy_weights(minima: np.ndarray, like: float = 0.5) -> np.ndarray:
    """1 / size of each row's group, rows being joined whose minima agree in the share like or more (which
    estimates the Jaccard similarity of their sets)."""
    n = len(minima)
    low, group = (minima & 0xFFFF).astype(np.uint16), np.arange(n)
    for i in range(n):
        same = np.flatnonzero((low[i + 1 :] == low[i]).mean(1) >= like) + i + 1
        if len(same):
            old = np.unique(np.append(group[same], group[i]))
            group[np.isin(group, old)] = old[0]
    return 1 / np.bincount(group, minlength=n)[group] if n else np.zeros(0)


def _example_terms(batches):
    """Of each row its terms and their counts, and the minima of its terms' hashes."""
    seeds = mix(np.arange(1, MINIMA + 1).astype(np.uint64))
    for (doc_id,), text in slabs(batches, ["doc_id"]):
        doc, h = _terms(text)
        uniq, inverse = np.unique(h, return_inverse=True)
        d, t, tf = _counted(doc, inverse, max(1, len(uniq)))
        cut = np.searchsorted(d, np.arange(len(text) + 1))
        data, minima = [], []
        hashed = np.stack([mix(uniq ^ s) for s in seeds]) if len(uniq) else None
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            data.append(uniq[t[i:j]].tobytes() + tf[i:j].astype("<u4").tobytes())
            minima.append(np.array([row[t[i:j]].min() for row in hashed]).tobytes() if j > i else b"\xff" * 8 * MINIMA)
        yield pa.RecordBatch.from_arrays([doc_id.cast(pa.int64()), pa.array(np.diff(cut), pa.int64()), pa.array(data, pa.binary()), pa.array(minima, pa.binary())], ["doc_id", "n", "data", "minima"])


def _merged(got: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the examples, their terms and counts; a doc_id of several rows has each term's largest count.
    got is emptied on the way."""
    for rows in got:
        if len(rows) > 1:
            each = [(np.frombuffer(d, "<u8", len(d) // 12), np.frombuffer(d, "<u4", len(d) // 12, len(d) // 12 * 8)) for d in rows]
            term, at = np.unique(np.concatenate([t for t, _ in each]), return_inverse=True)
            tf = np.zeros(len(term), np.uint32)
            np.maximum.at(tf, at, np.concatenate([c for _, c in each]))
            rows[:] = [term.tobytes() + tf.tobytes()]
    cut = np.concatenate(([0], np.cumsum([len(rows[0]) // 12 if rows else 0 for rows in got]))).astype(np.int64)
    term, tf = np.empty(cut[-1], np.uint64), np.empty(cut[-1], np.uint32)
    for rows, i, j in zip(got, cut[:-1], cut[1:], strict=True):
        if rows:
            term[i:j], tf[i:j] = np.frombuffer(rows[0], "<u8", j - i), np.frombuffer(rows[0], "<u4", j - i, 8 * (j - i))
            rows.clear()
    return cut, term, tf


def _task_counts(shared):
    """Of each task its rows with each term of the vocabulary, in slices of terms; as slice -1 all its rows."""

    def run(batches):
        trim()
        vocabulary = shared.value
        n, rows = len(vocabulary.terms), 0
        counts = np.zeros(n, np.int64)
        for _, text in slabs(batches, []):
            rows += len(text)
            doc, at = vocabulary(*_terms(text))
            key = np.sort(doc * n + at)
            counts += np.bincount(key[np.diff(key, prepend=-1) > 0] % n, minlength=n)
        some = np.flatnonzero(counts)
        cut = np.searchsorted(some, np.arange(0, n + SLICE, SLICE))
        full = np.flatnonzero(np.diff(cut))
        places = [(some[cut[i] : cut[i + 1]] % SLICE).astype("<u2").tobytes() for i in full]
        values = [counts[some[cut[i] : cut[i + 1]]].astype("<i8").tobytes() for i in full]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *full.tolist()], pa.int32()), pa.array([b"\0\0", *places], pa.binary()), pa.array([np.array([rows], "<i8").tobytes(), *values], pa.binary())], ["slice", "places", "counts"])

    return run


def _add_counts(batches):
    """Rows of _task_counts, added up by slice as they come."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, places, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            total.setdefault(i, np.zeros(SLICE, np.int64))[np.frombuffer(places, "<u2")] += np.frombuffer(counts, "<i8")
    some = {i: np.flatnonzero(x) for i, x in total.items()}
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([some[i].astype("<u2").tobytes() for i in total], pa.binary()), pa.array([total[i][some[i]].astype("<i8").tobytes() for i in total], pa.binary())], ["slice", "places", "counts"])


def document_counts(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """All rows of docs, and how many of them have each term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "slice int, places binary, counts binary"
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_task_counts(shared), schema)
    df, n = np.zeros(-(-len(vocabulary.terms) // SLICE) * SLICE, np.int64), 0
    for r in parts.repartition("slice").mapInArrow(_add_counts, schema).toLocalIterator():  # as many numbers as terms
        counts = np.frombuffer(r.counts, "<i8")
        if r.slice < 0:
            n += int(counts.sum())
        else:
            df[r.slice * SLICE + np.frombuffer(r.places, "<u2").astype(np.int64)] += counts
    shared.destroy()
    return n, df[: len(vocabulary.terms)]


def _vote_lots(shared):
    """Lots of examples: each one's vote by the others."""

    def run(batches):
        trim()
        model = shared.value
        index = model.index
        for b in batches:
            for lot in b.column(0).to_pylist():
                own = np.arange(lot * LOT, min(index.n, (lot + 1) * LOT))
                mine, at = slice(index.at[own[0]], index.at[own[-1] + 1]), index.at[own[0] : own[-1] + 2]
                found = index.nearest_many(at - at[0], index.term[mine].astype(np.int64), index.w[mine], model.k, own)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([model.vote(*x) for x in found])], ["i", "vote"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = 15, held_out: tuple[int, int] | None = (3, 1)) -> ToxicityModel:
    """A model from at most examples labelled rows of each class; held_out: rows whose crc32(doc_id) has that
    (modulus, remainder) teach nothing. A doc_id labelled twice counts as toxic if any of its labels is 1."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if held_out:
        known = known.where(crc_remainder("doc_id", held_out[0]) != held_out[1])
    total = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id"))
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(examples).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(examples))
    ids = picked.select("doc_id", "toxic").collect()  # at most 2 * examples small rows
    if not ids:
        return ToxicityModel(Vocabulary(np.zeros(0)), np.zeros(0), BlockMaxIndex(np.zeros(1, np.int64), np.zeros(0), np.zeros(0), 0), np.zeros(0), np.zeros(0), np.zeros(0, np.int64), k, 0.0)
    small = F.broadcast(spark.createDataFrame([(r.doc_id,) for r in ids], "doc_id long"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(small, "doc_id")
    rows = materialize(rows.mapInArrow(_example_terms, "doc_id long, n long, data binary, minima binary"))
    size = {r.doc_id: r.n for r in rows.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    left, used = {0: POSTINGS, 1: POSTINGS}, []
    for r in ids:  # by hash
        if left[r.toxic] > 0:
            used.append(r)
            left[r.toxic] -= size.get(r.doc_id, 0)
    ids = used
    place = {r.doc_id: i for i, r in enumerate(ids)}
    toxic = np.array([r.toxic for r in ids])
    minima = np.full((len(ids), MINIMA), (1 << 64) - 1, np.uint64)
    got: list[list[bytes]] = [[] for _ in ids]
    if len(ids) < len(size):
        rows = rows.join(F.broadcast(spark.createDataFrame([(r.doc_id,) for r in ids], "doc_id long")), "doc_id")
    for r in rows.select("doc_id", "n", "data", "minima").toLocalIterator():  # POSTINGS bounds the terms
        i = place[r.doc_id]
        minima[i] = np.minimum(minima[i], np.frombuffer(r.minima, np.uint64))
        got[i].append(bytes(r.data))
    cut, term, tf = _merged(got)
    vocab = Vocabulary(np.unique(term))
    n_terms = len(vocab.terms)
    term = np.searchsorted(vocab.terms, term).astype(np.int32)
    # in the term statistics copies speak once: else every word of a copied text would tell its class
    has = np.diff(cut) > 0
    say = np.ones(len(ids))
    say[has] = copy_weights(minima[has].astype(np.int64))
    n1, n0 = (say[toxic == c].sum() for c in (1, 0))
    told = np.zeros((2, n_terms))
    for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        told[toxic[i], term[x:y]] += say[i]  # a text's terms are different
    b, a = told
    n = n1 + n0
    chi = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum(1e-9, (a + b) * (n - a - b) * max(1, n1) * max(1, n0))
    telling = (chi >= CHI) & (a + b >= 4) & (np.abs(np.log((a + 0.5) / (n1 + 1) / ((b + 0.5) / (n0 + 1)))) >= np.log(3))
    n_docs, df = document_counts(docs, vocab)
    idf = (np.log((n_docs + 1) / (df + 1)) + 1) * np.where(telling, 1.0, FAINT)
    n1, n0 = (int((toxic == c).sum()) for c in (1, 0))
    share = np.array([total.get(0, 0) / max(1, n0), total.get(1, 0) / max(1, n1)])[toxic]
    # a text without known terms: as examples without terms, and one more of the labels' mean
    rate = total.get(1, 0) / max(1, sum(total.values()))
    prior = float(((share * toxic)[~has].sum() + rate) / (share[~has].sum() + 1))
    # alike examples share blocks: classes first, then the weightiest term
    full = sorted(np.flatnonzero(has), key=lambda d: (toxic[d], term[cut[d] + idf[term[cut[d] : cut[d + 1]]].argmax()], ids[d].doc_id))
    model = ToxicityModel(vocab, idf, BlockMaxIndex(np.zeros(1, np.int64), np.zeros(0), np.zeros(0), n_terms), toxic[full], say[full], np.array([ids[d].doc_id for d in full], np.int64), k, prior)
    if full:
        n = np.diff(cut)[full]
        at, r = np.concatenate(([0], np.cumsum(n))), _ranges(cut[:-1][full], n)
        term, tf = term[r], tf[r]
        del r
        model.index = BlockMaxIndex(at, term, model.vectors(at, term, tf), n_terms)
        # each example's vote without itself; tasks have the memory for the index's blocks
        shared = spark.sparkContext.broadcast(model)
        votes = spark.range(-(-len(full) // LOT)).mapInArrow(_vote_lots(shared), "i long, vote double").collect()  # as many as examples
        raw = np.zeros(len(full))
        raw[[r.i for r in votes]] = [r.vote for r in votes]
        model.curve = isotonic(raw, model.label.astype(float), share[full])
        shared.destroy()
    return model


def _score(columns: list[str], shared):
    def run(batches):
        trim()
        model = shared.value
        for cols, text in slabs(batches, columns):
            doc, at = model.vocabulary(*_terms(text))
            d, t, tf = _counted(doc, at, max(1, len(model.idf)))
            cut = np.searchsorted(d, np.arange(len(text) + 1))
            out = model.score(cut, t, tf)
            yield pa.RecordBatch.from_arrays([*cols, pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))], [*columns, "__score", "__neighbors", "__cosines"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with __score (0 to 1), and as evidence the ids and cosines of the three nearest examples."""
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType()), T.StructField("__neighbors", T.ArrayType(T.LongType())), T.StructField("__cosines", T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(_score(docs.columns, shared), schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text; a null or empty text gets the prior of texts without known terms.

    A null doc_id is not held out (it has no crc32)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_toxicity(docs, model)
    return out.select("doc_id", F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.7).cast("int").alias("predicted"), F.col("__neighbors").alias("neighbors"), F.col("__cosines").alias("cosines"))
