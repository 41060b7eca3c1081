"""Ranked lexical search by branch and bound over a hierarchical max tree of each term.

Documents are cut into ranges as they are read; a range's postings make one row of the index. Within a range a term has
a tree: the largest impact of the term's documents in each block of LEAF documents, in each block of LEAF * LEAF, and
in the range. A query's bound at a node is the weighted sum of its terms' maxima there, so no document below it scores
more. Best first, the node with the highest bound is opened, down to documents, until no bound reaches the score of the
k-th best document; nodes with an equal bound are opened too, since a document of that score may have the smaller id.

Ranges are the trees' top level on the cluster: those with each query's highest bounds are searched first, and their
k-th best score is the threshold that all others start from.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, release, slabs, small_batches, text_buffer, word_hashes

#: Documents of a range at most, bytes of its texts about, documents under a node of the lowest level (a power of two).
RANGE, RANGE_BYTES, SHIFT = 1 << 14, 16 << 20, 5
#: Terms of the queries of a block: what the driver holds and tasks are sent at once.
BLOCK_TERMS = 1 << 20
#: Ranges searched first for each query.
FIRST = 4

_letters = np.zeros(256, bool)
_letters[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Of each byte whether it ends terms.
ENDS = ~_letters

_RANGES = "shard string, ids binary, sizes binary, terms array<int>, counts array<int>, docs binary, tfs binary"
_INDEX = "shard string, ids binary, terms binary, counts binary, nodes binary, tops binary"


def term_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of each text, and the n + 1 places where the texts' begin."""
    return word_hashes(*text_buffer(text), lower=True, space=ENDS)


@dataclass
class Queries:
    """A block's queries: names, and of each its terms (places in hashes, ascending) with their counts."""

    names: list
    hashes: np.ndarray
    terms: list[np.ndarray]
    counts: list[np.ndarray]

    @classmethod
    def of(cls, names: list, found: list[np.ndarray]) -> Queries:
        hashes = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))
        pairs = [np.unique(np.searchsorted(hashes, h), return_counts=True) for h in found]
        return cls(names, hashes, [t for t, _ in pairs], [c.astype(np.int64) for _, c in pairs])


def _scan(hashes, most: int):
    """Ranges of documents with their postings of the terms in hashes."""

    def run(batches):
        wanted, task, n = hashes.value, TaskContext.get().partitionId(), 0
        ids, none, sizes, keys, tfs, size, at = [], [], [], [], [], 0, 0

        def row():
            key, tf = np.concatenate(keys), np.concatenate(tfs)
            order = np.argsort(key, kind="stable")
            key, tf = key[order], tf[order]
            terms, counts = np.unique(key >> 32, return_counts=True)
            values = [f"{task}-{n}", np.concatenate(ids).tobytes() + np.packbits(np.concatenate(none)).tobytes(), np.concatenate(sizes).tobytes(), terms.astype(np.int32), counts.astype(np.int32), (key & 0xFFFFFFFF).astype("<i4").tobytes(), tf.astype("<i4").tobytes()]
            kinds = [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["shard", "ids", "sizes", "terms", "counts", "docs", "tfs"])

        for (doc_id,), text in slabs(batches, ["doc_id"], 4 << 20):
            h, offs = term_hashes(text)
            doc = np.repeat(np.arange(len(text)), np.diff(offs))
            place = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
            hit = wanted[place] == h if len(wanted) else np.zeros(len(h), bool)
            lengths = np.diff(offs)
            key, tf = np.unique(place[hit].astype(np.int64) << 32 | doc[hit], return_counts=True)
            for a in range(0, len(text), most):
                b = min(len(text), a + most)
                if at and (at + b - a > most or size > RANGE_BYTES):
                    yield row()
                    n, size, at = n + 1, 0, 0
                    ids, none, sizes, keys, tfs = [], [], [], [], []
                some = ((key & 0xFFFFFFFF) >= a) & ((key & 0xFFFFFFFF) < b)
                ids.append(doc_id.slice(a, b - a).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                none.append(np.asarray(doc_id.slice(a, b - a).is_null().to_pylist(), bool))
                sizes.append(lengths[a:b].astype("<i8"))
                keys.append(key[some] + at - a)
                tfs.append(tf[some])
                size, at = size + int(text.slice(a, b - a).nbytes), at + b - a
        if at:
            yield row()

    return run


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A document's score for a term, before the term's weight: whole numbers, rounded down."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _trees(total: int, length: int):
    """Each range's postings to the levels of its terms' trees: of each level the nodes of each term in order, with their
    number and largest impacts; level 0 is the documents, the last is the range."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                sizes, terms = np.frombuffer(r["sizes"], "<i8"), np.array(r["terms"], np.int32)
                kinds, back = np.unique(sizes, return_inverse=True)
                m = np.array([100 - 25 + 25 * n * total // length for n in kinds.tolist()] or [0], np.int64)[back if len(sizes) else slice(0)]
                doc, tf = np.frombuffer(r["docs"], "<i4"), np.frombuffer(r["tfs"], "<i4").astype(np.int64)
                top = impacts(tf, m[doc])
                key = np.repeat(np.arange(len(terms)), np.array(r["counts"], np.int64)) << 16 | doc
                keys, tops = [key], [top]
                for shift in (SHIFT, SHIFT, 16 - 2 * SHIFT):
                    key = (key >> 16 << 16) | ((key & 0xFFFF) >> shift)
                    head = np.flatnonzero(np.diff(key, prepend=-1))
                    key, top = key[head], np.maximum.reduceat(top, head) if len(head) else top
                    keys.append(key)
                    tops.append(top)
                counts = np.concatenate([np.bincount(x >> 16, minlength=len(terms)) for x in keys])
                packed = [r["shard"], r["ids"], terms.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), np.concatenate(keys).astype("<u2").tobytes(), np.concatenate(tops).astype("<i4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if i == 0 else pa.binary()) for i, v in enumerate(packed)], ["shard", "ids", "terms", "counts", "nodes", "tops"])

    return run


class RangeTree:
    """The trees of one range."""

    def __init__(self, row: dict):
        raw = row["ids"]
        n = len(raw) * 8 // 65  # eight bytes and a bit each
        self.ids = np.frombuffer(raw, "<i8", n)
        self.none = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 * n), count=n).astype(bool)
        self.terms = np.frombuffer(row["terms"], "<i4")
        nodes, tops = np.frombuffer(row["nodes"], "<u2"), np.frombuffer(row["tops"], "<i4").astype(np.int64)
        counts = np.frombuffer(row["counts"], "<i4").reshape(4, -1)
        cut = np.cumsum([0, *counts.sum(1)])
        # keys of a level: place of the term << 16 | node, ascending
        self.levels = [(np.repeat(np.arange(len(c)) << 16, c) | nodes[a:b], tops[a:b]) for c, a, b in zip(counts, cut[:-1], cut[1:], strict=True)]

    def find(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of terms that the range has, as places, with their weights."""
        at = np.searchsorted(self.terms, terms)
        has = at < len(self.terms)
        has[has] = self.terms[at[has]] == terms[has]
        return at[has], weights[has]

    def bound(self, at: np.ndarray, weights: np.ndarray) -> int:
        """No document of the range scores more."""
        return int((weights * self.levels[-1][1][at]).sum())  # the last level has one node a term

    def open(self, level: int, node: int, at: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes under a node, one level down, and their bounds; at level 0 they are documents and their scores."""
        keys, tops = self.levels[level]
        shift = (SHIFT, SHIFT, 16 - 2 * SHIFT)[level]
        a = np.searchsorted(keys, at << 16 | node << shift)
        size = np.searchsorted(keys, (at << 16) + ((node + 1) << shift)) - a
        rows = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        under = (keys[rows] & 0xFFFF) - (node << shift)
        bounds = np.zeros(1 << shift, np.int64)
        np.add.at(bounds, under, np.repeat(weights, size) * tops[rows])
        found = np.flatnonzero(bounds)
        return found + (node << shift), bounds[found]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int, opened: list | None = None) -> list[tuple]:
        """(-score, null id, doc_id) of the range's k best documents, those under least left out."""
        at, weights = self.find(terms, weights)
        best: list[tuple] = []  # a heap of the k best, the worst on top
        top = len(self.levels) - 1
        bound = self.bound(at, weights) if len(at) else 0
        heap = [(-bound, top, 0)] if bound else []
        while heap:
            bound, level, node = heapq.heappop(heap)
            if -bound < least:
                break
            if opened is not None:
                opened.append((-bound, level, node))
            nodes, bounds = self.open(level - 1, node, at, weights)
            keep = bounds >= least
            for x, s in zip(nodes[keep].tolist(), bounds[keep].tolist(), strict=True):
                if level > 1:
                    heapq.heappush(heap, (-s, level - 1, x))
                    continue
                entry = (s, not self.none[x], -int(self.ids[x]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                if len(best) == k:
                    least = max(least, best[0][0])
        return [(s, has, doc_id) for s, has, doc_id in best]


def _first(queries, weights, first: int):
    """Of each task, the ranges with the highest bounds of each query: (query, bound, shard)."""

    def run(batches):
        q, w = queries.value, weights.value
        best: list[list] = [[] for _ in q.names]
        for b in batches:
            for r in b.to_pylist():
                tree = RangeTree(r)
                for i, (terms, heap) in enumerate(zip(q.terms, best, strict=True)):
                    at, ws = tree.find(terms, w[i])
                    bound = tree.bound(at, ws) if len(at) else 0
                    if bound:
                        (heapq.heappush if len(heap) < first else heapq.heappushpop)(heap, (bound, r["shard"]))
        rows = [(i, *x) for i, heap in enumerate(best) for x in heap]
        if rows:
            n, bound, shard = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(bound, pa.int64()), pa.array(shard)], ["query", "bound", "shard"])

    return run


def _search(queries, weights, k: int, least, only=None):
    """Each task's k best documents of each query; least: a score that the best documents reach; only: the queries that
    a range is searched for, all if None."""

    def run(batches):
        q, w, floor = queries.value, weights.value, least.value
        best: list[list] = [[] for _ in q.names]
        for b in batches:
            for r in b.to_pylist():
                tree = RangeTree(r)
                for i in range(len(q.names)) if only is None else only.value.get(r["shard"], ()):
                    full = len(best[i]) == k
                    found = tree.search(q.terms[i], w[i], k, max(int(floor[i]), best[i][-1][0] if full else 1))
                    best[i] = heapq.nlargest(k, best[i] + found)
        rows = [(i, s, None if not has else -doc_id) for i, found in enumerate(best) for s, has, doc_id in found]
        for a in range(0, len(rows), 50_000):
            n, s, d = zip(*rows[a : a + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], ["query", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, item_id: str, text: str, terms: int):
    """The queries in blocks of about so many terms, each collected by itself."""
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = -(-size // (4 * terms)) or 1  # a term and what ends it, four bytes or more on average
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64(item_id), F.lit(n)) == i).select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).collect()
        by_id: dict = {}
        for r in rows:
            by_id.setdefault(r.item_id, []).append(r.text)
        hashes, offs = term_hashes(pa.array([t for ts in by_id.values() for t in ts], pa.string()))
        found, row = [], 0
        for ts in by_id.values():
            found.append(hashes[offs[row] : offs[row + len(ts)]])
            row += len(ts)
        yield Queries.of(list(by_id), found)


def _block(docs: DataFrame, queries: Queries, k: int, most: int) -> DataFrame:
    spark = docs.sparkSession
    ctx = spark.sparkContext
    ranges = materialize(docs.mapInArrow(_scan(ctx.broadcast(queries.hashes), most), _RANGES))
    total, length = ranges.select(F.expr("length(sizes) div 8").alias("n"), "sizes").mapInArrow(_count_terms, "n long, length long").agg(F.sum("n"), F.sum("length")).first()
    total, length = total or 0, length or 0
    df = np.zeros(len(queries.hashes), np.int64)
    for r in ranges.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df")).toLocalIterator():
        df[r.terms] = r.df
    term_weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    q, w = ctx.broadcast(queries), ctx.broadcast([term_weight[t] * c for t, c in zip(queries.terms, queries.counts, strict=True)])
    index = materialize(ranges.mapInArrow(_trees(total, length or 1), _INDEX))
    release(ranges)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    bounds = index.mapInArrow(_first(q, w, FIRST), "query int, bound long, shard string").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "shard")))
    only: dict[str, list[int]] = {}
    for r in bounds.where(F.col("r") <= FIRST).select("query", "shard").collect():  # FIRST rows a query of the block
        only.setdefault(r.shard, []).append(r.query)
    least = np.ones(len(queries.names), np.int64)
    candidates = "query int, doc_id long, score long"
    if only:
        first = index.where(F.col("shard").isin(list(only)) if len(only) <= 5000 else F.lit(True)).mapInArrow(_search(q, w, k, ctx.broadcast(least), ctx.broadcast(only)), candidates)
        found = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
        for r in found.collect():
            least[r.query] = r.score
    rows = index.mapInArrow(_search(q, w, k, ctx.broadcast(least)), candidates)
    names = spark.createDataFrame(pa.table({"query": pa.array(range(len(queries.names)), pa.int32()), "item_id": pa.array(queries.names, pa.int64())}))
    out = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(F.broadcast(names), "query")
    out = materialize(out.select("item_id", "rank", "doc_id", "score"))
    release(index)
    return out


def _count_terms(batches):
    """(documents with a term, terms) of each range."""
    for b in batches:
        sizes = [np.frombuffer(x.as_buffer(), "<i8") for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([pa.array([int((s > 0).sum()) for s in sizes], pa.int64()), pa.array([int(s.sum()) for s in sizes], pa.int64())], ["n", "length"])


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text", range_docs: int = RANGE, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of docs (doc_id, text) for each item, best first.

    A term is a run of letters, digits and non-ASCII characters. Rows that share an item_id are one item with all their
    terms; rows of docs are documents of their own, also where they share an id, and a null id comes after all others
    of its score. Items and documents without a term are in no result, nor is a score of 0; empty tables give none.
    Items go in blocks of about block_terms terms (one item is never cut), each one
    pass over docs; ranges have at most range_docs documents, no more than RANGE. Terms are told apart by 64-bit
    hashes of their bytes. Other columns don't matter."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = [_block(docs.select("doc_id", "text"), q, k, min(range_docs, RANGE)) for q in _blocks(items, item_id, text, block_terms) if len(q.hashes)]
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
s AS (SELECT item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN w USING (t) JOIN p USING (t), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20
"""


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return lexical_search(read("documents"), read("benchmark"))
