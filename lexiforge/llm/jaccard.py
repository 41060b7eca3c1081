"""N-gram Jaccard join with a count-vector R-tree.

1. Each text becomes its set of word shingles, as 64-bit hashes. Texts with equal sets form a class.
2. Each shingle is told whether another set has it too. A set that links shares at least the threshold's part
   of its own shingles, so all others, passages that they quote notwithstanding, are done.
3. A sketch of the rest's hashed shingle counts puts their shingles in one global order, rare ones first. Two
   sets that link share a shingle among the first ``n - ceil(threshold * n) + 1`` of each (the prefix argument),
   so classes that meet on such a shingle are joined into blocks; a link never leaves its block.
4. In a block, shingles that two classes have are hashed into groups and each class is the point of its group
   counts. An R-tree over the points keeps each node's largest coordinates; the sum over groups of the smaller
   coordinate bounds the overlap of a class with a point or with anything below a node. What the bound does not
   exclude is verified on the sets, many at once. Classes that are in one component already need no verification.
5. A block that is too large for a task is cut into parts, and every pair of parts is a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recurring, _stream, buckets_for, connected_components, free_shuffles, hot_limit, join_hot, materialize, mix, release, rolling, slabs, small_batches, text_buckets, text_buffer, trim, word_hashes

_BASE = 0xA0761D6478BD642F
#: Most sketch buckets (a power of two), a byte each. With many shingles in each bucket, common ones look like all
#: others and get into prefixes, and blocks join into one.
SKETCH = 1 << 26
#: Shingles that a task counts at once.
COUNTED = 1 << 22
#: Shingles of a chunk: their places fit two bytes.
CHUNK = 1 << 16
#: Bytes of sets and number of classes that one task takes from a block.
PART_BYTES, PART_CLASSES = 48 << 20, 20_000
GROUPS, LEAF, FANOUT = 64, 32, 16
#: A shingle is common in a block if one class in so many has it.
CORE = 16


def shingle_sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and the n+1 offsets.

    A text with fewer words has one shingle, the whole sequence; one without words has none."""
    buf, offs = text_buffer(text)
    wh, wo = word_hashes(buf, offs, lower=True)
    n_words = wo[1:] - wo[:-1]
    roll = rolling(wh, width, _BASE)
    n = np.maximum(n_words - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(wo[:-1], n)
    h = roll[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        own = [rolling(wh[wo[d] : wo[d + 1]], int(n_words[d]), _BASE)[0] for d in short]
        h = np.concatenate([h, mix(np.array(own, np.uint64) + n_words[short].astype(np.uint64))])
        doc = np.concatenate([doc, short])
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16) if len(n) < 1 << 16 else doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


_SALT = int(_stream("set", 1)[0])


def _set_ids(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """An id of each set: the sum of its mixed hashes, so equal sets have equal ids. Empty sets have 0."""
    with np.errstate(over="ignore"):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(h ^ np.uint64(_SALT)))))
        return (total[offs[1:]] - total[offs[:-1]]).astype(np.int64)


def _shared_shingles(width: int, n_buckets: int):
    """Per chunk of sets: for each bucket its distinct shingles (32 further bits of the hash) and their places;
    a header with the sets' classes, sizes and shingles that are known to repeat (in the chunk, or sent by earlier
    chunks of the task); and the rows themselves."""

    def run(batches):
        trim()
        from pyspark import TaskContext

        task, made, recurring = TaskContext.get().partitionId(), 0, Recurring()
        schema = [("bucket", pa.int32()), ("chunk", pa.string()), ("kind", pa.int32()), ("data", pa.binary())]

        def chunk(seg: list[tuple[int, int, int]], h: np.ndarray):
            nonlocal made
            made += 1
            name = f"{task}-{made}"
            keys, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            known = recurring.known(keys)
            local = (known | (count > 1))[inverse]
            at = int(keys[0] % np.uint64(n_buckets))
            keys, first = keys[~known], first[~known]
            scaled = (keys >> np.uint64(32)) * np.uint64(n_buckets)
            cut = np.searchsorted(scaled >> np.uint64(32), np.arange(n_buckets + 1, dtype=np.uint64))
            rest = ((scaled & np.uint64(0xFFFFFFFF)) ^ (keys & np.uint64(0xFFFFFFFF))).astype("<u4")
            head = len(seg).to_bytes(4, "little") + np.array(seg, "<i8").tobytes() + np.packbits(local).tobytes()
            out = [(at, name, 1, head)]
            out += [(b, name, 0, rest[i:j].tobytes() + first[i:j].astype("<u2").tobytes()) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            return pa.RecordBatch.from_pydict({k: pa.array([r[c] for r in out], t) for c, (k, t) in enumerate(schema)})

        for (ids,), text in slabs(batches, ["doc_id"]):
            h, offs = shingle_sets(text, width)
            cls, n = _set_ids(h, offs), np.diff(offs)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            buf, cut = text_buffer(text)
            told = np.array([xxhash.xxh64_intdigest(buf[i:j].tobytes(), 42) for i, j in zip(cut[:-1], cut[1:], strict=True)], np.uint64).astype(np.int64)
            rows = np.stack([ids.fill_null(0).to_numpy(zero_copy_only=False), known, n, cls, told], 1).astype("<i8").tobytes()
            yield pa.RecordBatch.from_pydict({k: pa.array([v], t) for (k, t), v in zip(schema, (int(made % n_buckets), f"{task}", 2, rows), strict=True)})
            seg: list = []
            cuts: list = []
            total = 0
            for d in np.flatnonzero(n):
                for at in range(0, int(n[d]), CHUNK):
                    m = min(CHUNK, int(n[d]) - at)
                    if total + m > CHUNK:
                        yield chunk(seg, np.concatenate([h[a:b] for a, b in cuts]))
                        seg, cuts, total = [], [], 0
                    seg.append((int(cls[d]), at, m))
                    cuts.append((offs[d] + at, offs[d] + at + m))
                    total += m
            if seg:
                yield chunk(seg, np.concatenate([h[a:b] for a, b in cuts]))

    return run


def _reply(batches):
    """All of a bucket's shingles meet here: reply to each chunk with the places of those that other chunks have too."""
    names: list[str] = []
    hs, ps = [], []
    for batch in batches:
        bucket, chunk, kind, data = (batch.column(batch.schema.get_field_index(c)) for c in ("bucket", "chunk", "kind", "data"))
        keep = kind.to_numpy(zero_copy_only=False) > 0
        if keep.any():
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([chunk.filter(mask), kind.filter(mask), data.filter(mask)], ["chunk", "kind", "data"])
        for i, b in zip(np.flatnonzero(~keep), bucket.to_numpy(zero_copy_only=False)[~keep], strict=True):
            raw = data[int(i)].as_buffer()
            n = raw.size // 6
            hs.append(np.frombuffer(raw, "<u4", n).astype(np.uint64) | np.uint64(int(b) << 32))
            ps.append(np.frombuffer(raw, "<u2", n, 4 * n))
            names.append(chunk[int(i)].as_py())
    if not hs:
        return
    size = [len(a) for a in hs]
    h, p = np.concatenate(hs), np.concatenate(ps)
    del hs, ps, raw, data  # the views kept the batches
    order = np.argsort(h)
    h = h[order]
    same = np.concatenate(([False], h[1:] == h[:-1]))
    order = order[same | np.append(same[1:], False)]
    src = np.repeat(np.arange(len(size)), size)[order]
    by = np.argsort(src, kind="stable")
    src, place = src[by], p[order][by]
    ids, at = np.unique(src, return_index=True)
    parts = np.split(place, at[1:])
    for a in range(0, len(ids), 10_000):
        some = ids[a : a + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some], pa.string()), pa.array(np.zeros(len(some), np.int32)), pa.array([p.tobytes() for p in parts[a : a + 10_000]], pa.binary())], ["chunk", "kind", "data"])


def _shares(tbl: pa.Table) -> pa.Table:
    """A chunk's header and replies to its sets' (class, first place, shingles that other sets have)."""
    kind, data = tbl.column("kind").to_pylist(), tbl.column("data").to_pylist()
    head = next(d for k, d in zip(kind, data, strict=True) if k == 1)
    n = int.from_bytes(head[:4], "little")
    seg = np.frombuffer(head, "<i8", 3 * n, 4).reshape(n, 3)
    total = int(seg[:, 2].sum())
    flags = np.unpackbits(np.frombuffer(head, np.uint8, -(-total // 8), 4 + 24 * n), count=total).astype(np.int64)
    for k, d in zip(kind, data, strict=True):
        if k == 0:
            flags[np.frombuffer(d, "<u2")] = 1
    shared = np.add.reduceat(flags, np.cumsum(seg[:, 2]) - seg[:, 2])
    return pa.table({"cls": seg[:, 0], "at": seg[:, 1], "shared": shared})


def _rows(batches):
    for b in batches:
        for data in b.column(0):
            r = np.frombuffer(data.as_buffer(), "<i8").reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(r[:, 0], mask=r[:, 1] == 0), *(pa.array(r[:, k]) for k in (2, 3, 4))], ["doc_id", "n", "cls", "text_hash"])


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes in the same order: as they are up to 128, eight steps a doubling beyond."""
    steep = 128 + np.floor(8 * np.log2(np.maximum(counts, 128) / 128))
    return np.where(counts <= 128, counts, np.minimum(steep, 255)).astype(np.uint8)


def _sketch(width: int, sketch: int, part: int):
    """A task's counts of hashed shingles, in parts of at most 2^16 buckets."""

    def counted(found: list[np.ndarray]):
        at, n = np.unique(np.concatenate(found), return_counts=True)
        cut = np.searchsorted(at, np.arange(0, sketch + 1, part))
        some = [(k, i, j) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
        at, n = (at % np.uint32(part)).astype("<u2"), n.astype("<u4")
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in some], pa.int64()), pa.array([at[i:j].tobytes() + n[i:j].tobytes() for _, i, j in some], pa.binary())], ["n", "counts"])

    def run(batches):
        found: list[np.ndarray] = []
        total = 0
        for _, text in slabs(batches, []):
            found.append((shingle_sets(text, width)[0] & np.uint64(sketch - 1)).astype(np.uint32))
            total += len(found[-1])
            if total >= COUNTED:
                yield counted(found)
                found, total = [], 0
        if total:
            yield counted(found)

    return run


def _add_counts(part: int):
    """The parts' sums, as levels."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = data.as_buffer()
                m = raw.size // 6
                sums.setdefault(k, np.zeros(part, np.uint32))[np.frombuffer(raw, "<u2", m)] += np.frombuffer(raw, "<u4", m, 2 * m)
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([levels(v).tobytes()], pa.binary())], ["n", "counts"])

    return run


def _prefixes(width: int, percent: int, sketch, n_buckets: int):
    """For each bucket of shingles the (shingle, class) pairs of the classes' prefixes."""

    def run(batches):
        counts = sketch.value
        mask = np.uint64(len(counts) - 1)
        for _, text in slabs(batches, [], 6 << 20):
            h, offs = shingle_sets(text, width)
            cls = _set_ids(h, offs)
            n = offs[1:] - offs[:-1]
            first = np.zeros(len(n), bool)
            first[np.unique(cls, return_index=True)[1]] = True
            first &= n > 0
            if not first.any():
                continue
            doc = np.repeat(np.arange(len(n)), n)
            keep = first[doc]
            h, doc = h[keep], doc[keep]
            df = counts[(h & mask).astype(np.int64)].astype(np.uint64)
            order = np.argsort((df << np.uint64(32)) | (h >> np.uint64(32)), kind="stable")
            order = order[np.argsort(doc[order].astype(np.uint16) if len(n) < 1 << 16 else doc[order], kind="stable")]
            h, doc, df = h[order], doc[order], df[order]
            start = np.searchsorted(doc, np.arange(len(n)))
            most = n - (-(-n * percent // 100)) + 1
            keep = (np.arange(len(doc)) - start[doc] < most[doc]) & (df > 1)
            h, c = h[keep], cls[doc[keep]]
            bucket = ((h >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            h, c = h[order], c[order]
            cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=np.uint64))
            some = [(b, i, j) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in some], pa.int32()), pa.array([h[i:j].tobytes() + c[i:j].tobytes() for _, i, j in some], pa.binary())], ["bucket", "data"])

    return run


def _meet(batches):
    """Edges from the smallest class with a shingle to the others that have it."""
    hs, cs = [], []
    for b in batches:
        for data in b.column(b.schema.get_field_index("data")):
            raw = data.as_buffer()
            hs.append(np.frombuffer(raw, "<u8", raw.size // 16))
            cs.append(np.frombuffer(raw, "<i8", raw.size // 16, raw.size // 2))
    if not hs:
        return
    h = np.concatenate(hs)
    order = np.argsort(h)
    h, c = h[order], np.concatenate(cs)[order]
    same = np.concatenate(([False], h[1:] == h[:-1]))
    keep = same | np.append(same[1:], False)
    h, c = h[keep], c[keep]
    if not len(h):
        return
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    head = np.concatenate(([True], h[1:] != h[:-1]))
    low = c[np.flatnonzero(head)][np.cumsum(head) - 1]
    pairs = np.unique(np.stack([low, c], 1)[low != c], axis=0)
    for a in range(0, len(pairs), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[a : a + 200_000, 0]), pa.array(pairs[a : a + 200_000, 1])], ["a", "b"])


class CountTree:
    """An R-tree over points of group counts, packed in order of size; nodes keep the largest coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.levels = []  # from the leaves up: (largest coordinates, smallest and largest size) of each node
        top, low, high, step = points, sizes, sizes, LEAF
        while True:
            cut = np.arange(0, len(top), step)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))
            if len(top) <= FANOUT:
                break
            step = FANOUT

    def search(self, point: np.ndarray, size: int, percent: int, among: np.ndarray) -> np.ndarray:
        """Points of those that among (a flag each) names whose overlap with a set of these counts may link them."""
        nodes = np.arange(len(self.levels[-1][0]))
        for k, (top, low, high) in enumerate(reversed(self.levels)):
            most = np.minimum(top[nodes], point).sum(1)
            # a set of s links only if the overlap o has 100 o >= percent (size + s - o); the smallest s asks least
            ok = ((100 + percent) * most >= percent * (size + low[nodes])) & (100 * size >= percent * low[nodes]) & (100 * high[nodes] >= percent * size)
            nodes, last = nodes[ok], k == len(self.levels) - 1
            width, n = (LEAF, len(self.points)) if last else (FANOUT, len(self.levels[len(self.levels) - 2 - k][0]))
            nodes = (nodes[:, None] * width + np.arange(width)).ravel()
            nodes = nodes[nodes < n]
        nodes = nodes[among[nodes]]
        s = self.sizes[nodes]
        most = np.minimum(self.points[nodes], point).sum(1)
        return nodes[((100 + percent) * most >= percent * (size + s)) & (100 * size >= percent * s) & (100 * s >= percent * size)]


class Overlaps:
    """Exact overlaps of a set with others: common shingles, which one set in CORE has, are bits of its row, so many
    sets are compared at once; of the others the lists of their sets are counted. Both take memory in proportion to
    the sets. ident: the shingles' numbers, in order, holder: the set of each, common: whether it is such a shingle."""

    def __init__(self, n: int, ident: np.ndarray, holder: np.ndarray, common: np.ndarray):
        own = ident[common]
        bit = np.cumsum(np.append(own[:1] < 0, own[1:] != own[:-1]))
        words = -(-(int(bit[-1]) + 1) // 64) if len(own) else 0
        self.bits = np.zeros((n, words), np.uint64)
        np.add.at(self.bits.ravel(), holder[common] * words + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
        ident, self.holder = ident[~common], holder[~common]
        head = np.flatnonzero(np.append(ident[:1] >= 0, ident[1:] != ident[:-1]))
        size = np.diff(np.append(head, len(ident)))
        by = np.argsort(self.holder, kind="stable")  # each set's lists
        self.start, self.size = np.repeat(head, size)[by], np.repeat(size, size)[by]
        self.cut = np.searchsorted(self.holder[by], np.arange(n + 1))

    def rare(self, i: int) -> np.ndarray:
        """Of each set the number of shingles that aren't common and that set i has too."""
        own = slice(self.cut[i], self.cut[i + 1])
        start, size = self.start[own], self.size[own]
        at = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
        return np.bincount(self.holder[at], minlength=len(self.bits))

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.bits[others] & self.bits[i]).sum(1, dtype=np.int64)


def link_sets(sets: list[np.ndarray], percent: int, part: np.ndarray | None = None) -> np.ndarray:
    """The component (a place) of each set under the links; part: only sets of different parts are compared.

    Shingles that no other set has count for a set's size alone, which keeps the bounds of edited copies low. Sets
    with the largest share of common shingles come first: they link with most others, and what is in one component
    is not compared any more."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    flat, holder = np.concatenate([sets[i] for i in order]), np.repeat(np.arange(n), sizes)
    by = np.argsort(flat, kind="stable")
    flat, holder = flat[by], holder[by]
    ident = np.cumsum(np.append(False, flat[1:] != flat[:-1]))
    df = np.bincount(ident)[ident]
    flat, holder, ident, df = (x[df > 1] for x in (flat, holder, ident, df))
    common = df * CORE >= n
    known, near = np.bincount(holder, minlength=n), np.bincount(holder[common], minlength=n)
    points = np.bincount(holder * GROUPS + (flat >> np.uint64(58)).astype(np.int64), minlength=n * GROUPS).reshape(-1, GROUPS).astype(np.int32)
    tree, exact, comp = CountTree(points, sizes), Overlaps(n, ident, holder, common), np.arange(n)
    parts = None if part is None else part[order]
    open_ = np.ones(n, bool)
    for i in np.argsort(-near / sizes, kind="stable"):
        open_[i] = False
        among = open_ & (comp != comp[i]) & ((100 + percent) * np.minimum(known, known[i]) >= percent * (sizes + sizes[i]))
        if parts is not None:
            among &= parts != parts[i]
        found = tree.search(points[i], int(sizes[i]), percent, among) if among.any() else np.zeros(0, np.int64)
        rare = exact.rare(i) if len(found) else None
        for a in range(0, len(found), 2000):
            some = found[a : a + 2000]
            some = some[comp[some] != comp[i]]
            linked = some[(100 + percent) * (exact.common(i, some) + rare[some]) >= percent * (sizes[i] + sizes[some])]
            if len(linked):
                old = np.unique(np.append(comp[linked], comp[i]))
                comp[np.isin(comp, old)] = old[0]
    out = np.empty(n, np.int64)
    out[order] = order[comp]
    return out


def _link_block(width: int, percent: int):
    def run(tbl: pa.Table) -> pa.Table:
        tbl = tbl.combine_chunks()
        cls, side = tbl.column("cls").to_numpy(), tbl.column("side").to_numpy()
        h, offs = shingle_sets(tbl.column("text"), width)
        own = np.flatnonzero(_set_ids(h, offs) == cls)  # not another row of the same doc_id
        sets = [h[offs[i] : offs[i + 1]] for i in own]
        if not sets:
            return tbl.select(["cls", "cls", "whole"]).rename_columns(["a", "b", "whole"])
        cls, side = cls[own], side[own]
        comp = link_sets(sets, percent, None if (side == side[0]).all() else side)
        return pa.table({"a": cls, "b": cls[comp], "whole": tbl.column("whole").take(pa.array(own))})

    return run


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 75, sketch: int = SKETCH, part_bytes: int = PART_BYTES, part_classes: int = PART_CLASSES) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash) of every row of docs.

    Rows link when 100 * |intersection| >= percent * |union| of their sets of width-word shingles. A row
    with an empty set links with nothing, nor does one without doc_id (its component_id is null). Rows
    that share a doc_id are separate rows; text_hash, xxhash64 of the text (null: empty), tells them apart."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = text_buckets(docs, 1.0)
    met = docs.mapInArrow(_shared_shingles(width, n), "bucket int, chunk string, kind int, data binary").repartitionById(n, F.col("bucket"))
    told = materialize(met.mapInArrow(_reply, "chunk string, kind int, data binary"))
    del met
    free_shuffles(spark)
    rows = materialize(told.where("kind = 2").select("data").mapInArrow(_rows, "doc_id long, n long, cls long, text_hash long"))
    shares = told.where("kind < 2").groupBy("chunk").applyInArrow(_shares, "cls long, at long, shared long")
    shares = shares.groupBy("cls", "at").agg(F.max("shared").alias("shared")).groupBy("cls").agg(F.sum("shared").alias("shared"))
    classes = materialize(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count("*").alias("copies")))
    may = classes.where("doc_id is not null").join(shares, "cls").where(F.col("shared") * 100 >= F.col("n") * percent).select("cls", "doc_id", "n")
    may = materialize(docs.join(may, "doc_id"))  # one text of each class that may link
    release(told)
    free_shuffles(spark)

    step, total = 1 << 14, may.agg(F.sum("n")).first()[0] or 0
    while sketch > step and sketch > 2 * total:
        sketch //= 2
    sketch = max(step, sketch)
    step = min(sketch, 1 << 16)
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sketch >> 22)  # at most 16 MB of counts a task
    sums = may.mapInArrow(_sketch(width, sketch, step), "n long, counts binary").repartition(dealt, F.col("n")).mapInArrow(_add_counts(step), "n long, counts binary")
    counts = np.zeros(sketch, np.uint8)
    for r in sums.toLocalIterator():  # sketch/step rows of step bytes: a fixed size
        counts[r.n * step : (r.n + 1) * step] = np.frombuffer(r.counts, np.uint8)
    shared = spark.sparkContext.broadcast(counts)
    n = buckets_for(may, 2.0)
    met = may.mapInArrow(_prefixes(width, percent, shared, n), "bucket int, data binary").repartitionById(n, F.col("bucket"))
    edges = materialize(met.mapInArrow(_meet, "a long, b long"))
    del met
    free_shuffles(spark)
    blocks = materialize(connected_components(edges))
    release(edges)

    some = may.select("cls", "n").join(blocks, F.col("cls") == F.col("id")).select(F.col("component").alias("block"), "cls", "n")
    size = some.groupBy("block").agg(F.sum(F.col("n") * 8).alias("bytes"), F.count("*").alias("classes"))
    size = size.select("block", F.greatest(F.ceil(F.col("bytes") / part_bytes), F.ceil(F.col("classes") / part_classes)).cast("int").alias("parts"))
    found = may.select("cls", "text").join(some.select("block", "cls"), "cls").join(size, "block").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    # of a block in parts, a part meets itself and each other part once
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = found.select("block", "cls", "text", (F.col("parts") == 1).alias("whole"), F.col("part").alias("side"), other).select("*", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"))
    links = dealt.groupBy("block", "x", "y").applyInArrow(_link_block(width, percent), "a long, b long, whole boolean")
    links = materialize(links.distinct())
    if links.where("not whole").limit(1).count():
        roots = connected_components(links.where("not whole and a != b")).select(F.col("id").alias("cls"), F.col("component").alias("root"))
        roots = roots.unionByName(links.where("whole").select(F.col("a").alias("cls"), F.col("b").alias("root")))
    else:
        roots = links.select(F.col("a").alias("cls"), F.col("b").alias("root"))
    # what is joined has a row a class: copies and components of any size come in as counts and minima
    linked = materialize(roots.join(classes.select("cls", "doc_id"), "cls"))
    low = materialize(linked.groupBy("root").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    hot = [r.root for r in low.where(F.col("n") > hot_limit(linked.count())).select("root").collect()]
    component = classes.select("cls", "doc_id").join(join_hot(linked.select("cls", "root"), low.select("root", "low"), "root", hot).select("cls", "low"), "cls", "left")
    component = materialize(component.select("cls", F.coalesce("low", "doc_id").alias("low")))
    total = classes.agg(F.sum("copies")).first()[0] or 0
    hot = [r.cls for r in classes.where(F.col("copies") > hot_limit(total)).select("cls").collect()]
    found = join_hot(rows.where("n > 0"), component, "cls", hot, "left").select("doc_id", "n", "low", "text_hash").unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("low"), "text_hash"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("low")).alias("component_id"), "text_hash")


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents: 5-word shingles of the lower-cased text, similarity 0.75.

    Null and empty texts have empty sets; of repeated rows each is there; other columns don't matter."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text_hash")
