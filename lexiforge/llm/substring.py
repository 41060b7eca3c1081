"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recurring, free_shuffles, materialize, rolling, slabs, small_batches, text_buckets, text_buffer, trim, word_hashes

#: Windows of a chunk: their places fit two bytes.
CHUNK = 1 << 16
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SHUFFLED = "bucket int, chunk string, kind int, data binary"
_REPLIES = "chunk string, kind int, data binary"
_SPANS = "digest binary, at int, spans binary"


def _runs(flags: np.ndarray) -> np.ndarray:
    """[start, end) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)


def _emit(n_buckets: int, width: int):
    """Per chunk: for each bucket its windows' hashes and places, once per distinct window; and a header
    with the chunk's texts (digest, first window, windows) and the windows that are known to repeat: those that
    are twice in the chunk, and those that earlier chunks of the task had and sent."""

    def run(batches):
        trim()
        name, recurring = hashlib.md5(), Recurring()

        def rows(seg, h, x):
            # seg: (digest, first window, number of windows); h, x: their hashes, in that order
            keys, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            known = recurring.known(keys)
            local = (known | (count > 1))[inverse]
            keys, first = keys[~known], first[~known]
            name.update(b"".join(s[0] for s in seg) + len(h).to_bytes(4, "little") + seg[0][1].to_bytes(8, "little"))
            chunk = f"{task}-{name.hexdigest()}"
            head = len(seg).to_bytes(4, "little") + b"".join(s[0] for s in seg) + np.array([s[1:] for s in seg], "<i4").tobytes() + np.packbits(local).tobytes()
            bucket = ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
            cut = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))
            xs, ps = x[first].astype("<u2"), first.astype("<u2")
            out = [(int(name.hexdigest()[:8], 16) % n_buckets, chunk, 1, head)]
            out += [(b, chunk, 0, keys[i:j].tobytes() + xs[i:j].tobytes() + ps[i:j].tobytes()) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            return pa.RecordBatch.from_pydict({k: pa.array([r[c] for r in out], t) for c, (k, t) in enumerate([("bucket", pa.int32()), ("chunk", pa.string()), ("kind", pa.int32()), ("data", pa.binary())])})

        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for _, text in slabs(batches, []):
            buf, offs = text_buffer(text)
            wh, wo = word_hashes(buf, offs)
            if len(wh) < width:
                continue
            h, x = rolling(wh, width, _BASES[0]), rolling(wh, width, _BASES[1]) & np.uint64(0xFFFF)
            n = np.maximum(wo[1:] - wo[:-1] - width + 1, 0)
            seg: list = []
            hs: list = []
            total = 0
            for d in np.flatnonzero(n):
                digest = hashlib.md5(buf[offs[d] : offs[d + 1]].tobytes()).digest()
                for at in range(0, int(n[d]), CHUNK):  # cuts of a long text depend on the text alone
                    m = min(CHUNK, int(n[d]) - at)
                    if total + m > CHUNK:
                        yield rows(seg, np.concatenate([h[a:b] for a, b in hs]), np.concatenate([x[a:b] for a, b in hs]))
                        seg, hs, total = [], [], 0
                    seg.append((digest, at, m))
                    hs.append((wo[d] + at, wo[d] + at + m))
                    total += m
            if seg:
                yield rows(seg, np.concatenate([h[a:b] for a, b in hs]), np.concatenate([x[a:b] for a, b in hs]))

    return run


def _count(batches):
    """All of a bucket's windows meet here: reply to each chunk with the places of its windows that other chunks have too."""
    names: list[str] = []
    hs, xs, ps = [], [], []
    for batch in batches:
        chunk, kind, data = (batch.column(batch.schema.get_field_index(c)) for c in ("chunk", "kind", "data"))
        keep = kind.to_numpy(zero_copy_only=False) == 1
        if keep.any():
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([chunk.filter(mask), kind.filter(mask), data.filter(mask)], ["chunk", "kind", "data"])
        for i in np.flatnonzero(~keep):
            raw = data[int(i)].as_buffer()
            n = raw.size // 12
            hs.append(np.frombuffer(raw, "<u8", n))
            xs.append(np.frombuffer(raw, "<u2", n, 8 * n))
            ps.append(np.frombuffer(raw, "<u2", n, 10 * n))
            names.append(chunk[int(i)].as_py())
    if not hs:
        return
    size = [len(a) for a in hs]
    h, x, p = np.concatenate(hs), np.concatenate(xs), np.concatenate(ps)
    del hs, xs, ps, raw, data  # the views kept the batches
    order = np.argsort(h)
    h = h[order]
    same = np.concatenate(([False], h[1:] == h[:-1]))
    order = order[same | np.append(same[1:], False)]  # of windows whose first hash repeats
    if not len(order):
        return
    key = x[order]
    h = h[same | np.append(same[1:], False)]
    by = np.lexsort((key, h))
    h, key, order = h[by], key[by], order[by]
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (key[1:] == key[:-1])))
    order = order[same | np.append(same[1:], False)]
    src = np.repeat(np.arange(len(size)), size)[order]
    by = np.argsort(src, kind="stable")
    src, place = src[by], p[order][by]
    ids, at = np.unique(src, return_index=True)
    parts = np.split(place, at[1:])
    for a in range(0, len(ids), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in ids[a : a + 10_000]]), pa.array(np.zeros(len(ids[a : a + 10_000]), np.int32)), pa.array([p.tobytes() for p in parts[a : a + 10_000]], pa.binary())], ["chunk", "kind", "data"])


def _assemble(width: int):
    """A chunk's header and replies to its texts' covered word intervals."""

    def run(tbl: pa.Table) -> pa.Table:
        kind, data = tbl.column("kind").to_pylist(), tbl.column("data").to_pylist()
        head = next(d for k, d in zip(kind, data, strict=True) if k == 1)
        n = int.from_bytes(head[:4], "little")
        digests = [head[4 + 16 * i : 20 + 16 * i] for i in range(n)]
        seg = np.frombuffer(head, "<i4", 2 * n, 4 + 16 * n).reshape(n, 2)
        total = int(seg[:, 1].sum())
        at = 4 + 24 * n
        flags = np.unpackbits(np.frombuffer(head, np.uint8, -(-total // 8), at), count=total).astype(bool)
        for k, d in zip(kind, data, strict=True):
            if k == 0:
                flags[np.frombuffer(d, "<u2")] = True
        # further occurrences repeat inside the chunk and are flagged by the header already
        out, a = [], 0
        for digest, (first, m) in zip(digests, seg, strict=True):
            runs = _runs(flags[a : a + m])
            if len(runs):
                runs = runs + np.array([first, first + width - 1])
                out.append((digest, int(first), runs.astype("<i4").tobytes()))
            a += m
        return pa.Table.from_pydict({"digest": pa.array([o[0] for o in out], pa.binary()), "at": pa.array([o[1] for o in out], pa.int32()), "spans": pa.array([o[2] for o in out], pa.binary())})

    return run


def repeated_spans(docs: DataFrame, text: str = "text", window: int = 35) -> DataFrame:
    """(digest, spans): for each distinct text with a repeated window its maximal intervals of covered words.

    digest is the md5 of the text; spans an array of binaries of little-endian int32 pairs [first, end),
    one for each cut of a long text, to be merged. Windows of different chunks are told apart by 80 bits of two
    hashes, those of a chunk, and of a task those that stand in many chunks, by 64."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = text_buckets(docs, 2.0)
    met = docs.mapInArrow(_emit(n, window), _SHUFFLED).repartitionById(n, F.col("bucket"))
    replies = materialize(met.mapInArrow(_count, _REPLIES))
    del met
    free_shuffles(spark)
    spans = replies.groupBy("chunk").applyInArrow(_assemble(window), _SPANS)
    return materialize(spans.distinct().groupBy("digest").agg(F.sort_array(F.collect_list("spans")).alias("spans")))


def _keep(columns: list[str], text: str, with_text: bool):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts, spans = batch.column(names.index(text)), batch.column(names.index("__spans"))
            words_n, removed_n, kept = [], [], []
            for t, s in zip(texts, spans, strict=True):
                t = t.as_py()
                words = (t or "").encode().split()
                gone = 0
                left = words
                if s.is_valid:
                    cover = np.zeros(len(words) + 1, np.int32)
                    for one in s.as_py():
                        iv = np.frombuffer(one, "<i4").reshape(-1, 2)
                        np.add.at(cover, iv[:, 0], 1)
                        np.add.at(cover, iv[:, 1], -1)
                    keep = np.cumsum(cover[:-1]) == 0
                    gone = int(len(words) - keep.sum())
                    left = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                words_n.append(len(words))
                removed_n.append(gone)
                kept.append((b" ".join(left).decode() if gone else t) if with_text else hashlib.sha256(b" ".join(left)).hexdigest())
            cols = [pa.array(kept, pa.string()) if c == text and with_text else batch.column(names.index(c)) for c in columns]
            extra = [pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64())] + ([] if with_text else [pa.array(kept, pa.string())])
            yield pa.RecordBatch.from_arrays(cols + extra, columns + ["__n_words", "__n_removed"] + ([] if with_text else ["__kept"]))

    return run


def _with_spans(docs: DataFrame, text: str, window: int) -> DataFrame:
    """docs with __spans. Texts too short for a window, empty ones among them, are not shuffled; a digest with very
    many copies is a skewed key of a plain join, which Spark's adaptive execution splits."""
    spans = repeated_spans(docs, text, window).select(F.col("digest").alias("__digest"), F.col("spans").alias("__spans"))
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    may = F.length(value) >= 2 * window - 1
    keyed = docs.where(may).withColumn("__digest", F.unhex(F.md5(value.cast("binary"))))
    return keyed.join(spans, "__digest", "left").drop("__digest").unionByName(docs.where(~may).withColumn("__spans", F.lit(None).cast("array<binary>")))


def substring_dedup(docs: DataFrame, text: str = "text", window: int = 35) -> DataFrame:
    """docs with text reduced to the words that no repeated window covers (joined by one space; a text
    that loses nothing stays as it is, null too), and __n_words and __n_removed."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("__n_words", T.LongType()), T.StructField("__n_removed", T.LongType())])
    return _with_spans(docs, text, window).mapInArrow(_keep(docs.columns, text, True), schema)


def op10_substring(spark, sf_dir: str) -> DataFrame:
    """Per document its words, removed words and the sha256 of the kept ones.

    Null and empty texts have no words; a repeated row repeats all its windows; other columns don't matter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = _with_spans(docs, "text", 35).mapInArrow(_keep(["doc_id"], "text", False), "doc_id long, __n_words long, __n_removed long, __kept string")
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.col("__kept").alias("kept_sha256"))
