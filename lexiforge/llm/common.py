"""What the operators share: tables, scratch storage, word hashing over Arrow buffers, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_libc = ctypes.CDLL(None)
#: What a worker's process keeps between tasks of one operator; the next operator's trim() drops it.
held: dict = {}
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this machine only where all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        ctx = spark.sparkContext._jsc.sc().getCheckpointDir()
        if ctx.isDefined():
            root = ctx.get()
        elif not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="lexiforge-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lexiforge-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*dfs: DataFrame) -> None:
    """Delete materialized tables that no later step reads."""
    for df in dfs:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps: best effort, to save disk; no result needs it."""
    for _ in range(2):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)  # events hold the plans
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session may be gone at exit; the files are scratch
            return


def trim() -> None:
    """Drop what an earlier operator held in this reused worker and give back to the system what its tasks left free:
    in a long job both add to the next operator's own memory. The C library's part is left out where it has no such
    call."""
    held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the rows of an Arrow batch, so that long texts don't fill a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size, 0 where it has none (rows of an RDD); no job runs."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def buckets_for(df: DataFrame, factor: float, per_bucket: int = 24 << 20) -> int:
    """Shuffle buckets so that factor times the input gives about per_bucket bytes each."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, 1, int(min(plan_bytes(df) * factor / per_bucket, 1e6)))


def text_buckets(docs: DataFrame, factor: float, text: str = "text", per_bucket: int = 24 << 20) -> int:
    """As buckets_for, from the texts' own bytes: files of many copies are far smaller than their texts."""
    n = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, 1, int(min(n * factor / per_bucket, 1e6)))


#: A key with over 1/HOT_PARTS of a table's rows is hot (so fewer than HOT_PARTS are), if that's over HOT_ROWS rows.
HOT_PARTS, HOT_ROWS = 500, 1_000


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """left join right, which has each key once; the keys of hot, fewer than HOT_PARTS, join by broadcast, so that
    their rows stay where they are."""
    if not hot:
        return left.join(right, key, how)
    at = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(~at).join(right.where(~at), key, how).unionByName(left.where(at).join(F.broadcast(right.where(at)), key, how))


def hot_limit(rows: int) -> int:
    return max(HOT_ROWS, rows // HOT_PARTS)


class Recurring:
    """Keys that two chunks of a task, one after the other, both have. Both sent them, so both will be told that
    they repeat; later chunks know without asking, and a key that stands everywhere is sent a few times a task
    instead of once a chunk. Only every so many chunks are compared: what is missed is sent as ever."""

    def __init__(self, every: int = 16, most: int = 1 << 20):
        self.every, self.most, self.n = every, most, 0
        self.keys = self.before = np.zeros(0, np.uint64)

    def known(self, keys: np.ndarray) -> np.ndarray:
        """Of the next chunk's sorted distinct keys those that are known to repeat."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        out = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if self.n % self.every == 1:
            both = np.intersect1d(self.before, keys, assume_unique=True)
            if len(self.keys) + len(both) <= self.most:
                self.keys = np.union1d(self.keys, both)
        self.before = keys if self.n % self.every == 0 else self.keys[:0]
        self.n += 1
        return out


# ---------------------------------------------------------------- words in Arrow buffers

_M64 = (1 << 64) - 1


def _stream(seed: str, n: int) -> np.ndarray:
    raw = b"".join(hashlib.sha256(f"{seed}:{i}".encode()).digest() for i in range(-(-n // 4)))
    return np.frombuffer(raw, "<u8")[:n].copy()


_BYTE = _stream("byte", 256)
_BASE = int(_stream("base", 1)[0]) | 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base is odd)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                a = np.full(size, np.uint64(b), np.uint64)
                a[0] = 1
                both.append(np.cumprod(a, dtype=np.uint64))
        have = _powers[base] = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_buffer(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n+1 offsets into them; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()).fill_null("")
    n, bufs = len(arr), arr.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def _hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    pw, inv = powers(_BASE, len(buf) + 1)
    with np.errstate(over="ignore"):
        c = np.empty(len(buf) + 1, np.uint64)
        c[0] = 0
        np.cumsum(_BYTE[buf] * inv[: len(buf)], out=c[1:])
        return mix((c[ends] - c[starts]) * pw[starts] + (ends - starts).astype(np.uint64))


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool = False, piece: int = 1 << 19, space: np.ndarray = _SPACE, prefix: int = 0, tails: bool = False):
    """A 64-bit hash of each word ([^\\x20\\x09-\\x0D]+) of each text, and the n+1 word offsets of the texts.

    space says of each byte if it ends words; with prefix, the hashes of the words' first so many bytes
    come third; with tails, the words' last two bytes (of a word of one byte 0 and it). Works on pieces of the buffer, so memory beyond the result doesn't grow with a text's length."""
    if lower:
        buf = _LOWER[buf]
    word = ~space[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offs[1:] > offs[:-1]
    at, end = offs[:-1][full], offs[1:][full] - 1
    first[at] |= word[at]
    last[end] |= word[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    heads = np.empty(len(starts) if prefix else 0, np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + piece, "right")))
        a, b = starts[i], ends[j - 1]
        out[i:j] = _hash_words(buf[a:b], starts[i:j] - a, ends[i:j] - a)
        if prefix:
            heads[i:j] = _hash_words(buf[a:b], starts[i:j] - a, np.minimum(ends[i:j], starts[i:j] + prefix) - a)
        i = j
    at = np.searchsorted(starts, offs)
    if tails:
        two = buf[ends - 1] + np.where(ends - starts > 1, buf[np.maximum(ends - 2, 0)], 0) * np.int64(256)
        return out, at, two
    return (out, at, heads) if prefix else (out, at)


def rolling(h: np.ndarray, width: int, base: int, piece: int = 1 << 18) -> np.ndarray:
    """Rabin-Karp hashes of all width consecutive values of h (len(h) - width + 1 of them)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, n, piece):
            b = min(n, a + piece)
            part = h[a : b + width - 1]
            pw, inv = powers(base, len(part) + 1)
            c = np.empty(len(part) + 1, np.uint64)
            c[0] = 0
            np.cumsum(part * inv[: len(part)], out=c[1:])
            out[a:b] = (c[width:] - c[: b - a]) * pw[: b - a]
    return mix(out)


def slabs(batches, columns: list[str], most: int = 2 << 20):
    """Runs of rows whose texts have about most bytes (or one longer text): (values of columns, text array)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index("text"))
        _, offs = text_buffer(text)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
            j = min(j, batch.num_rows)
            yield [batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in columns], text.slice(i, j - i)
            i = j


def crc_remainder(doc_id, modulus: int):
    """crc32 of doc_id as text modulo modulus, as a column; null for a null doc_id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over the edges, for every id of an edge between two ids.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each round is a few grouped
    minima and joins, rounds grow with the logarithm of a component's size, nothing is collected.
    The edges are cut from their lineage after each round."""
    u, v = F.col("u"), F.col("v")
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u > v").distinct()
    cur, seen = materialize(cur), None
    n = cur.count()

    def with_least(links: DataFrame, low: DataFrame, rows: int) -> DataFrame:
        """links with the m of their u; the centres of large stars join by broadcast."""
        limit = hot_limit(rows)
        hot = [r.u for r in low.where(F.col("n") > limit).select("u").collect()] if rows > limit else []
        return join_hot(links, low.select("u", "m"), "u", hot)

    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = with_least(both, low, 2 * n).where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_least(large, low, n).select(F.explode(F.array(F.struct(v.alias("u"), F.col("m").alias("v")), F.struct(u.alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where(u > v).distinct()
        new = materialize(small)
        n, total = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(cur)
        cur = new
        if (n, total) == seen:
            break
        seen = (n, total)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    pairs = cur.select(u.alias("id"), v.alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("id"), "component").distinct())
