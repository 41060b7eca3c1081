"""Best-two-fit packing of documents into sequences of at most SEQUENCE tokens.

Only lengths matter to a packing, and there are at most SEQUENCE of them. So the packing is planned from the
counts of lengths: fill a bin greedily, largest first; where a gap is left, replace the bin's smallest document
with the two unpacked ones that fill the gap and its room most tightly; use this bin as often as the counts
allow. Short documents fill what gaps remain. Every step uses up a length, so the plan has a few thousand rows whatever the input. Documents are
ranked within their length (a count per task and length, no global sort) and look up their place in the plan.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import UNITS, Known, byte_alphabet, is_byte_level, tokenizer_path
from .common import held, materialize, small_batches

SEQUENCE, END = 1024, 2
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


class CachedEncoder:
    """The tokenizers library's ids, each distinct unit (see bpe) encoded once.

    Where the file's ids follow its merges, as byte-level files' do, units go through tiktoken's merge loop with
    the same vocabulary, which takes a sixth of the library's time and gives its ids; else, and for units of odd
    white space or whose line ends merge, through the library. Texts with an added token's string, and all texts
    where the file isn't plain byte-level BPE, go to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = is_byte_level(spec)
        self.fast = self._merge_loop(spec["model"]) if self.plain else None
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids[:1]
        self.known = Known()

    @staticmethod
    def _merge_loop(model: dict):
        import public_tokenizers
        import tiktoken

        alphabet, vocab = byte_alphabet(), model["vocab"]
        pairs = ((m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
        if [vocab["".join(p)] for p in pairs] != list(range(256, 256 + len(model["merges"]))):
            return None
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if i < 256 + len(model["merges"])}
        return tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: set[str]) -> None:
        """Many units in one text, a line each: a line's end is a token of its own beside anything but white space."""
        plain = [] if self.fast is None else [u for u in units if len(u) > 1 and not (u[0] if u[0] != " " else u[1]).isspace() or len(u) == 1 and not u.isspace()]
        other = list(units.difference(plain))
        for a in range(0, len(plain), 2000):
            some = plain[a : a + 2000]
            ids = np.array(self.fast.encode_ordinary("\n".join(["", *some, ""])), "<u4")
            at = (4 * np.flatnonzero(ids == self.line)).tolist()
            raw = ids.tobytes()
            if len(at) != len(some) + 1:  # a line end merged with a unit
                other += some
                continue
            self.known.update(zip(some, [raw[i + 4 : j] for i, j in zip(at[:-1], at[1:], strict=True)], strict=True))
        self.known.update(zip(other, self._encode(other), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        units = [None if not self.plain or any(s in t for s in self.special) else UNITS.findall(t) for t in texts]
        self._learn(self.known.missing(set().union(*(u for u in units if u is not None))))
        known = self.known.__getitem__
        return [b"".join(map(known, u)) if u is not None else self._encode([t])[0] for u, t in zip(units, texts, strict=True)]


def _pieces(path: str, most: int, end: int):
    def run(batches):
        if ("packing", path) not in held:
            held["packing", path] = CachedEncoder(path)
        encoder = held["packing", path]
        task, seen = TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        tail = end.to_bytes(4, "little")
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                ids, texts = batch.column(0).slice(a, 200).to_pylist(), [t or "" for t in batch.column(1).slice(a, 200).to_pylist()]
                rows = []
                for doc_id, raw in zip(ids, encoder.encode(texts), strict=True):
                    raw += tail
                    n = len(raw) // 4
                    cut = [0, *range(n % most or most, n + 1, most)] if n > most else [0, n]
                    for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                        rows.append((doc_id, k, i, j - i, zlib.crc32(raw[4 * i : 4 * j]), task, int(seen[j - i])))
                        seen[j - i] += 1
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])

    return run


def _fill(gap: int, lengths: list[int], left: dict[int, int]) -> dict[int, int]:
    """Of the unpacked lengths the largest that fits, again and again."""
    have: dict[int, int] = {}
    top = bisect_right(lengths, gap)
    while gap and top:
        n = lengths[top - 1]
        k = min(gap // n, left[n])
        if k:
            have[n] = k
            gap -= k * n
        top = min(top - 1, bisect_right(lengths, gap))
    return have


def _two_for_smallest(have: dict[int, int], most: int, lengths: list[int], left: dict[int, int]) -> None:
    """Replace a bin's smallest document with the two unpacked ones that fill the gap and its room most tightly."""
    small = min(have)
    room, best = most - sum(n * k for n, k in have.items()) + small, (small, 0, 0)
    if room == small or sum(have.values()) < 2:
        return
    free = lambda n: left[n] - have.get(n, 0)
    i, j = 0, bisect_right(lengths, room) - 1
    while i <= j:
        a, b = lengths[i], lengths[j]
        if a + b > room or not free(b):
            j -= 1
        elif not free(a) or (i == j and free(a) < 2):
            i += 1
        else:
            best = max(best, (a + b, a, b))
            i += 1
    if best[1]:
        have[small] -= 1
        for n in best[1:]:
            have[n] = have.get(n, 0) + 1
        if not have[small]:
            del have[small]


def plan_packing(counts: dict[int, int], most: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, copies in a bin, first bin, offset): rank r of the length is in bin
    first bin + (r - first rank) // copies, at offset + (r - first rank) % copies * length.

    Documents under a sixth of a sequence wait (Friesen and Langston, 1991): they fill the gaps that the others
    leave, and only what then remains of them opens bins of its own."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def close(have: dict[int, int], taken: dict[int, int], times: int) -> None:
        """times bins of have; left doesn't count taken any more."""
        nonlocal bins
        offset = 0
        for n in sorted(have, reverse=True):
            k = have[n]
            rows.append((n, used[n], times * k, k, bins, offset))
            used[n] += times * k
            offset += k * n
            left[n] -= times * (k - taken.get(n, 0))
        bins += times

    groups: list[tuple[dict[int, int], int]] = []
    large = sorted(n for n in left if 6 * n >= most)
    while large:
        have = _fill(most, large, left)
        _two_for_smallest(have, most, large, left)
        times = min(left[n] // k for n, k in have.items())
        for n, k in have.items():
            left[n] -= times * k
        groups.append((have, times))
        large = [n for n in large if left[n]]
    small = sorted(n for n in left if 6 * n < most)
    for have, times in groups:
        gap = most - sum(n * k for n, k in have.items())
        while times:
            more = _fill(gap, small, left)
            now = min([times, *(left[n] // k for n, k in more.items())])
            close(have | more, have, now)
            times -= now
            small = [n for n in small if left[n]]
    while small:
        have = _fill(most, small, left)
        _two_for_smallest(have, most, small, left)
        close(have, {}, min(left[n] // k for n, k in have.items()))
        small = [n for n in small if left[n]]
    return rows


def _place(plan: list[tuple[int, ...]]):
    table: dict[int, np.ndarray] = {}
    for n in {r[0] for r in plan}:
        table[n] = np.array(sorted(r[1:] for r in plan if r[0] == n), np.int64)

    def run(batches):
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("nth")).to_numpy() + b.column(b.schema.get_field_index("before")).to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                rows = table[int(n)]
                first, _, copies, bins, offset = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1].T
                at = rank[own] - first
                seq[own], off[own] = bins + at // copies, offset + at % copies * n
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, most: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row per piece of each row of (doc_id, text): its ids' place in the document and in a sequence."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(docs.mapInArrow(_pieces(path, most, end), _PIECES))
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `most` rows
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "task"])
    return ranked.mapInArrow(_place(plan_packing(total, most)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_pack(spark, sf_dir: str) -> DataFrame:
    """Packs every whole text; null and empty texts are the end id alone. Repeated rows are packed each."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer_path())
