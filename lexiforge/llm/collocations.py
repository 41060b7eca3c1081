"""Phrase collocations by bucket counts (PCY, DHP) and Apriori pruning.

Pass k reads all texts, counts phrases of k words exactly and, in a table of buckets, those of k + 1 words. A phrase of
k + 1 words is counted in the next pass only if its bucket has enough of them and both phrases of k words in it are
frequent. Buckets and frequent phrases come back as bitmaps of a fixed largest size, whatever the corpus: they let some
phrases through that aren't frequent, which the exact counts then drop, and none away that is. A phrase goes into a
bucket only if both phrases of k words in it went through to the count themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_limit, join_hot, materialize, mix, release, slabs, small_batches, text_buffer, word_hashes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Of each byte whether it ends a piece, and whether it ends a word.
_CUTS = np.zeros(256, bool)
_CUTS[[*b".,;:!?", *range(10, 14)]] = True
_ENDS = _CUTS.copy()
_ENDS[[9, 32]] = True
_TIMES = np.uint64(0x9E3779B97F4A7C15)

#: log2 of the most buckets (a bitmap of 16 MB, 128 MB of counts in a task), and of those sent together.
MOST_BITS, PART_BITS = 27, 20
#: Words of a text that are worked on at once, and bytes of texts.
WORDS, SLAB = 1 << 20, 4 << 20
_RAW = "lang string, phrase string, n long, part int, data binary"


def bits_for(text_bytes: int) -> int:
    """log2 of the buckets: one for about sixteen bytes of text, up to MOST_BITS."""
    return min(MOST_BITS, max(PART_BITS, (text_bytes // 16).bit_length()))


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little")


def keys(h: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the phrases of k consecutive words, from those of the words and of each word's lang."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        g = h[:n].copy()
        for j in range(1, k):
            g = g * _TIMES + h[j : n + j]
        return mix(g + seeds[:n] * np.uint64(2 * k + 1))


def has(bitmap: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    at = (key >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


class Buckets:
    """Counts by bucket up to most, sent in parts."""

    def __init__(self, bits: int, most: int):
        self.bits, self.most = bits, most
        self.counts = np.zeros(1 << bits, np.uint8 if most < 256 else np.uint32)

    def add(self, key: np.ndarray) -> None:
        at, n = np.unique((key >> np.uint64(64 - self.bits)).astype(np.int64), return_counts=True)
        self.counts[at] = np.minimum(self.counts[at] + n, self.most)

    def rows(self):
        size = 1 << PART_BITS
        for part, a in enumerate(range(0, len(self.counts), size)):
            some = self.counts[a : a + size]
            if some.any():
                data = pa.compress(some.tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["lang", "phrase", "n", "part", "data"])


def _merge(most: int):
    """Parts of counts to parts of a bitmap: buckets with at least most."""
    kind, size = np.dtype(np.uint8 if most < 256 else np.uint32), 1 << PART_BITS

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                some = np.frombuffer(pa.decompress(data.as_buffer(), size * kind.itemsize, "zstd", asbytes=True), kind)
                old = sums.get(part)
                sums[part] = some if old is None else np.minimum(old.astype(np.uint32) + some, most).astype(kind)
        for part, some in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(some >= most).tobytes()], pa.binary())], ["part", "data"])

    return run


class Words:
    """The words of a slab of texts, one after the other with a space behind each."""

    def __init__(self, text: pa.Array):
        buf, offs = text_buffer(text)
        word = ~_ENDS[buf]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = offs[1:] > offs[:-1]
        at, end = offs[:-1][full], offs[1:][full] - 1
        first[at] |= word[at]
        last[end] |= word[end]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offs[1:], starts, "right")
        #: Words of one piece have the same number.
        self.piece = np.searchsorted(np.flatnonzero(_CUTS[buf]), starts) + self.doc
        size = ends - starts + 1
        self.at = np.concatenate(([0], np.cumsum(size)))
        kept = word
        kept[ends[ends < len(buf)]] = True  # the byte behind a word, unless the next text's word stands there
        glued = np.isin(ends, starts, assume_unique=True) | (ends == len(buf))
        self.buf = _LOWER[np.insert(buf[kept], (self.at[1:] - 1 - np.cumsum(glued) + glued)[glued], 32)] if glued.any() else _LOWER[buf[kept]]
        self.buf[self.at[1:] - 1] = 32
        self.hashes = word_hashes(self.buf, np.array([0, len(self.buf)]))[0]

    def phrases(self, places: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words from places on."""
        a, b = self.at[places], self.at[places + k] - 1
        offs = np.concatenate(([0], np.cumsum(b - a)))
        rows = np.repeat(a - offs[:-1], b - a) + np.arange(offs[-1])
        return pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(self.buf[rows])).cast(pa.string())


def _pass(k: int, longest: int, least: int, bits: int, gates):
    """Pass k: distinct phrases of each slab with their counts; at the end the buckets of those one word longer.

    gates: bitmaps of the frequent phrases of k - 1 words and of the buckets of k words; of nothing in the first pass."""

    def run(batches):
        maps = gates.value if gates else None
        buckets = Buckets(bits, least) if k < longest else None
        for (lang,), text in slabs(batches, ["lang"], SLAB):
            langs = lang.dictionary_encode()
            names = langs.dictionary.to_pylist()
            seed_of, code_of = np.array([_seed(x) for x in names], np.uint64), langs.indices.to_numpy()
            words = Words(text)
            code = code_of[words.doc]
            for a in range(0, len(words.doc), WORDS):
                some = slice(a, min(len(words.doc), a + WORDS + k))
                h, seeds, piece = words.hashes[some], seed_of[code[some]], words.piece[some]
                key = keys(h, seeds, k)
                ok = piece[: len(key)] == piece[k - 1 :]
                if maps:
                    ok &= has(maps[1], key, bits)
                    shorter = has(maps[0], keys(h, seeds, k - 1), bits)
                    ok &= shorter[:-1] & shorter[1:]
                if buckets:
                    longer = keys(h, seeds, k + 1)[:WORDS]
                    n = len(longer)
                    in_one = piece[:n] == piece[k : n + k]
                    buckets.add(longer[in_one & ok[:n] & ok[1 : n + 1]])
                places = np.flatnonzero(ok[:WORDS])
                if len(places):
                    _, at, n = np.unique(key[places], return_index=True, return_counts=True)
                    found = places[at] + a
                    none = pa.nulls(len(found))
                    rows = [pa.DictionaryArray.from_arrays(code[found], pa.array(names, pa.string())).cast(pa.string()), words.phrases(found, k), pa.array(n, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())]
                    yield pa.RecordBatch.from_arrays(rows, ["lang", "phrase", "n", "part", "data"])
        if buckets:
            yield from buckets.rows()

    return run


def _frequent(k: int, bits: int):
    """The bitmap of a table of phrases of k words."""

    def run(batches):
        seen = Buckets(bits, 1)
        for b in batches:
            lang = b.column(0).dictionary_encode()
            seed = np.array([_seed(x) for x in lang.dictionary.to_pylist()], np.uint64)[lang.indices.to_numpy()]
            buf, offs = text_buffer(b.column(1))
            ends = np.zeros(256, bool)
            ends[32] = True
            h, _ = word_hashes(buf, offs, space=ends)
            seen.add(keys(h, np.repeat(seed, k), k)[::k])
        yield from seen.rows()

    return run


def _bitmap(parts: DataFrame, bits: int, most: int) -> np.ndarray:
    """Parts of counts, merged and collected: 2 ** bits / 8 bytes."""
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << PART_BITS) // 8
    for r in parts.select("part", "data").repartition("part").mapInArrow(_merge(most), "part int, data binary").toLocalIterator():
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(r.data, np.uint8)
    return out


def frequent_phrases(docs: DataFrame, longest: int = 4, least: int = 30, bits: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """For each number of words up to longest (lang, phrase, f) of all phrases that stand in docs (lang, text) at least
    least times, and (lang, n), all words of each lang. Both are written tables."""
    spark = docs.sparkSession
    ctx = spark.sparkContext
    small_batches(spark)
    if bits is None:
        bits = bits_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    out: list[DataFrame] = []
    gates = totals = None
    for k in range(1, longest + 1):
        raw = materialize(docs.mapInArrow(_pass(k, longest, least, bits, gates), _RAW))
        rows = raw.where("part is null")
        if k == 1:
            totals = materialize(rows.groupBy("lang").agg(F.sum("n").alias("n")))
        out.append(materialize(rows.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)))
        if gates:
            gates.unpersist()
        if k < longest:
            frequent = _bitmap(out[-1].mapInArrow(_frequent(k, bits), _RAW), bits, 1)
            gates = ctx.broadcast([frequent, _bitmap(raw.where("part is not null"), bits, least)])
        release(raw)
    return out, totals


def _key(lang, phrase):
    """One column that tells (lang, phrase) apart."""
    return F.concat(F.length(lang).cast("string"), F.lit(":"), lang, phrase)


def _joined(words, a: int, n):
    return F.array_join(F.slice(words, a, n), " ")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, cover: int = 80, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the top phrases of 2 to longest words of each lang.

    Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and those into words at spaces and tabs.
    a: how often the phrase stands in docs; l, r: the same of its parts at the cut with the lowest score, the first of
    equal ones; n: words of the lang; score: 2000000 a / (l + r), rounded down. A phrase goes if a longer one that has
    it makes up cover percent or more of its places. Null lang is und, a null or empty text has no words; repeated rows
    count as often as they stand; an empty table gives no rows. Phrases tie by a, then by their bytes. Other columns
    don't matter. Memory follows the longest text by a few bytes a byte. Within a slab of texts phrases are told apart
    by 64-bit hashes."""
    levels, totals = frequent_phrases(docs, longest, least, bits)
    every, found = levels[0], levels[1]
    for x in levels[1:-1]:
        every = every.unionByName(x)
    for x in levels[2:]:
        found = found.unionByName(x)
    found = found.withColumnRenamed("f", "a").withColumn("words", F.split("phrase", " "))
    words, size = F.col("words"), F.size("words")

    # the parts of each cut, one row each, looked up at once; a common word is a part of very many phrases
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda c: F.array(F.struct(c.alias("cut"), F.lit(0).alias("side"), _joined(words, 1, c).alias("part")), F.struct(c.alias("cut"), F.lit(1).alias("side"), F.array_join(F.slice(words, c + 1, size - c), " ").alias("part")))))
    asked = found.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.cut", "c.side", _key(F.col("lang"), F.col("c.part")).alias("key"))
    asked = materialize(asked)
    limit = hot_limit(asked.count())
    hot = [r.key for r in asked.groupBy("key").count().where(F.col("count") > limit).select("key").collect()]  # under 500
    known = join_hot(asked, every.select(_key(F.col("lang"), F.col("phrase")).alias("key"), "f"), "key", hot)
    places = [(c, s) for c in range(1, longest) for s in (0, 1)]
    wide = known.groupBy("lang", "phrase", "a").agg(*(F.max(F.when((F.col("cut") == c) & (F.col("side") == s), F.col("f"))).alias(f"f{c}{s}") for c, s in places))

    def scored(c: int):
        left, right = F.col(f"f{c}0"), F.col(f"f{c}1")
        return F.when(left.isNotNull(), F.struct(F.expr(f"cast(2000000 as decimal(20,0)) * cast(a as decimal(18,0)) div cast(f{c}0 + f{c}1 as decimal(38,0))").alias("score"), F.lit(c).alias("cut"), left.alias("l"), right.alias("r")))

    best = wide.select("lang", "phrase", "a", F.array_min(F.array_compact(F.array(*(scored(c) for c in range(1, longest))))).alias("best"))

    # what stands almost only inside something longer
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    longer = found.where(size > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    # the best of each share of a lang first: a lang may have most of all phrases
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    some = kept.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) v(k) WHERE len(ws) >= k)),
t AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, cut, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, a, array_to_string(ws[j:j + m - 1], ' ') AS phrase
      FROM (SELECT *, unnest(range(1, k - m + 2)) AS j FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))),
o AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
q AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM q JOIN t USING (lang) QUALIFY rank <= 2000
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each lang of documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
