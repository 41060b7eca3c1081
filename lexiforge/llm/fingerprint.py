"""Homomorphic multiset hash of a text's paragraphs. DataFrame functions only.

A paragraph is a sentence or line with its end, cut every 120 characters. Its sha256 gives 180 bits, each a +1
or -1 of one lane; a text's fingerprint is the lanes' sums over its paragraphs modulo 2**16. So texts of the same
paragraphs have the same fingerprint in any order, and a paragraph is added or taken out by adding or
subtracting its lanes. The signs of two different paragraphs agree by chance, hence the inner product of two
fingerprints (lanes read as numbers from -2**15) estimates that of the texts' paragraph counts, and its cosine
(0 to 1) is their likeness.

An edited text shares the paragraphs before the edit with its original, so each paragraph is hashed once and
counted for both or for the one that has it. Two lanes' counts of set bits are summed in one long, 32 bits apart,
which no text can overflow (it has fewer than 2**31 bytes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_shuffles, materialize

PARAGRAPH = r"[^.!?\n]{1,120}[.!?\n]*|[.!?\n]+"
WORDS, BITS = 3, 60
LANES = WORDS * BITS
HALF = BITS // 2
_MASK = 1 | 1 << 32


def paragraphs(text: Column) -> Column:
    """array<string>: every character is in one of them."""
    return F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))


def _of(units: Column, kind: int) -> Column:
    return F.transform(units, lambda u: F.struct(u.alias("u"), F.lit(kind).alias("kind")))


def two_texts(kept: Column, gone: Column, come: Column) -> Column:
    """Paragraphs (u) of a first text, kept (kind 0) and gone ones (1), and a second, kept and come ones (2)."""
    return F.concat(_of(kept, 0), _of(gone, 1), _of(come, 2))


def lane_sums(rows: DataFrame, keys: list[str], units: str) -> DataFrame:
    """keys, first and second: the signed sums of the lanes of the two texts of each row's two_texts() column.

    Sums run where the rows are if they are dealt by one of keys; else a row of counts a text and kind is shuffled.
    Keys are six at most, so that the sums' rows have fields few enough for generated code."""
    out = rows.select(*keys, F.explode_outer(units).alias("e")).selectExpr(*keys, "e.kind as kind", "sha2(e.u, 256) as h")
    out = out.selectExpr(*keys, "kind", "h", *(f"cast(conv(substring(h, {1 + 15 * i}, 15), 16, 10) as bigint) as w{i}" for i in range(WORDS)))
    out = out.selectExpr(*keys, "kind", "h", *(f"(w{i} & {(1 << HALF) - 1}L) | shiftleft(shiftright(w{i}, {HALF}), 32) as w{i}" for i in range(WORDS)))
    counted = [f"c{HALF * i + s}" for i in range(WORDS) for s in range(HALF)]
    bits = (F.expr(f"sum(shiftright(w{i}, {s}) & {_MASK}L) as c{HALF * i + s}") for i in range(WORDS) for s in range(HALF))
    counts = out.groupBy(*keys, "kind").agg(F.expr("count(h) as n"), *bits)
    each = [F.expr(f"coalesce(sum(if(kind != {3 - t}, {c}, 0L)), 0L) as {c}_{t}") for t in (1, 2) for c in ("n", *counted)]
    sums = counts.groupBy(*keys).agg(*each)
    low, high = "2 * (c{}_{} & 4294967295L) - n_{}", "2 * shiftrightunsigned(c{}_{}, 32) - n_{}"
    array = lambda t: ", ".join(part.format(HALF * i + s, t, t) for i in range(WORDS) for part in (low, high) for s in range(HALF))
    return sums.selectExpr(*keys, f"array({array(1)}) as first", f"array({array(2)}) as second")


def reduced(lanes: Column) -> Column:
    """The lanes modulo 2**16 as numbers from -2**15."""
    return F.transform(lanes, lambda x: F.pmod(x + F.lit(1 << 15), F.lit(1 << 16)) - F.lit(1 << 15))


def fingerprint_hex(lanes: str) -> Column:
    """The column lanes modulo 2**16, four hex digits each; three of them are written at a time, after a 1."""
    one = lambda i, k: f"shiftleft(pmod({lanes}[{i + k}], 65536L), {32 - 16 * k})"
    three = (f"substring(hex({1 << 48}L + {one(i, 0)} + {one(i, 1)} + {one(i, 2)}), 2, 12)" for i in range(0, LANES, 3))
    return F.expr(f"lower(concat({', '.join(three)}))")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0).cast("long"), lambda s, v: s + v)


def likeness(a: Column, b: Column, aa: Column, bb: Column) -> Column:
    """Cosine of two arrays of reduced lanes, not under 0; 1 for equal ones, 0 if just one is zero. aa, bb: their
    inner products with themselves."""
    cos = dot(a, b).cast("double") / (F.sqrt(aa.cast("double")) * F.sqrt(bb.cast("double")))
    return F.when(a == b, 1.0).when((aa > 0) & (bb > 0), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos)), 6)).otherwise(0.0)


def next_ids(docs: DataFrame, doc_id: str, n_chars: str) -> DataFrame:
    """(doc_id, next_id, k): the next smaller id (of the smallest one the largest), and a third of n_chars.

    Ids are dealt by range and the ranges frozen in a table; only one row of each range meets in one task."""
    ids = docs.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg((F.max(n_chars) / 3).cast("long").alias("k"))
    ranges = materialize(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    most = ranges.groupBy("part").agg(F.max("doc_id").alias("most"))
    below = most.select("part", F.coalesce(F.lag("most").over(Window.orderBy("part")), F.max("most").over(Window.partitionBy())).alias("below"))
    lower = F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ranges.join(below, "part").select("doc_id", F.coalesce(lower, F.col("below")).alias("next_id"), "k")


def _with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of the texts and of those whose last third head replaces."""
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("k", F.expr("cast(floor(n_chars / 3) as int)"))
    docs = docs.select("*", F.expr("substring(text, 1, cast(n_chars as int) - k)").alias("stays"), F.expr("substring(text, cast(n_chars as int) - k + 1, k)").alias("goes"), F.expr("substring(coalesce(head, ''), 1, k)").alias("comes"))
    # all paragraphs of what stays are whole but the last, which what follows may lengthen
    docs = docs.withColumn("units", paragraphs(F.col("stays"))).withColumn("cut", F.coalesce(F.get("units", F.size("units") - 1), F.lit("")))
    kept = F.slice("units", 1, F.greatest(F.size("units") - 1, F.lit(0)))
    after = lambda c: paragraphs(F.concat("cut", c))
    keys = ["row", "doc_id", "next_id", "least", "n_chars", "edited_sha256"]
    docs = docs.select("row", "doc_id", "next_id", "least", "n_chars", F.sha2(F.concat("stays", "comes"), 256).alias("edited_sha256"), two_texts(kept, after("goes"), after("comes")).alias("units"))
    sums = lane_sums(docs, keys, "units").withColumns({"a": reduced(F.col("first")), "b": reduced(F.col("second"))})
    sums = sums.withColumn("aa", dot(F.col("a"), F.col("a")))
    near = likeness(F.col("a"), F.col("b"), F.col("aa"), dot(F.col("b"), F.col("b")))
    return sums.select(*keys, near.alias("near_edited"), *(F.col(c).cast("array<smallint>").alias(c) for c in "ab"), "aa")


def _edited_pairs(docs: DataFrame) -> DataFrame:
    """A written table of each text's and its edited text's lanes; docs is a scan."""
    order = next_ids(docs.select("doc_id", F.length("text").alias("n")), "doc_id", "n")
    asked = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("asker"), "k")
    # the scan deals its rows alike at every attempt, so a row's number names it
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    # the window and both joins read one shuffle of the texts; a broadcast of ids would only save it on small tables
    # (a rank would be filtered before the shuffle on one side, and the shuffles would differ)
    keyed = docs.where("doc_id is not null").withColumn("least", F.lag("row").over(Window.partitionBy("doc_id").orderBy("text", "row")).isNull())
    told = keyed.where("least").join(asked.hint("merge"), "doc_id").select(F.col("asker").alias("doc_id"), F.col("doc_id").alias("next_id"), F.expr("substring(text, 1, cast(k as int))").alias("head"))
    told = keyed.join(told.hint("merge"), "doc_id", "left")
    alone = docs.where("doc_id is null").withColumns({"least": F.lit(False), "next_id": F.lit(None).cast("long"), "head": F.lit("")})
    return materialize(_with_edited(told).unionByName(_with_edited(alone)))


def op9_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and its edited text.

    Null texts are empty. Of rows that share a doc_id the one with the least text stands for it as the next
    document. A row without doc_id has no next document: its last third is replaced by nothing, near_next is 0
    or, if it is empty, 1. Repeated rows and texts of any number of paragraphs are as others."""
    done = _edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    free_shuffles(spark)  # the texts'
    nexts = done.where("least").select(F.col("doc_id").alias("next_id"), F.col("a").cast("array<long>").alias("c"), F.col("aa").alias("cc"))
    alone = done.where("next_id is null").withColumn("near_next", F.when(F.col("aa") > 0, 0.0).otherwise(1.0))
    out = done.where("next_id is not null").join(nexts, "next_id").withColumn("near_next", likeness(F.col("a").cast("array<long>"), F.col("c"), F.col("aa"), F.col("cc")))
    columns = ["doc_id", "n_chars", "edited_sha256", fingerprint_hex("a").alias("fingerprint"), fingerprint_hex("b").alias("edited_fingerprint"), "near_edited", "near_next"]
    return out.select(*columns).unionByName(alone.select(*columns))
