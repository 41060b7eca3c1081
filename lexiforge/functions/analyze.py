"""Text analysis as Column functions, with the same analysis of a query string on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .porter import stem

# The default English stopwords.
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his "
    "himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this "
    "that that'll these those am is are was were be been being have has had having do does did doing a an the and but "
    "if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don don't should "
    "should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't "
    "haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't "
    "weren weren't won won't wouldn wouldn't"
).split()

# What is taken out, and what a token is. A tag does not span lines in a document, since documents are
# read line by line. White space that ends a URL is Unicode's and the information separators, spelled out, since what
# \s means differs between Java, Python and SQL.
TAG_IN_LINE, TAG = r"<[^>\r\n]+>", r"<[^>]+>"
SPACES = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
URL = rf"""(?i)\b(?:https?://|ftp://|file://|mailto:|www\.)[^{SPACES}<>'"]+"""
TOKEN = r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"


@dataclass(frozen=True)
class AnalyzerConfig:
    """stopwords: None for the default list, an empty tuple for none. Nothing is downloaded."""

    stopwords: tuple[str, ...] | None = None
    stem: bool = True

    @property
    def stops(self) -> tuple[str, ...]:
        return tuple(STOPWORDS) if self.stopwords is None else self.stopwords


PLAIN = AnalyzerConfig(stopwords=(), stem=False)


def clean(text: Column) -> Column:
    """Lower case without HTML tags and URLs."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), TAG_IN_LINE, " "), URL, " ")


def unstemmed(text: Column, config: AnalyzerConfig) -> Column:
    """array<string>: tokens of at least two characters that aren't all digits nor stopwords; null gives none."""
    found = F.regexp_extract_all(clean(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))
    kept = F.filter(found, lambda t: (F.length(t) > 1) & ~t.rlike("^[0-9]+$"))
    if config.stops:
        kept = F.filter(kept, lambda t: ~t.isin(*config.stops))  # as many as make Spark hash them
    return kept


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_all(found: pa.Array) -> pa.Array:
    """The stems of each row's tokens; a batch's distinct tokens are stemmed once."""
    flat = found.flatten().cast(pa.string()).dictionary_encode()
    stems = pa.array([stem(t) for t in flat.dictionary.to_pylist()], pa.string())
    ends = np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False), dtype=np.int32)
    return pa.ListArray.from_arrays(np.append(np.int32(0), ends), stems.take(flat.indices))


_POSTINGS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))


@F.arrow_udf(_POSTINGS)
def grouped(found: pa.Array) -> pa.Array:
    """Each row's tokens as its distinct terms with their counts and places; a batch's tokens are sorted at once."""
    flat, size = found.flatten().cast(pa.string()).dictionary_encode(), pc.list_value_length(found).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    key = row * len(flat.dictionary) + flat.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")  # so that places ascend
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(head, len(key)).astype(np.int32)
    place = (np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size))[order].astype(np.int32)
    terms = flat.dictionary.take(flat.indices.take(pa.array(order[head])))
    each = pa.StructArray.from_arrays([terms, pa.array(np.diff(ends)), pa.ListArray.from_arrays(ends, pa.array(place))], ["term", "tf", "positions"])
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(row[order[head]], minlength=len(size)))).astype(np.int32), each)


def analyzed(text: Column, config: AnalyzerConfig) -> Column:
    """array<string>: the tokens of a text in order."""
    found = unstemmed(text, config)
    return stem_all(found) if config.stem else found


def tokens(docs: DataFrame, config: AnalyzerConfig, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep, pos, term): positions count the tokens that are kept. Nothing is shuffled."""
    return docs.select(F.col(doc_id).alias("doc_id"), *keep, F.posexplode(analyzed(F.col(text), config)).alias("pos", "term"))


def line_tokens(lines: DataFrame, config: AnalyzerConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep, pos, term) of documents that come as lines (doc_id, block, line, text): positions go on over all
    of a document's lines, in order of block and line.

    A distributed prefix sum: within a block (a split of a file, so of a bounded size) over its lines, then over the
    few sums of a document's blocks."""
    counted = lines.select("doc_id", "block", "line", *keep, analyzed(F.col("text"), config).alias("tokens"))
    within = Window.partitionBy("doc_id", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    among = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy("doc_id", "block").agg(F.sum(F.size("tokens")).alias("n")).select("doc_id", "block", F.coalesce(F.sum("n").over(among), F.lit(0)).alias("before"))
    placed = counted.withColumn("at", F.coalesce(F.sum(F.size("tokens")).over(within), F.lit(0))).join(sums, ["doc_id", "block"])
    return placed.select("doc_id", *keep, (F.col("before") + F.col("at")).alias("start"), F.posexplode("tokens").alias("i", "term")).select("doc_id", *keep, (F.col("start") + F.col("i")).cast("int").alias("pos"), "term")


def analyze_text(text: str | None, config: AnalyzerConfig) -> list[str]:
    """The tokens of a query part."""
    if text is None:
        return []
    text = re.sub(URL, " ", re.sub(TAG, " ", text.lower()))
    stops = frozenset(config.stops)
    kept = [t for t in re.findall(TOKEN, text) if len(t) > 1 and not re.fullmatch("[0-9]+", t) and t not in stops]
    return [stem(t) for t in kept] if config.stem else kept
