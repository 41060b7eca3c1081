"""Phrases over positional postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import STATS


def _starts(places: list[int]) -> Column:
    """Where a phrase would start by the positions of a word that stands at places of it."""

    def before(i: int) -> Column:
        return F.transform("positions", lambda x: x - F.lit(i)) if i else F.col("positions")

    return reduce(F.array_intersect, map(before, places))


def phrase_hits(postings: DataFrame, words: list[str], df: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, tf, the document's statistics): how often words stand side by side; hits may overlap.

    A document at a time: each word's positions, shifted by its place, are intersected, beginning with the rarest word
    (df; else in the phrase's order). One row a word and document is joined, none a position; while few documents are
    left, Spark sends those to the next word's postings instead of shuffling them."""
    have = [c for c in STATS if c in postings.columns]
    if not words:
        return postings.select("doc_id", F.lit(0).alias("tf"), *have).limit(0)
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    order = sorted(places, key=lambda w: (df or {}).get(w, 0))
    out = postings.where(F.col("term") == order[0]).select("doc_id", *have, _starts(places[order[0]]).alias("starts"))
    for w in order[1:]:
        out = out.where(F.size("starts") > 0)
        other = postings.where(F.col("term") == w).select("doc_id", _starts(places[w]).alias("others"))
        out = out.join(other, "doc_id").select("doc_id", *have, F.array_intersect("starts", "others").alias("starts"))
    return out.where(F.size("starts") > 0).select("doc_id", F.size("starts").alias("tf"), *have)
