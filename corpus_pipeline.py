"""From raw documents to packed training sequences: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.bpe import tokenizer_path
from lexiforge.llm.common import materialize
from lexiforge.llm.jaccard import jaccard_components
from lexiforge.llm.packing import pack
from lexiforge.llm.pii import fit_pii, redact_pii
from lexiforge.llm.substring import substring_dedup
from lexiforge.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.7."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where("__score < 0.7").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of those with the smallest doc_id (null after all others) the one whose
    text's hash is least, whatever rows share a doc_id. Rows without words stay."""
    value = F.coalesce("text", F.lit(""))
    # a row without doc_id takes part under a number that its text gives, beyond those of the others
    own = F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64(value, F.lit(1)), 2) + F.lit(1 << 62))
    keyed = docs.withColumns({"__id": own, "__hash": F.xxhash64(value)})
    found = jaccard_components(keyed.select("__id", "text"), doc_id="__id")
    first = found.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    first = materialize(first.groupBy("doc_id").agg(F.min(F.struct("text_hash", "rows")).alias("f")).select(F.col("doc_id").alias("__id"), F.col("f.text_hash").alias("__hash"), F.col("f.rows").alias("__rows")))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.where(words).join(first, ["__id", "__hash"])
    out = kept.where("__rows = 1").select(*docs.columns)
    if first.where("__rows > 1").limit(1).count():
        out = out.unionByName(kept.where("__rows > 1").dropDuplicates(["__id", "__hash"]).select(*docs.columns))
    return out.unionByName(docs.where(~words))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that also start elsewhere; a document left without words goes."""
    out = substring_dedup(docs)
    return out.where("__n_removed = 0 or __n_removed < __n_words").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return redact_pii(docs, fit_pii(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 1024 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
