"""Documents from text files or tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def text_files(spark: SparkSession, *paths: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(doc_id, key, text): one row a file; a path given twice counts once. Directories are no documents.

    Ids follow the order of keys. Files are ranked within ranges of keys and offset by the ranges before."""
    read = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob)
    files = read.text(list(dict.fromkeys(paths)), wholetext=True).select(F.col("_metadata.file_path").alias("key"), F.col("value").alias("text"))
    return with_ids(files.dropDuplicates(["key"]))


def text_lines(spark: SparkSession, *paths: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(doc_id, key, byte_length, block, line, text): one row a line, for files of any size; a path given twice counts
    once. Ids follow the order of keys, of the files that have a line.

    block is where the split of the file starts that the line was read in, line orders a block's lines; both are right
    for as long as the files stay as they are, since reading a split again gives its lines in the same order."""
    read = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob)
    meta = F.col("_metadata")
    rows = read.text(list(dict.fromkeys(paths))).select(meta["file_path"].alias("key"), meta["file_size"].alias("byte_length"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
    ids = with_ids(rows.select("key").distinct())
    return rows.join(ids, "key").select("doc_id", *rows.columns)


def with_ids(docs: DataFrame, key: str = "key") -> DataFrame:
    """docs with a dense doc_id from 0 in the order of key."""
    keys = docs.select(key).repartitionByRange(key).withColumn("__part", F.spark_partition_id())
    ctx = docs.sparkSession.sparkContext
    if not ctx._jsc.sc().getCheckpointDir().isDefined():
        root = docs.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not ctx.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        ctx.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="lexiforge-"))
    keys = keys.checkpoint()  # ranges come from a sample: freeze them
    sizes = keys.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    ids = keys.join(before, "__part").select(key, (F.col("before") + rank - 1).alias("doc_id"))
    return docs.join(ids, key).select("doc_id", *docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(docs: DataFrame, most: int = 128 << 20) -> DataFrame:
    """docs dealt to all cores where a small table comes in fewer parts (a file of one row group is one task)."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < most * cores else docs
