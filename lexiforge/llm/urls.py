"""URL lists: a blocked Bloom filter of listed canonical URLs before an exact hash join. DataFrame functions only.

The filter is probed where a URL is read: a URL without a possible hit is judged there and then, and only possible
hits are shuffled, by row, so that no host or null draws rows into one task.

A listed entry is a host and a path prefix; it fits the host and its subdomains where the path starts with the
prefix. Its canonical form is host and prefix in one string. A URL's possible entries are the ends of its host
(as many labels as entries have) with the beginnings of its path (of the lengths that entries have).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host, path prefix) of the query's list; fixed values of its contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The filter is broadcast up to this size, joined by block beyond.
BROADCAST_BYTES = 8 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _bits(key: Column, n_blocks: int) -> list[Column]:
    """The block of a key and one bit in each of the block's four words."""
    h, one = F.xxhash64(key, F.lit(17)), F.lit(1).cast("long")
    words = (F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")).alias(f"w{i}") for i in range(4))
    return [F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block"), *words]


def blocked_bloom(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """(block, w0..w3) of a filter with about 21 bits a key, and its number of blocks."""
    n_blocks = max(1, -(-n_keys // 12))
    rows = keys.select(*_bits(F.col(key), n_blocks))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"f{i}") for i in range(4))), n_blocks


def may_be_listed(df: DataFrame, key: str, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """Rows whose key passes the filter: all listed keys and a few others. Rows meet the filter's blocks in a shuffle."""
    hit = df.select("*", *_bits(F.col(key), n_blocks)).join(bloom, "block")
    for i in range(4):
        hit = hit.where(F.col(f"f{i}").bitwiseAND(F.col(f"w{i}")) != 0)
    return hit.select(*df.columns)


def dense(bloom: DataFrame, n_blocks: int) -> Column:
    """The whole filter as a scalar: an array of all blocks, at most BROADCAST_BYTES."""
    words = [f"f{i}" for i in range(4)]
    none = bloom.sparkSession.range(n_blocks).select(F.col("id").alias("block"), *(F.lit(0).cast("long").alias(w) for w in words))
    every = bloom.unionByName(none).groupBy("block").agg(*(F.bit_or(w).alias(w) for w in words))
    return every.agg(F.sort_array(F.collect_list(F.struct("block", *words))).alias("blocks")).scalar()


def passes(key: Column, blocks: Column, n_blocks: int) -> Column:
    """Whether key may be listed, by the dense filter."""
    block, *bits = _bits(key, n_blocks)
    # an array of one block: the filter itself is named once, not once a word
    has = lambda found: reduce(lambda x, y: x & y, (found[f"f{i}"].bitwiseAND(bit) != 0 for i, bit in enumerate(bits)))
    return F.exists(F.array(F.get(blocks, block.cast("int"))), has)


def url_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (the longest fitting one, else null) and verdict (the rule's, else default).

    rules: action, host, path; entries of one host and path count once, the least action. A null URL, or one
    without ://, has an empty host and path. pages is a stored table or a plan without a shuffle, whose rows come
    in one order at every attempt."""
    rules = rules.where("host is not null and path is not null").groupBy(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("n")).agg(F.min("action").alias("action"))
    about = rules.agg(F.count("*").alias("n"), F.max("labels").alias("labels"), F.collect_set("n").alias("lengths")).first()  # as many lengths as paths have
    host, path = host_and_path(url)
    parsed = pages.withColumns({"__host": host, "__path": path})
    parts = F.split("__host", r"\.")
    hosts = F.array(*(F.when((F.col("__host") != "") & (F.size(parts) >= k), F.array_join(F.slice(parts, -k, k), ".")) for k in range(1, (about.labels or 0) + 1)))
    paths = F.array(*(F.when(F.length("__path") >= n, F.substring("__path", 1, n)) for n in sorted(about.lengths)))
    keys = F.flatten(F.transform(F.array_compact(hosts), lambda h: F.transform(F.array_compact(paths), lambda p: F.concat(h, p))))
    bloom, n_blocks = blocked_bloom(rules, "key", about.n)
    if n_blocks * 48 <= BROADCAST_BYTES:
        parsed = parsed.withColumn("__blocks", dense(bloom, n_blocks)).withColumn("__keys", F.filter(keys, lambda k: passes(k, F.col("__blocks"), n_blocks)))
    else:
        parsed = parsed.withColumn("__keys", keys)
    columns = [*pages.columns, "__host", "__path"]
    none = parsed.where(F.size("__keys") == 0).select(*columns, F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    may = parsed.where(F.size("__keys") > 0).withColumn("__row", F.monotonically_increasing_id())
    asked = may.select("__row", F.struct(*columns).alias("__page"), F.explode("__keys").alias("key"))
    if n_blocks * 48 > BROADCAST_BYTES:
        # a key passes or not for all its rows, so each is tried once; one key of each row stays to carry it
        listed = may_be_listed(asked.select("key").distinct(), "key", bloom, n_blocks).join(rules.select("key", "n", "action"), "key")
    else:
        listed = rules.select("key", "n", "action")
    hits = asked.join(listed, "key", "left")
    best = hits.groupBy("__row").agg(F.first("__page").alias("p"), F.max(F.when(F.col("action").isNotNull(), F.struct(F.length("key").alias("n"), "key", "action"))).alias("b"))
    found = best.select(*(F.col("p")[c].alias(c) for c in columns), F.col("b.key").alias("rule"), F.col("b.action").alias("action"))
    out = none.unionByName(found)
    return out.select(*[F.col(c) for c in pages.columns], F.col("__host").alias("host"), F.col("__path").alias("path"), "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict on every url of pages; what no rule of the list fits is allowed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    entries = (F.struct(*(F.lit(v).alias(k) for k, v in zip(("action", "host", "path"), r, strict=True))) for r in RULES)
    rules = spark.range(1).select(F.explode(F.array(*entries)).alias("r")).select("r.*")
    return url_verdicts(pages, rules).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH parsed AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed
), rules(action, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), judged AS (
  SELECT *, (SELECT max({'n': length(h || p), 'rule': h || p, 'action': action}) FROM rules
             WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM split
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM judged
"""
