"""Many searches in one plan: mixed queries, and one query under many weightings."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.smart import DF, NORM, TF, byte_norm, check_scheme, df_number, tf_number, tf_weight, unique_norm
from .engine import Plan, SearchEngine
from .index import STATS, norm_name

CODES = [t + d for t in TF for d in DF]
SCHEMES = [f"{a}{m}.{b}{n}" for a in CODES for m in NORM for b in CODES for n in NORM]


def _best(scored: DataFrame, key: str, top_k: int | None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "first", "doc_id"))
    ranked = scored.withColumn("rank", rank)
    return (ranked if top_k is None else ranked.where(F.col("rank") <= top_k)).select(key, "doc_id", "score", "rank")


def search_many(engine: SearchEngine, queries: Mapping, top_k: int | None = 10, method: str = "bm25", scheme: str = "ltc.ltc", k1: float = 1.5, k3: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank) of plain, phrase and boolean queries, a mapping of ids to texts: what
    SearchEngine.search gives for each, with one look at each posting.

    One aggregate tells which tokens of all boolean queries score; then a posting goes to the queries that name its
    term, and one shuffle by (query, document) adds up scores and collects which of the query's leaves are there. The
    queries are part of the plan, so some hundreds are one call's worth. A query without any token gives no row; a
    malformed one raises ValueError; with no queries at all the result is empty."""
    if method not in ("tfidf", "bm25"):
        raise ValueError(f"method is tfidf or bm25, not {method!r}")
    doc, ask = check_scheme(scheme)
    ids, plans = list(queries), [engine.plan(text) for text in queries.values()]
    spark = engine.index.documents.sparkSession
    kind = "string" if any(isinstance(q, str) for q in ids) else "long"
    empty = spark.createDataFrame([], f"query_id {kind}, doc_id long, score double, rank int")
    every = Plan(list(dict.fromkeys(k for p in plans for k in p.leaves)), {k: w for p in plans for k, w in p.phrases.items()})
    if not every.tokens:
        return empty
    inside = [w for words in every.phrases.values() for w in words]
    df = engine._df(list(dict.fromkeys([*(t for t in every.tokens if t not in every.phrases), *inside])))
    hits = engine.hits(every, df)
    place = {k: i for i, k in enumerate(every.tokens)}
    trees = [(q, p) for q, p in enumerate(plans) if p.tree is not None]
    has = {k: F.array_contains("has", i) for k, i in place.items()}
    asked = {(q, *at): c for q, p in trees for at, c in engine._asks(p, has).items()}
    counts = {k: F.count(F.when(has[k], 1)) for k in every.phrases}
    if asked or counts:
        known = F.create_map(*(F.lit(x) for pair in place.items() for x in pair))
        flags = hits.groupBy("doc_id").agg(F.collect_set(known[F.col("term")]).alias("has"))  # no more than leaves
        got = list(flags.agg(F.array(*asked.values()).alias("asked") if asked else F.lit(None).alias("asked"), *(c.alias(f"n{i}") for i, c in enumerate(counts.values()))).first())
        df |= dict(zip(counts, got[1:], strict=True))
        found = dict(zip(asked, got[0] or (), strict=True))
        for q, p in trees:
            p.tokens = engine._kept(p, {(node, key): yes for (of, node, key), yes in found.items() if of == q})
    to: dict[str, list[Column]] = {}
    finish = None
    for q, p in enumerate(plans):
        rows, own = engine._bm25(p.tokens, df, k1, k3, b) if method == "bm25" else engine._smart(p.tokens, df, doc, ask) if p.tokens else ([], None)
        finish = own or finish
        at = {t: (w, i) for t, w, i in rows}
        for t in p.leaves if p.tree is not None and rows else at:
            w, i = at.get(t, (None, None))
            to.setdefault(t, []).append(F.struct(F.lit(q).alias("q"), F.lit(w).cast("double").alias("w"), F.lit(i).cast("int").alias("ord"), F.lit(place[t]).alias("leaf")))
    if not to:
        return empty
    weight, norm = finish
    asks = F.create_map(*(x for t, some in to.items() for x in (F.lit(t), F.array(*some))))
    each = hits.where(F.col("term").isin(*to)).select("doc_id", "tf", *STATS, F.explode(asks[F.col("term")]).alias("a")).select("doc_id", "tf", *STATS, "a.*")
    own = [c for c in norm[0] if c in STATS]
    out = each.groupBy("q", "doc_id").agg(F.sum(F.col("w") * weight).alias("dot"), F.min("ord").alias("first"), F.collect_set("leaf").alias("has"), *(F.max(c).alias(c) for c in own))
    ok = F.lit(True)
    for q, p in trees:
        ok = F.when(F.col("q") == q, engine._predicate(p, p.tree, has)).otherwise(ok)
    out = out.where(F.col("first").isNotNull() & ok)
    if len(own) < len(norm[0]):
        out = out.join(engine.index.doc_stats.select("doc_id", *norm[0]), "doc_id")
    scored = out.select(F.element_at(F.lit(ids), F.col("q") + 1).alias("query_id"), "doc_id", (F.col("dot") * norm[1]).alias("score"), "first")
    return _best(scored, "query_id", top_k)


def search_grid(engine: SearchEngine, query: str, top_k: int | None = 10) -> DataFrame:
    """(scheme, doc_id, score, rank): a query, plain or boolean, under each of the 3600 SMART weightings.

    A weighting is a product of four: 15 document weights and 15 query weights, whose sums over the query's terms make
    one shuffle by (document, document weight), then 4 norms of either side. A document has no row under a weighting
    that gives none of its terms a weight over 0."""
    plan, index = engine.plan(query), engine.index
    empty = index.documents.sparkSession.createDataFrame([], "scheme string, doc_id long, score double, rank int")
    if not plan.leaves:
        return empty
    df, hits, where = engine.prepared(plan)
    counts = {t: c for t, c in Counter(plan.tokens).items() if df.get(t)}
    if not counts:
        return empty
    all_counts = Counter(plan.tokens)
    n, _, avg_unique = index.stats
    most, mean = max(all_counts.values()), len(plan.tokens) / len(all_counts)
    order = {t: i for i, t in enumerate(all_counts)}

    def weights(t: str, d: str) -> list[float | None]:
        """Of term t under document weights with idf d its weight by query code, None where it isn't in the sum."""
        mine = df_number(d, df[t], n)
        theirs = [(tf_number(c[0], counts[t], most, mean), df_number(c[1], df[t], n)) for c in CODES]
        return [x * y if mine > 0 and y > 0 else None for x, y in theirs]

    table = {t: [weights(t, d) for d in DF] for t in counts}
    numbers = lambda xs: F.array(*(F.lit(x).cast("double") for x in xs))
    known = F.create_map(*(x for t, rows in table.items() for x in (F.lit(t), F.array(*map(numbers, rows)))))
    idf = F.create_map(*(x for t in counts for x in (F.lit(t), numbers([df_number(d, df[t], n) for d in DF]))))
    ords = F.create_map(*(F.lit(x) for t in counts for x in (t, order[t])))
    tf = {c: tf_weight(c, F.col("tf"), F.col("max_tf"), F.col("length") / F.col("unique_terms")) for c in TF}
    codes = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(DF.index(c[1])).alias("d"), (tf[c[0]] * idf[F.col("term")][DF.index(c[1])]).alias("x")) for c in CODES))
    kept = hits if where is not None else hits.where(F.col("term").isin(*counts))
    each = kept.select("doc_id", "term", "unique_terms", "byte_length", F.inline(codes)).withColumn("w", known[F.col("term")][F.col("d")])
    sums = [F.sum(F.col("x") * F.col("w")[i]).alias(f"s{i}") for i in range(len(CODES))]
    firsts = [F.min(F.when(F.col("w")[i].isNotNull(), ords[F.col("term")])).alias(f"f{i}") for i in range(len(DF))]  # CODES begins with TF[0] and each of DF
    out = each.groupBy("doc_id", "code", "d").agg(*sums, *firsts, F.max("unique_terms").alias("unique_terms"), F.max("byte_length").alias("byte_length"), *([where.alias("ok")] if where is not None else []))
    if where is not None:
        out = out.where("ok")
    index = engine.index = index.with_norms()
    cosine = [norm_name(c + "c") for c in CODES]
    out = out.join(index.doc_stats.select("doc_id", *cosine), "doc_id")
    cosine = F.create_map(*(x for c, name in zip(CODES, cosine, strict=True) for x in (F.lit(c), F.col(name))))[F.col("code")]
    size = len("".join(plan.tokens).encode())
    reference = numbers([byte_norm({"b": size, "u": len(all_counts)}.get(m, 0)) for m in NORM])
    by_query = {"n": F.lit(1.0), "u": F.lit(unique_norm(len(all_counts), avg_unique)).cast("double"), "b": F.lit(byte_norm(size)).cast("double")}
    squares = [[sum(w * w for w in (table[t][d][i] for t in counts) if w is not None) for i in range(len(CODES))] for d in range(len(DF))]
    by_query["c"] = F.array(*(numbers([1 / math.sqrt(x) if x else 1.0 for x in row]) for row in squares))[F.col("d")][F.col("i")]
    i, j, k = F.floor(F.col("at") / 16).cast("int"), F.floor(F.col("at") / 4).cast("int") % 4, F.col("at") % 4
    by_doc = {"n": F.lit(1.0), "c": cosine, "u": unique_norm(F.col("unique_terms"), avg_unique), "b": reference[F.col("j")] if engine.byte_norm == "reference" else byte_norm(F.col("byte_length"))}
    pick = lambda c, by: F.coalesce(*(F.when(c == x, by[m]) for x, m in enumerate(NORM)))
    out = out.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(16 * len(CODES) - 1)))).withColumns({"i": i, "j": j, "k": k})
    scored = out.select(
        F.concat("code", F.substring(F.lit(NORM), F.col("k") + 1, F.lit(1)), F.lit("."), F.element_at(F.lit(CODES), F.col("i") + 1), F.substring(F.lit(NORM), F.col("j") + 1, F.lit(1))).alias("scheme"),
        "doc_id",
        (F.element_at(F.array(*(f"s{c}" for c in range(len(CODES)))), F.col("i") + 1) * pick(F.col("j"), by_query) * pick(F.col("k"), by_doc)).alias("score"),
        F.element_at(F.array(*(f"f{c}" for c in range(len(DF)))), F.col("i") % len(DF) + 1).alias("first"),
    ).where("score is not null")
    return _best(scored, "scheme", top_k)
