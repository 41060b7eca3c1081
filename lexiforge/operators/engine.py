"""Ranked, phrase and boolean search over a SearchIndex."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analyze import analyze_text
from ..functions.smart import byte_norm, check_scheme, df_number, df_weight, tf_number, tf_weight, unique_norm
from ..plans.parser import Node, is_boolean, is_phrase, parse, split_query
from .index import MOST_BANDS, MOST_SHARED, STATS, SearchIndex, norm_name
from .phrase import phrase_hits

#: Scores of a batch of queries that a task holds.
BATCH_SCORES = 1 << 20

RESULT = "doc_id long, score double, rank int"


@dataclass
class Plan:
    """tokens score (repeats raise the query's counts); leaves hit; phrases: key to words; where: the candidates."""

    tokens: list[str]
    phrases: dict[str, list[str]] = field(default_factory=dict)
    tree: Node | None = None
    key_of: dict[str, str | None] = field(default_factory=dict)

    @property
    def leaves(self) -> list[str]:
        return list(dict.fromkeys([*self.tokens, *(k for k in self.key_of.values() if k)]))


class SearchEngine:
    """byte_norm "reference": the b norm of documents is a constant, the query's side of it; else their bytes."""

    def __init__(self, index: SearchIndex, byte_norm: str = "documents"):
        self.index, self.byte_norm = index, byte_norm

    # ---- from the query to a plan

    def plan(self, query: str) -> Plan:
        """ValueError for a malformed boolean query or one without a positive clause."""
        config, parts = self.index.config, split_query(query)
        if is_boolean(parts):
            tree, out = parse(parts), Plan([])
            for leaf in tree.leaves():
                words = analyze_text(leaf.strip('"'), config) if is_phrase(leaf) or leaf not in "()" else []
                if is_phrase(leaf) and words:
                    out.key_of[leaf] = " ".join(words)
                    out.phrases[out.key_of[leaf]] = words
                else:  # of a word that gives several tokens the first counts; of one that gives none, nothing
                    out.key_of[leaf] = words[0] if words else None
            out.tree = tree
            return out
        out = Plan([])
        for part in parts:
            words = analyze_text(part.strip('"') if is_phrase(part) else part, config)
            if is_phrase(part) and words:
                out.phrases[" ".join(words)] = words
                out.tokens.append(" ".join(words))
            else:
                out.tokens += words
        return out

    def hits(self, plan: Plan, df: dict[str, int] | None = None, bands: list[int] | None = None) -> DataFrame:
        """(term, doc_id, tf, the document's statistics) of the plan's words and phrases, a phrase's key standing as its
        term; df: of the words, if known; bands: those of a saved index that words are looked up in, None for all."""
        single = [t for t in plan.leaves if t not in plan.phrases]
        rows = [self.index.get_tfs(*single, bands=bands)] if single else []
        rows += [phrase_hits(self.index.postings, words, df).select(F.lit(key).alias("term"), "doc_id", "tf", *STATS) for key, words in plan.phrases.items()]
        return reduce(DataFrame.unionByName, rows)

    def _df(self, words: list[str]) -> dict[str, int]:
        return {r.term: r.df for r in self.index.term_meta(*words).select("term", "df").collect()} if words else {}

    # ---- boolean queries

    def _predicate(self, plan: Plan, node: Node, hit: dict[str, Column]) -> Column:
        if node.op is None:
            key = plan.key_of[node.leaf]
            return hit[key] if key else F.lit(False)
        kids = [self._predicate(plan, k, hit) for k in node.kids]
        if node.op == "NOT":
            return ~kids[0]
        return kids[0] & kids[1] if node.op == "AND" else kids[0] | kids[1]

    def _flags(self, plan: Plan, hits: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        """One row for each document that any leaf hits, with a flag for each leaf."""
        keys = list(dict.fromkeys(k for k in plan.key_of.values() if k))
        flags = hits.groupBy("doc_id").agg(*(F.coalesce(F.max(F.col("term") == k), F.lit(False)).alias(f"h{i}") for i, k in enumerate(keys))) if keys else hits.select("doc_id").distinct()
        return flags, {k: F.col(f"h{i}") for i, k in enumerate(keys)}

    def match(self, query: str) -> DataFrame:
        """(doc_id) of all documents that satisfy a boolean query, those without any leaf included."""
        plan = self.plan(query)
        if plan.tree is None:
            raise ValueError("not a boolean query")
        keys = [k for k in plan.key_of.values() if k]
        every = self.index.documents.select("doc_id")
        if not keys:
            return every.where(self._predicate(plan, plan.tree, {}))
        flags, hit = self._flags(plan, self.hits(plan))
        full = every.join(flags, "doc_id", "left")
        return full.where(self._predicate(plan, plan.tree, {k: F.coalesce(c, F.lit(False)) for k, c in hit.items()})).select("doc_id")

    def _asks(self, plan: Plan, hit: dict[str, Column]) -> dict[tuple[int, str], Column]:
        """Of each AND and OR and each token under it an aggregate of flagged rows: whether one of the token's
        documents is in the node's set. A token's documents all have its flag, so the flagged rows suffice."""
        asked: dict[tuple[int, str], Column] = {}

        def ask(node: Node) -> None:
            if node.op in ("AND", "OR"):
                for key in {plan.key_of[x] for x in node.leaves()} - {None}:
                    asked[id(node), key] = F.coalesce(F.max(hit[key] & self._predicate(plan, node, hit)), F.lit(False))
            for k in node.kids:
                ask(k)

        ask(plan.tree)
        return asked

    def _kept(self, plan: Plan, found: dict[tuple[int, str], bool]) -> list[str]:
        """The tokens that score: at each AND and OR those without a document in the node's set go; NOT drops all
        under it. found: the answers to _asks."""

        def keep(node: Node) -> list[str]:
            if node.op is None:
                return [plan.key_of[node.leaf]] if plan.key_of[node.leaf] else []
            if node.op == "NOT":
                return []
            return [t for k in node.kids for t in keep(k) if found[id(node), t]]

        return keep(plan.tree)

    def _surviving(self, plan: Plan, flags: DataFrame, hit: dict[str, Column]) -> tuple[list[str], dict[str, int]]:
        """The tokens that score and the number of documents with each phrase; one aggregate answers all of it."""
        asked = self._asks(plan, hit)
        counts = {k: F.count(F.when(hit[k], 1)) for k in plan.phrases}
        every = [*asked.values(), *counts.values()]
        got = list(flags.agg(*(c.alias(f"a{i}") for i, c in enumerate(every))).first()) if every else []
        return self._kept(plan, dict(zip(asked, got, strict=False))), dict(zip(counts, got[len(asked) :], strict=True))

    # ---- ranking

    def prepared(self, plan: Plan) -> tuple[dict[str, int], DataFrame, Column | None]:
        """The df of the plan's words and phrases, its hits, and the predicate of a boolean query as an aggregate of a
        document's hits; the plan's tokens become those that score."""
        inside = [w for words in plan.phrases.values() for w in words]
        df = self._df(list(dict.fromkeys([*(t for t in plan.leaves if t not in plan.phrases), *inside])))
        hits = self.hits(plan, df)
        where, shown = None, {}
        if plan.tree is not None:
            flags, hit = self._flags(plan, hits)
            plan.tokens, shown = self._surviving(plan, flags, hit)
            where = self._predicate(plan, plan.tree, {k: F.coalesce(F.max(F.col("term") == k), F.lit(False)) for k in hit})
        elif plan.phrases:
            shown = {r.term: r.df for r in hits.where(F.col("term").isin(*plan.phrases)).groupBy("term").agg(F.count("*").alias("df")).collect()}
        return df | shown, hits, where  # a phrase's documents are counted where it stands

    def search(self, query: str, top_k: int | None = 10, method: str = "tfidf", scheme: str = "ltc.ltc", k1: float = 1.5, k3: float = 1.5, b: float = 0.75) -> DataFrame:
        """(doc_id, score, rank) of the best documents; ties by the query's order of terms, then doc_id.

        top_k None returns all. Words and phrases of a plain query are optional; a boolean one filters."""
        method = method.lower()
        if method not in ("tfidf", "bm25"):
            raise ValueError(f"method is tfidf or bm25, not {method!r}")
        if top_k is not None and top_k < 0:
            raise ValueError("top_k is None or at least 0")
        codes = check_scheme(scheme)
        plan, spark = self.plan(query), self.index.documents.sparkSession
        empty = spark.createDataFrame([], RESULT)
        if not plan.leaves:
            return empty
        df, hits, where = self.prepared(plan)
        if not plan.tokens:
            return empty
        rows, finish = self._bm25(plan.tokens, df, k1, k3, b) if method == "bm25" else self._smart(plan.tokens, df, *codes)
        if not rows:
            return empty
        if top_k and not plan.phrases and self.index.bounds is not None:
            limit = self._bm25_limit(k1, b) if method == "bm25" else self._smart_limit(codes[0], finish)
            if limit is not None:
                hits = self.hits(plan, df, self._promising(plan, rows, where, finish, limit, top_k))
        return top(self._scored(hits, rows, where, finish), top_k)

    def _scored(self, hits: DataFrame, rows: list[tuple[str, float, int]], where: Column | None, finish) -> DataFrame:
        """One shuffle by document: the sum of scoring terms' weights, their first in the query, and the predicate.

        All but cosine norms, which are joined to the documents found, comes from the postings themselves."""
        weight, norm = finish
        terms = [r[0] for r in rows]
        known = F.create_map(*(x for t, w, i in rows for x in (F.lit(t), F.struct(F.lit(float(w)).alias("w"), F.lit(i).alias("ord")))))
        if where is None:
            hits = hits.where(F.col("term").isin(*terms))
        at = known[F.col("term")]
        own = [c for c in norm[0] if c in STATS]
        out = hits.groupBy("doc_id").agg(F.sum(at["w"] * weight).alias("dot"), F.min(at["ord"]).alias("first"), *(F.max(c).alias(c) for c in own), *([where.alias("ok")] if where is not None else []))
        out = out.where("first is not null" + (" and ok" if where is not None else ""))
        if len(own) < len(norm[0]):
            out = out.join(self.index.doc_stats.select("doc_id", *norm[0]), "doc_id")
        return out.select("doc_id", (F.col("dot") * norm[1]).alias("score"), "first")

    # ---- bands that can't have one of the best documents are not read

    def _promising(self, plan: Plan, rows, where: Column | None, finish, limit, top_k: int) -> list[int]:
        """The bands whose bound reaches the score of the top_k-th document of the most promising few.

        A band's bound is the sum of its terms' largest weights times its largest norm; the small slack is for rounding
        and for scores that tie when rounded."""
        weight, norm = limit
        known = F.create_map(*(x for t, w, _ in rows for x in (F.lit(t), F.lit(float(w)))))
        found = self.index.bounds.where(F.col("term").isin(*(r[0] for r in rows)))
        sums = found.groupBy("band").agg(F.sum(known[F.col("term")] * weight).alias("dot"), *(F.min(f"min_{c}").alias(f"min_{c}") for c in STATS if c != "max_tf"))
        if norm[0]:
            sums = sums.join(self.index.bands.select("band", norm[0]), "band")
        bounds = sorted(((r.bound, r.band) for r in sums.select("band", (F.col("dot") * norm[1]).alias("bound")).collect()), reverse=True)  # at most MOST_BANDS
        first = max(1, math.isqrt(len(bounds)))
        among = [b for _, b in bounds]
        if first < len(bounds):
            best = top(self._scored(self.hits(plan, bands=among[:first]), rows, where, finish), top_k).agg(F.min("score").alias("least"), F.count("*").alias("n")).first()
            if best.n == top_k:
                among = [b for x, b in bounds if x >= best.least - 1e-8 - 1e-9 * abs(best.least)]
        return among

    def _bm25_limit(self, k1: float, b: float):
        """The largest weight of a band's posting of a term and the norm's; None where weights don't grow with tf and
        fall with length."""
        if k1 < 0 or not 0 <= b <= 1:
            return None
        most = F.col("max_tf")
        return most * (k1 + 1) / (most + k1 * (1 - b + b * F.col("min_length") / (self.index.stats[1] or 1.0))), (None, F.lit(1.0))

    def _smart_limit(self, doc: str, finish):
        weight = 0.5 + 0.5 * F.col("max_share") if doc[0] == "a" else tf_weight(doc[0], F.col("max_tf"), F.col("max_tf"), F.col("min_avg_tf"))
        if doc[2] == "c":
            return weight, (norm_name(doc), F.col(norm_name(doc)))
        if doc[2] == "u":
            return weight, (None, unique_norm(F.col("min_unique_terms"), self.index.stats[2]))
        if doc[2] == "b" and self.byte_norm != "reference":
            return weight, (None, byte_norm(F.col("min_byte_length")))
        return weight, (None, finish[1][1])  # a constant

    def _bm25(self, tokens: list[str], df: dict[str, int], k1: float, k3: float, b: float):
        n, avgdl, _ = self.index.stats
        rows = []
        for i, (t, q) in enumerate(Counter(tokens).items()):
            if df.get(t):
                rows.append((t, math.log(n / df[t]) * (k3 + 1) * q / (k3 + q), i))
        tf = F.col("tf")
        weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / (avgdl or 1.0)))
        return rows, (weight, ([], F.lit(1.0)))

    def _smart(self, tokens: list[str], df: dict[str, int], doc: str, query: str):
        n, _, avg_unique = self.index.stats
        counts = Counter(tokens)
        most, mean = max(counts.values()), len(tokens) / len(counts)
        rows, squares = [], 0.0
        for i, (t, q) in enumerate(counts.items()):
            if not df.get(t):
                continue
            d_idf, q_idf = df_number(doc[1], df[t], n), df_number(query[1], df[t], n)
            if d_idf <= 0 or q_idf <= 0:
                continue
            w = tf_number(query[0], q, most, mean) * q_idf
            squares += w * w
            rows.append((t, w * d_idf, i))
        size = len("".join(tokens).encode())
        q_norm = {"n": lambda: 1.0, "c": lambda: 1 / math.sqrt(squares) if squares else 1.0, "u": lambda: unique_norm(len(counts), avg_unique), "b": lambda: byte_norm(size)}[query[2]]()
        rows = [(t, w * q_norm, i) for t, w, i in rows]
        weight = tf_weight(doc[0], F.col("tf"), F.col("max_tf"), F.col("length") / F.col("unique_terms"))
        if doc[2] == "c":
            self.index = self.index.with_norms()
            norm = ([norm_name(doc)], F.col(norm_name(doc)))
        elif doc[2] == "u":
            norm = (["unique_terms"], unique_norm(F.col("unique_terms"), avg_unique))
        elif doc[2] == "b" and self.byte_norm == "reference":
            own = byte_norm({"b": size, "u": len(counts)}.get(query[2], 0))
            rows, norm = [(t, w * own, i) for t, w, i in rows], ([], F.lit(1.0))
        elif doc[2] == "b":
            norm = (["byte_length"], byte_norm(F.col("byte_length")))
        else:
            norm = ([], F.lit(1.0))
        return rows, (weight, norm)

    # ---- many queries at once

    def search_batch(self, queries: DataFrame, top_k: int = 10, query_id: str = "query_id", text: str = "text", k1: float = 1.5, k3: float = 1.5, b: float = 0.75) -> DataFrame:
        """(query_id, doc_id, score, rank): BM25 of plain queries (words only), all in one join on terms.

        Of postings only those of the queries' words are shuffled, once, by document; a document's scores for all queries
        are made in its task, of which each has about BATCH_SCORES, and no more than top_k a query leave it."""
        from ..functions.analyze import tokens

        n, avgdl, _ = self.index.stats
        asked = tokens(queries, self.index.config, query_id, text).groupBy(F.col("doc_id").alias("query_id"), "term").agg(F.count("*").alias("q"), F.min("pos").alias("ord"))
        size = asked.agg(F.count("*").alias("words"), F.countDistinct("query_id").alias("queries")).first()
        small = F.broadcast if size.words <= MOST_SHARED else lambda df: df
        words = self.index.lexicon.select("term", "df").join(small(asked), "term").select("query_id", "term", "ord", (F.log(F.lit(float(n)) / F.col("df")) * (k3 + 1) * F.col("q") / (k3 + F.col("q"))).alias("w"))
        tf = F.col("tf")
        weight = F.col("w") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / (avgdl or 1.0)))
        parts = max(int(self.index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_BANDS, n * size.queries // BATCH_SCORES))
        hits = self.index.postings.select("term", "doc_id", "tf", "length").join(small(asked.select("term").distinct()), "term", "left_semi").repartition(parts, "doc_id")
        scored = hits.join(small(words), "term").groupBy("query_id", "doc_id").agg(F.sum(weight).alias("score"), F.min("ord").alias("first"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "first", "doc_id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= top_k).select("query_id", "doc_id", "score", "rank")


def top(scored: DataFrame, k: int | None) -> DataFrame:
    """Ranks of (doc_id, score, first); scores that agree to nine places tie."""
    order = [F.desc(F.round("score", 9)), F.asc("first"), F.asc("doc_id")]
    best = scored.orderBy(*order) if k is None else scored.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int")).select("doc_id", "score", "rank")
