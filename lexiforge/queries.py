"""The registered queries, one for each operator, and the SQL of those that SQL can express.

All run over the whole tables. Stopwords and stemming are off where SQL is the yardstick."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import codecs, porter
from .functions.analyze import PLAIN, SPACES, STOPWORDS, AnalyzerConfig, line_tokens, tokens
from .functions.smart import tf_number
from .operators import metrics
from .operators.batch import CODES, search_grid, search_many
from .operators.engine import SearchEngine
from .operators.index import NORMS, SearchIndex, norm_name
from .operators.phrase import phrase_hits
from .sources.text import spread, table, text_files, text_lines

_indexes: dict[tuple, SearchIndex] = {}


def index_for(spark, sf_dir: str, config: AnalyzerConfig = PLAIN) -> SearchIndex:
    """The index of documents, whose postings are written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, config)
    if key not in _indexes:
        found: list[SearchIndex] = []
        _folder(spark, sf_dir, f"postings-{len(_indexes)}", lambda path: found.append(SearchIndex.of(table(spark, sf_dir, "documents"), config).written(path)))
        _indexes[key] = found[0]
    return _indexes[key]


def engine_for(spark, sf_dir: str, config: AnalyzerConfig = PLAIN) -> SearchEngine:
    return SearchEngine(index_for(spark, sf_dir, config))


_folders: dict[tuple, str] = {}


def _folder(spark, sf_dir: str, name: str, fill) -> str:
    """A folder that fill(path) wrote once a session: in the cluster's shared one, or of this machine where all runs
    in one process."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"{(root or 'file://' + tempfile.mkdtemp(prefix='lexiforge-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        fill(path)
        _folders[key] = path
    return _folders[key]


def _saved(spark, sf_dir: str) -> SearchIndex:
    """The index of documents, saved and opened again."""
    return SearchIndex.load(spark, _folder(spark, sf_dir, "index", lambda path: SearchIndex.of(table(spark, sf_dir, "documents"), PLAIN).save(path)), PLAIN)


def _written(spark, sf_dir: str) -> str:
    """benchmark as text files, one an item."""
    return _folder(spark, sf_dir, "texts", lambda path: table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("item_id").text(path))


# ---- SQL fragments

_URL = rf"""\b(?:https?://|ftp://|file://|mailto:|www\.)[^{SPACES}<>''"]+"""


def _words(column: str) -> str:
    clean = f"regexp_replace(regexp_replace(lower(coalesce({column}, '')), '<[^>\\r\\n]+>', ' ', 'g'), '{_URL}', ' ', 'g')"
    return f"[t FOR t IN regexp_extract_all({clean}, '[a-z0-9]+(?:-[a-z0-9]+)*') IF length(t) > 1 AND NOT regexp_full_match(t, '[0-9]+')]"


_D = f"""WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS byte_length, {_words("text")} AS ts FROM documents),
tok AS (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM d),
p AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
lex AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term),
st AS (SELECT d.doc_id, len(d.ts) AS length, coalesce(max(p.tf), 0) AS max_tf, count(p.tf) AS unique_terms,
         CASE WHEN count(p.tf) > 0 THEN len(d.ts) / count(p.tf)::DOUBLE ELSE 0 END AS avg_tf, d.byte_length
       FROM d LEFT JOIN p ON d.doc_id = p.doc_id GROUP BY d.doc_id, d.ts, d.byte_length),
cs AS (SELECT count(*)::DOUBLE AS n, avg(length) AS avgdl, avg(unique_terms) AS avg_unique FROM st)"""

_TF = {"n": "tf", "l": "(1 + log10(tf))", "a": "(0.5 + 0.5 * tf / max_tf)", "b": "1.0", "L": "((1 + log10(tf)) / (1 + log10(avg_tf)))"}
_DF = {"n": "1.0::DOUBLE", "t": "log10(n / df)", "p": "greatest(0, CASE WHEN df < n THEN log10((n - df) / df) ELSE 0 END)"}


def _phrase(words: str, name: str) -> str:
    """CTE of a phrase's pseudo-term."""
    each = words.split()
    joins = " ".join(f"JOIN tok t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{w}'" for i, w in enumerate(each) if i)
    return f"{name} AS (SELECT '{words}' AS term, t0.doc_id, count(*) AS tf FROM tok t0 {joins} WHERE t0.term = '{each[0]}' GROUP BY t0.doc_id)"


def _ranked(terms: list[str], doc_weight: str, norm: str, query_weight: dict[str, str], where: str = "true", phrases: dict[str, str] | None = None, leaves: list[str] = (), k: int = 20) -> str:
    """SQL of a ranking. terms score; leaves, if any, hit in the predicate where."""
    extra = "".join(f", {_phrase(w, name)}" for name, w in (phrases or {}).items())
    source = "(SELECT * FROM p" + "".join(f" UNION ALL SELECT * FROM {name}" for name in phrases or {}) + ")"
    every = list(dict.fromkeys([*terms, *leaves]))
    values = ", ".join(f"('{t}', {query_weight.get(t, '1.0')}, {i})" for i, t in enumerate(terms))
    hits = ", ".join(f"bool_or(term = '{t}') AS h{i}" for i, t in enumerate(every))
    return f"""{_D}{extra}, hit AS (SELECT * FROM {source} WHERE term IN ({", ".join(f"'{t}'" for t in every)})),
dfs AS (SELECT term, count(*)::DOUBLE AS df FROM hit GROUP BY term), q(term, qw, ord) AS (VALUES {values}),
s AS (SELECT hit.doc_id, sum(qw * {doc_weight}) * any_value({norm}) AS score, min(ord) AS first, {hits}
      FROM hit JOIN dfs USING (term) JOIN st USING (doc_id) CROSS JOIN cs LEFT JOIN q USING (term) GROUP BY hit.doc_id)
SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, first, doc_id)::INT AS rank
FROM s WHERE first IS NOT NULL AND {where} ORDER BY rank LIMIT {k}"""


_BM25 = "ln(n / df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))"
_QTF1 = "1.0"


def _scores(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _search(query: str, **kw):
    return lambda spark, sf: _scores(engine_for(spark, sf).search(query, top_k=20, **kw))


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


# ---- text analysis

_COUNTS = "count(*) AS tokens, count(DISTINCT term) AS terms, sum(length(term))::BIGINT AS chars"


def _token_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.countDistinct("term").alias("terms"), F.sum(F.length("term")).alias("chars"), F.sum(F.crc32(F.col("term").cast("binary")) * (F.col("pos") % 7 + 1)).alias("mark"))


def _tok(config: AnalyzerConfig):
    return lambda spark, sf: _token_counts(tokens(spread(table(spark, sf, "documents")), config)).drop("mark")


_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)
_register("tok_documents", _tok(PLAIN), f"{_D} SELECT doc_id, {_COUNTS} FROM tok GROUP BY doc_id")
_register("tok_stopwords", _tok(AnalyzerConfig(stem=False)), f"{_D} SELECT doc_id, {_COUNTS} FROM tok WHERE term NOT IN ({_STOPS}) GROUP BY doc_id")


def _stem(word: str) -> str:
    """SQL of a word's stem: the stemmer's replacements one in the other."""
    out = word
    for pattern, new in porter.RULES:
        out = f"regexp_replace({out}, '{pattern}', '{re.sub(r'[$]([0-9])', lambda m: chr(92) + m[1], new)}', 'g')"
    own = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in porter.IRREGULAR.items())
    return f"CASE WHEN length({word}) <= 2 THEN {word} ELSE CASE {word} {own} ELSE replace({out}, 'Y', 'y') END END"


_NO_STOPS = _D.replace(_words("text"), f"[t FOR t IN {_words('text')} IF t NOT IN ({_STOPS})]")
# under the default configuration: stopwords out, each distinct word stemmed once
_DEFAULT = _NO_STOPS.replace("tok AS (", "raw AS (", 1).replace(
    ",\np AS", f",\nsw AS MATERIALIZED (SELECT word, {_stem('word')} AS stem FROM (SELECT DISTINCT term AS word FROM raw)),\ntok AS (SELECT doc_id, stem AS term, pos FROM raw JOIN sw ON raw.term = sw.word),\np AS", 1
)
_register("tok_stemmed", _tok(AnalyzerConfig()), f"{_DEFAULT} SELECT doc_id, {_COUNTS} FROM tok GROUP BY doc_id")
_register("stem_terms", lambda spark, sf: index_for(spark, sf).lexicon.select("term", porter.stem_column(F.col("term")).alias("stem")), f"{_D} SELECT term, {_stem('term')} AS stem FROM lex")
_register(
    "tok_pages_html_url",
    lambda spark, sf: tokens(spread(table(spark, sf, "pages")), PLAIN, "page_id", "html").select(F.col("doc_id").alias("page_id"), F.col("pos").cast("long").alias("pos"), "term"),
    f"WITH d AS (SELECT page_id, {_words('html')} AS ts FROM pages) SELECT page_id, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS term FROM d",
)
_ODD = " a 4k 2-3 x-1 77 AI-driven http://a.b/c\u00a0nextword www.x.y\u3000otherword "
_register(
    "tok_drop_digits_short",
    lambda spark, sf: tokens(spread(table(spark, sf, "documents")).select("doc_id", F.concat_ws(_ODD, F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")), "source").alias("text")), PLAIN).groupBy("term").agg(F.count("*").alias("n")),
    f"WITH e AS (SELECT concat_ws('{_ODD}', doc_id::VARCHAR, coalesce(text, ''), source) AS x FROM documents), d AS (SELECT unnest({_words('x')}) AS term FROM e) SELECT term, count(*) AS n FROM d GROUP BY term",
)
_register(
    "src_text_files",
    lambda spark, sf: text_files(spark, _written(spark, sf)).select("doc_id", F.regexp_extract("key", r"item_id=(\d+)/", 1).cast("long").alias("item_id"), "text"),
    "SELECT row_number() OVER (ORDER BY 'item_id=' || item_id || '/') - 1 AS doc_id, item_id, coalesce(text, '') || chr(10) AS text FROM benchmark",
)

_register(
    "src_line_tokens",
    lambda spark, sf: line_tokens(text_lines(spark, _written(spark, sf)), PLAIN, keep=("key",)).select(F.regexp_extract("key", r"item_id=(\d+)/", 1).cast("long").alias("item_id"), F.col("pos").cast("long").alias("pos"), "term"),
    f"WITH d AS (SELECT item_id, {_words('text')} AS ts FROM benchmark) SELECT item_id, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS term FROM d",
)

# ---- index

_register("idx_postings_tf", lambda spark, sf: index_for(spark, sf).postings.select("term", "doc_id", F.col("tf").cast("long").alias("tf")), f"{_D} SELECT term, doc_id, tf FROM p")
_register(
    "idx_postings_positions",
    lambda spark, sf: index_for(spark, sf).postings.select("term", "doc_id", F.array_join(F.transform("positions", lambda x: x.cast("string")), " ").alias("positions")),
    f"{_D} SELECT term, doc_id, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM tok GROUP BY ALL",
)
_register("idx_lexicon_df", lambda spark, sf: index_for(spark, sf).lexicon.select("term", "df", "cf"), f"{_D} SELECT term, df, cf FROM lex")
_STATS = ["doc_id", "length", "max_tf", "unique_terms", "avg_tf", "byte_length"]
_register(
    "idx_doc_stats",
    lambda spark, sf: index_for(spark, sf).doc_stats.select("doc_id", "length", F.col("max_tf").cast("long").alias("max_tf"), "unique_terms", F.round("avg_tf", 6).alias("avg_tf"), "byte_length"),
    f"{_D} SELECT doc_id, length, max_tf, unique_terms, round(avg_tf, 6) AS avg_tf, byte_length::BIGINT AS byte_length FROM st",
)
_register(
    "idx_corpus_stats",
    lambda spark, sf: index_for(spark, sf).corpus_stats.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("avg_unique", 6).alias("avg_unique")),
    f"{_D} SELECT n::BIGINT AS n, round(avgdl, 6) AS avgdl, round(avg_unique, 6) AS avg_unique FROM cs",
)
_SUMS = ", ".join(f"round(1 / sqrt(coalesce(sum(pow({_TF[c[0]]} * {_DF[c[1]]}, 2)) FILTER (WHERE df < n), 0) + 1e-12), 5) AS {norm_name(c)}" for c in NORMS)
_register(
    "idx_cosine_norms_15",
    lambda spark, sf: index_for(spark, sf).with_norms().doc_stats.select("doc_id", *(F.round(c, 5).alias(c) for c in map(norm_name, NORMS))),
    f"{_D} SELECT st.doc_id, {_SUMS} FROM st CROSS JOIN cs LEFT JOIN p ON p.doc_id = st.doc_id LEFT JOIN lex USING (term) GROUP BY st.doc_id",
)
_register("doc_keys", lambda spark, sf: index_for(spark, sf).keys(), "SELECT doc_id, doc_id::VARCHAR AS key FROM documents")

# ---- a saved index

_register("saved_postings", lambda spark, sf: _saved(spark, sf).postings.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.array_join(F.transform("positions", lambda x: x.cast("string")), " ").alias("positions")), f"{_D} SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM tok GROUP BY ALL")
_register("saved_lexicon", lambda spark, sf: _saved(spark, sf).lexicon.select("term", "df", "cf"), ORACLE["idx_lexicon_df"])
_register("saved_cosine_norms", lambda spark, sf: _saved(spark, sf).doc_stats.select("doc_id", *(F.round(c, 5).alias(c) for c in map(norm_name, NORMS))), ORACLE["idx_cosine_norms_15"])
_register("saved_corpus_stats", lambda spark, sf: _saved(spark, sf).corpus_stats.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("avg_unique", 6).alias("avg_unique")), ORACLE["idx_corpus_stats"])

# ---- two indexes merged


_merges: dict[tuple, SearchIndex] = {}


def _merged(spark, sf: str) -> SearchIndex:
    """The index of the documents with even ids merged with that of all others; its postings are written once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _merges:
        docs, even = table(spark, sf, "documents"), F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))

        def fill(path: str) -> None:
            # a merge reads postings and documents alone, so no part needs an order, norms or bounds
            parts = [SearchIndex.of(docs.where(some), PLAIN).written(f"{path}/{name}") for some, name in ((even, "even"), (~even, "odd"))]
            _merges[key] = parts[0].merge(parts[1]).written(f"{path}/both")
            for part in parts:
                part.close()

        _folder(spark, sf, "merged", fill)
    return _merges[key]


_register("merged_postings", lambda spark, sf: _merged(spark, sf).postings.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.array_join(F.transform("positions", lambda x: x.cast("string")), " ").alias("positions")), ORACLE["saved_postings"])
_register("merged_lexicon", lambda spark, sf: _merged(spark, sf).lexicon.select("term", "df", "cf"), ORACLE["idx_lexicon_df"])
_register("merged_doc_stats", lambda spark, sf: _merged(spark, sf).doc_stats.select("doc_id", "length", F.col("max_tf").cast("long").alias("max_tf"), "unique_terms", F.round("avg_tf", 6).alias("avg_tf"), "byte_length"), ORACLE["idx_doc_stats"])
_register("merged_cosine_norms", lambda spark, sf: _merged(spark, sf).with_norms().doc_stats.select("doc_id", *(F.round(c, 5).alias(c) for c in map(norm_name, NORMS))), ORACLE["idx_cosine_norms_15"])

# ---- access

_register("doc_ids", lambda spark, sf: index_for(spark, sf).ids("3", "5", "no such key"), "SELECT doc_id, doc_id::VARCHAR AS key FROM documents WHERE doc_id IN (3, 5)")
_register("acc_term_meta", lambda spark, sf: index_for(spark, sf).term_meta("worthless", "anst", "no-such-term"), f"{_D} SELECT term, df, cf FROM lex WHERE term IN ('worthless', 'anst')")
_register(
    "acc_postings",
    lambda spark, sf: index_for(spark, sf).get_postings("worthless", "anst").select("term", "doc_id", F.array_join(F.transform("positions", lambda x: x.cast("string")), " ").alias("positions")),
    f"{_D} SELECT term, doc_id, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM tok WHERE term IN ('worthless', 'anst') GROUP BY ALL",
)
_register("acc_tfs", lambda spark, sf: index_for(spark, sf).get_tfs("tion", "the").select("term", "doc_id", F.col("tf").cast("long").alias("tf")), f"{_D} SELECT term, doc_id, tf FROM p WHERE term IN ('tion', 'the')")
_register("acc_prefix_limit", lambda spark, sf: index_for(spark, sf).prefix("tio", 50), f"{_D} SELECT term, df, cf FROM lex WHERE starts_with(term, 'tio') ORDER BY term LIMIT 50")

# ---- boolean queries


def _boolean(name: str, query: str, terms: list[str], where: str, leaves: list[str] = (), phrases: dict[str, str] | None = None) -> None:
    _register(name, _search(query, method="bm25"), _ranked(terms, _BM25, _QTF1, {}, where, phrases, leaves))


_boolean("bool_and", "worthless AND anst", ["worthless", "anst"], "h0 AND h1")
_boolean("bool_or", "worthless OR anst", ["worthless", "anst"], "(h0 OR h1)")
_boolean("bool_and_not", "anst AND NOT tion", ["anst"], "h0 AND NOT h1", ["tion"])
_boolean("bool_or_not", "worthless OR NOT the", ["worthless"], "(h0 OR NOT h1)", ["the"])
_boolean("bool_nested_parens", "(worthless OR anst) AND NOT (tion AND the)", ["worthless", "anst"], "(h0 OR h1) AND NOT (h2 AND h3)", ["tion", "the"])
_boolean("bool_implicit_and", "worthless tion AND the", ["worthless", "tion", "the"], "h0 AND h1 AND h2")
_boolean("bool_precedence", "worthless OR anst AND tion", ["worthless", "anst", "tion"], "(h0 OR (h1 AND h2))")
# the stopword's clause is empty, so only the other word's documents are left
_register(
    "bool_stopword_leaf",
    lambda spark, sf: _scores(engine_for(spark, sf, AnalyzerConfig(stem=False)).search("(the AND worthless) OR anst", top_k=20, method="bm25")),
    _ranked(["anst"], _BM25, _QTF1, {}).replace(_D, _NO_STOPS, 1),
)
_register(
    "bool_match_not",
    lambda spark, sf: engine_for(spark, sf).match("NOT (the OR tion) OR worthless"),
    f"{_D} SELECT doc_id FROM st WHERE doc_id NOT IN (SELECT doc_id FROM p WHERE term IN ('the', 'tion')) OR doc_id IN (SELECT doc_id FROM p WHERE term = 'worthless')",
)

# the first clause holds for no document, so its word is pruned and doesn't score
_boolean("bool_pruned_token", "(worthless AND NOT worthless) OR anst", ["anst"], "((h1 AND NOT h1) OR h0)", ["worthless"])

# ---- phrases


def _phrase_query(name: str, words: str) -> None:
    _register(name, lambda spark, sf: phrase_hits(index_for(spark, sf).postings, words.split()).select("doc_id", F.col("tf").cast("long").alias("tf")), f"{_D}, {_phrase(words, 'x')} SELECT doc_id, tf FROM x")


_phrase_query("phrase_2", "anea eriner")
_phrase_query("phrase_3", "anea eriner thanea")
_phrase_query("phrase_repeated_term", "the the")
_boolean("phrase_and_term", '"anea eriner" AND the', ["anea eriner", "the"], "h0 AND h1", phrases={"x": "anea eriner"})
_register("phrase_plain_mix", _search('"anea eriner" worthless', method="bm25"), _ranked(["anea eriner", "worthless"], _BM25, _QTF1, {}, phrases={"x": "anea eriner"}))

# ---- ranking

_register("bm25_terms", _search("worthless anst", method="bm25"), _ranked(["worthless", "anst"], _BM25, _QTF1, {}))
_register("bm25_qtf", _search("worthless anst anst anst", method="bm25"), _ranked(["worthless", "anst"], _BM25, _QTF1, {"anst": "2.5 * 3 / (1.5 + 3)"}))
_register("bm25_all_terms", _search("the worthless unseenword", method="bm25"), _ranked(["the", "worthless"], _BM25, _QTF1, {}))


def _smart(scheme: str, words: list[str] = ("worthless", "tion"), name: str = "smart", query: str = "", where: str = "true", phrases: dict[str, str] | None = None) -> None:
    """words under scheme, in SQL; a word may come more than once. query: what is asked, if not just the words; where
    and phrases: those of a boolean one (with no cosine norm, which only words have)."""
    doc, ask = scheme[:3], scheme[4:]
    counts = Counter(words)
    terms = list(counts)
    asked = {t: repr(float(tf_number(ask[0], c, max(counts.values()), len(words) / len(terms)))) for t, c in counts.items()}
    q_tf = "CASE term " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in asked.items()) + " END"
    q_idf = _DF[ask[1]]
    norm = {"n": "1.0", "c": None, "u": "CASE WHEN unique_terms > 0 THEN 1 / (0.8 + 0.2 * unique_terms / avg_unique) ELSE 1 END", "b": "CASE WHEN byte_length > 0 THEN 1 / sqrt(byte_length) ELSE 1 END"}[doc[2]]
    if norm is None:
        norm = "nn.w"
    among = ", ".join(f"'{t}'" for t in terms)
    q_norm = {
        "n": "1.0",
        "c": f"(SELECT 1 / sqrt(sum(pow({q_tf} * {q_idf}, 2))) FROM lex CROSS JOIN cs WHERE term IN ({among}) AND {q_idf} > 0 AND {_DF[doc[1]]} > 0)",
        "u": f"(SELECT 1 / (0.8 + 0.2 * {len(terms)} / avg_unique) FROM cs)",
        "b": f"{len(''.join(words).encode()) ** -0.5!r}",
    }[ask[2]]
    sql = _ranked(terms, f"{q_idf} * {_DF[doc[1]]} * {_TF[doc[0]]}", norm, asked, where, phrases, k=20)
    if doc[2] == "c":
        nn = f", nn AS (SELECT p.doc_id, 1 / sqrt(sum(pow({_TF[doc[0]]} * {_DF[doc[1]]}, 2)) FILTER (WHERE df < n) + 1e-12) AS w FROM p JOIN lex USING (term) JOIN st USING (doc_id) CROSS JOIN cs GROUP BY p.doc_id)"
        sql = sql.replace(_D, _D + nn, 1).replace("JOIN st USING (doc_id) CROSS JOIN cs LEFT JOIN q", "JOIN st USING (doc_id) JOIN nn USING (doc_id) CROSS JOIN cs LEFT JOIN q")
    sql = sql.replace("SELECT doc_id, round(score, 6)", f"SELECT doc_id, round(score * {q_norm}, 6)").replace("ORDER BY round(score, 9) DESC", f"ORDER BY round(score * {q_norm}, 9) DESC")
    if where == "true" and ("t" in (doc[1], ask[1]) or "p" in (doc[1], ask[1])):
        ok = " AND ".join(f"{_DF[x]} > 0" for x in {doc[1], ask[1]} - {"n"})
        sql = sql.replace("LEFT JOIN q USING (term) GROUP BY", f"LEFT JOIN q USING (term) WHERE {ok} GROUP BY")
    _register(f"{name}_" + scheme.replace(".", "_"), _search(query or " ".join(words), scheme=scheme), sql)


for _scheme in ("ltc.ltc", "nnn.nnn", "lnn.nnn", "ann.nnn", "bnn.nnn", "Lnn.nnn", "ntn.nnn", "npn.nnn", "nnu.nnn", "nnb.nnn", "nnc.nnn", "ntu.Lpc", "Lpc.ltb", "apb.btu", "bnc.apn"):
    _smart(_scheme)
for _scheme in ("nnn.nnn", "ltc.ltc", "lnn.ann", "nnb.bnb", "Ltu.Ltu", "apn.lpc"):
    _smart(_scheme, ["worthless", "tion", "tion", "tion", "anst", "anst"], "smart_repeated")
_smart("ltu.ltn", ["anea eriner", "the", "worthless"], "smart_boolean_phrase", '"anea eriner" AND (the OR worthless)', "h0 AND (h1 OR h2)", {"x": "anea eriner"})
# a word that stands in two clauses counts twice
_smart("nnb.nnn", ["tion", "anst", "tion"], "smart_boolean", "(tion OR anst) AND tion", "(h0 OR h1) AND h0")

# ---- a saved index's bands: those that can't have one of the best documents are not read


def _from_bands(query: str, **kw):
    return lambda spark, sf: _scores(SearchEngine(_saved(spark, sf)).search(query, top_k=20, **kw))


_register("saved_top_bm25", _from_bands("worthless anst", method="bm25"), ORACLE["bm25_terms"])
_register("saved_top_boolean", _from_bands("(worthless OR anst) AND NOT (tion AND the)", method="bm25"), ORACLE["bool_nested_parens"])
_register("saved_phrase_and_term", _from_bands('"anea eriner" AND the', method="bm25"), ORACLE["phrase_and_term"])
for _scheme in ("ltc.ltc", "Lpc.ltb", "apb.btu", "ntu.Lpc"):
    _register("saved_top_" + _scheme.replace(".", "_"), _from_bands("worthless tion", scheme=_scheme), ORACLE["smart_" + _scheme.replace(".", "_")])

# ---- the default configuration


def _default(name: str, query: str, terms: list[str], where: str = "true", leaves: list[str] = (), phrases: dict[str, str] | None = None) -> None:
    """terms, leaves and phrases: stems."""
    search = lambda spark, sf: _scores(engine_for(spark, sf, AnalyzerConfig()).search(query, top_k=20, method="bm25"))
    _register(name, search, _ranked(terms, _BM25, _QTF1, {}, where, phrases, leaves).replace(_D, _DEFAULT, 1))


_default("default_bm25", "the worthlessness of ansts", ["worthless", "anst"])
_default("default_boolean", "(worthless OR ansts) AND NOT tions", ["worthless", "anst"], "(h0 OR h1) AND NOT h2", ["tion"])

# ---- many queries in one plan, all weightings in one plan

# Pairs of words, combined in ten ways: forty queries. p0 and p1 are the phrases.
_PAIRS = [("worthless", "anst"), ("tion", "the"), ("anea", "eriner"), ("anst", "thanea")]
_WAYS: list[tuple[str, list[int], list[int], str]] = [  # the query, what scores (2: the phrase), what else is asked, predicate
    ("{a} {b}", [0, 1], [], "true"),
    ("{a} AND {b}", [0, 1], [], "h0 AND h1"),
    ("{a} OR {b}", [0, 1], [], "h0 OR h1"),
    ("{a} AND NOT {b}", [0], [1], "h0 AND NOT h1"),
    ("{b} OR NOT {a}", [1], [0], "h1 OR NOT h0"),
    ('"anea eriner" OR {a}', [2, 0], [], "h2 OR h0"),
    ('{b} AND NOT "anea eriner"', [1], [2], "h1 AND NOT h2"),
    ('"anea eriner" {b}', [2, 1], [], "true"),
    ("({a} OR {b}) AND NOT ({a} AND {b})", [0, 1], [], "(h0 OR h1) AND NOT (h0 AND h1)"),
    ("{a} unseenword OR {b}", [1], [0], "h1"),
]
_MANY = {10 * i + j: way[0].format(a=a, b=b) for i, (a, b) in enumerate(_PAIRS) for j, way in enumerate(_WAYS)}


def _many_sql() -> str:
    """The forty queries as rows (query_id, place in the query, what it is, term, weight); a token scores only where
    some document has it and satisfies the query, which holds for all these."""
    rows, tests = [], []
    for i, pair in enumerate(_PAIRS):
        for j, (_, scoring, asked, where) in enumerate(_WAYS):
            for place, leaf in enumerate([*scoring, *asked]):
                rows.append(f"({10 * i + j}, {place if leaf in scoring else 'NULL'}, {leaf}, '{'anea eriner' if leaf == 2 else pair[leaf]}')")
            tests.append(f"WHEN {10 * i + j} THEN {where}")
    flags = ", ".join(f"bool_or(leaf = {x}) AS h{x}" for x in range(3))
    return f"""{_D}, {_phrase("anea eriner", "x")}, q(query_id, ord, leaf, term) AS (VALUES {", ".join(rows)}),
hit AS (SELECT * FROM p UNION ALL SELECT * FROM x), dfs AS (SELECT term, count(*)::DOUBLE AS df FROM hit GROUP BY term),
s AS (SELECT query_id, hit.doc_id, sum(CASE WHEN ord IS NOT NULL THEN {_BM25} END) AS score, min(ord) AS first, {flags}
      FROM hit JOIN q USING (term) JOIN dfs USING (term) JOIN st USING (doc_id) CROSS JOIN cs GROUP BY ALL)
SELECT query_id::BIGINT AS query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, doc_id)::INT AS rank
FROM s WHERE first IS NOT NULL AND CASE query_id {" ".join(tests)} END QUALIFY rank <= 10"""


_register("search_many_mixed", lambda spark, sf: _scores(search_many(engine_for(spark, sf), _MANY, top_k=10)), _many_sql())


def _grid_sql(words: list[str]) -> str:
    counts = Counter(words)
    asked = {c: "CASE term " + " ".join(f"WHEN '{t}' THEN {float(tf_number(c, k, max(counts.values()), len(words) / len(counts)))!r}" for t, k in counts.items()) + " END" for c in "nlabL"}
    case = lambda of, by: f"CASE {of} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in by.items()) + " END"
    terms = ", ".join(f"('{t}', {i})" for i, t in enumerate(counts))
    codes = ", ".join(f"('{c[0]}', '{c[1]}')" for c in CODES)
    d_norm = case("m", {"n": "1.0", "c": "nn.w", "u": "1 / (0.8 + 0.2 * unique_terms / avg_unique)", "b": "1 / sqrt(byte_length)"})
    q_norm = case("o", {"n": "1.0", "c": "qq.w", "u": f"1 / (0.8 + 0.2 * {len(counts)} / avg_unique)", "b": repr(len("".join(words).encode()) ** -0.5)})
    return f"""{_D}, q(term, ord) AS (VALUES {terms}), dc(a, b) AS (VALUES {codes}), e(x, y) AS (VALUES {codes}), m(m) AS (VALUES ('n'), ('c'), ('u'), ('b')), o(o) AS (VALUES ('n'), ('c'), ('u'), ('b')),
wq AS (SELECT term, b, x, y, {case("x", asked)} * {case("y", _DF)} AS w, {case("b", _DF)} AS idf FROM lex JOIN q USING (term) CROSS JOIN e CROSS JOIN (SELECT DISTINCT b FROM dc) CROSS JOIN cs WHERE {case("y", _DF)} > 0 AND {case("b", _DF)} > 0),
qq AS (SELECT b, x, y, 1 / sqrt(sum(w * w)) AS w FROM wq GROUP BY ALL),
nn AS (SELECT p.doc_id, a, b, 1 / sqrt(coalesce(sum(pow({case("a", _TF)} * {case("b", _DF)}, 2)) FILTER (WHERE df < n), 0) + 1e-12) AS w FROM p JOIN lex USING (term) JOIN st USING (doc_id) CROSS JOIN cs CROSS JOIN dc GROUP BY ALL),
dots AS (SELECT p.doc_id, a, dc.b, x, y, sum({case("a", _TF)} * idf * wq.w) AS dot, min(ord) AS first FROM p JOIN q USING (term) JOIN st USING (doc_id) CROSS JOIN dc JOIN wq ON wq.term = p.term AND wq.b = dc.b GROUP BY ALL),
s AS (SELECT a || b || m || '.' || x || y || o AS scheme, doc_id, first, dot * {d_norm} * {q_norm} AS score FROM dots JOIN nn USING (doc_id, a, b) JOIN qq USING (b, x, y) JOIN st USING (doc_id) CROSS JOIN cs CROSS JOIN m CROSS JOIN o)
SELECT scheme, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY scheme ORDER BY round(score, 9) DESC, first, doc_id)::INT AS rank FROM s QUALIFY rank <= 5"""


_GRID = ["worthless", "anst", "anst"]
_register("smart_grid_3600", lambda spark, sf: _scores(search_grid(engine_for(spark, sf), " ".join(_GRID), top_k=5)), _grid_sql(_GRID))

# ---- batches and evaluation


def _runs(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark texts' rankings, and as their relevant documents those of good quality and small id distance."""
    index = index_for(spark, sf)
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text"))
    run = SearchEngine(index).search_batch(queries, top_k=20)
    qrels = table(spark, sf, "labels").where("quality = 1").select((F.col("doc_id") % 40).alias("query_id"), "doc_id")
    return run.select("query_id", "doc_id", "rank"), qrels


_RUN = f"""{_D}, qw AS (SELECT item_id AS query_id, {_words("text")} AS ts FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS q, min(pos) AS ord FROM (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM qw) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, sum(2.5 * q / (1.5 + q) * {_BM25}) AS score, min(ord) AS first
       FROM qt JOIN lex USING (term) JOIN p USING (term) JOIN st USING (doc_id) CROSS JOIN cs GROUP BY ALL),
run AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, doc_id)::INT AS rank FROM sc QUALIFY rank <= 20),
qrels AS (SELECT DISTINCT doc_id % 40 AS query_id, doc_id FROM labels WHERE quality = 1),
tot AS (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY query_id),
j AS (SELECT run.query_id, rank, (qrels.doc_id IS NOT NULL)::INT AS rel, coalesce(n_rel, 0) AS n_rel,
      sum((qrels.doc_id IS NOT NULL)::INT) OVER (PARTITION BY run.query_id ORDER BY rank) AS seen
      FROM run LEFT JOIN qrels ON run.query_id = qrels.query_id AND run.doc_id = qrels.doc_id LEFT JOIN tot ON tot.query_id = run.query_id)"""


def _batch(spark, sf: str) -> DataFrame:
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text"))
    return _scores(engine_for(spark, sf).search_batch(queries, top_k=20))


_register("search_top_k_batch", _batch, f"{_RUN} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM run")


def _metric(name: str, f, sql: str, per_query: bool = True) -> None:
    _register(name, lambda spark, sf: f(*_runs(spark, sf)).withColumn("value", F.round("value", 6)), f"{_RUN} SELECT {'query_id, ' if per_query else ''}round({sql}, 6) AS value FROM j {'GROUP BY query_id' if per_query else ''}")


_REL = "CASE WHEN any_value(n_rel) > 0 THEN {} / any_value(n_rel) ELSE 0 END"
_IDEAL = "(SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + least(10, any_value(n_rel))) r(i))"
_AP = _REL.format("sum(rel * seen / rank::DOUBLE)")
_RR = "coalesce(1.0 / min(rank) FILTER (WHERE rel = 1), 0)"
_metric("eval_p_at_k", lambda r, q: metrics.precision_at_k(r, q, 10), "sum(rel) FILTER (WHERE rank <= 10) / 10.0")
_metric("eval_recall_at_k", lambda r, q: metrics.recall_at_k(r, q, 10), _REL.format("(sum(rel) FILTER (WHERE rank <= 10))::DOUBLE"))
_metric("eval_dcg", lambda r, q: metrics.dcg_at_k(r, q, 10), "coalesce(sum(rel / log2(rank + 1)) FILTER (WHERE rank <= 10), 0)")
_metric("eval_ndcg", lambda r, q: metrics.ndcg_at_k(r, q, 10), f"CASE WHEN any_value(n_rel) > 0 THEN (sum(rel / log2(rank + 1)) FILTER (WHERE rank <= 10)) / {_IDEAL} ELSE 0 END")
_metric("eval_ap", metrics.average_precision, _AP)
_metric("eval_rr", metrics.reciprocal_rank, _RR)
_register("eval_map", lambda spark, sf: metrics.mean_average_precision(*_runs(spark, sf)).withColumn("value", F.round("value", 6)), f"{_RUN} SELECT round(avg(v), 6) AS value FROM (SELECT {_AP} AS v FROM j GROUP BY query_id)")
_register("eval_mrr", lambda spark, sf: metrics.mean_reciprocal_rank(*_runs(spark, sf)).withColumn("value", F.round("value", 6)), f"{_RUN} SELECT round(avg(v), 6) AS value FROM (SELECT {_RR} AS v FROM j GROUP BY query_id)")

# ---- codecs

_joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


BLOCK = 1 << 16  # doc_ids in a block


def _blocks(spark, sf: str) -> DataFrame:
    """Postings by term and range of doc_id, in order of doc_id."""
    rows = index_for(spark, sf).postings.groupBy("term", codecs.block_of(F.col("doc_id"), BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "positions"))).alias("rows"))
    return rows.select("term", "block", F.col("rows.doc_id").alias("docs"), F.col("rows.positions").alias("positions"))


def _doc_lists(spark, sf: str) -> DataFrame:
    return _blocks(spark, sf).select("term", "docs")


_LISTS = f"{_D}, l AS (SELECT term, list(doc_id ORDER BY doc_id) AS docs FROM p GROUP BY term, doc_id // {BLOCK})"
_GAPS = "[docs[i] - CASE WHEN i > 1 THEN docs[i - 1] ELSE 0 END FOR i IN range(1, len(docs) + 1)]"
_register("codec_delta_encode", lambda spark, sf: _doc_lists(spark, sf).select("term", _joined(codecs.delta_encode(F.col("docs"))).alias("gaps")), f"{_LISTS} SELECT term, array_to_string({_GAPS}, ' ') AS gaps FROM l")
_register("codec_delta_decode", lambda spark, sf: _doc_lists(spark, sf).select("term", _joined(codecs.delta_decode(codecs.delta_encode(F.col("docs")))).alias("docs")), f"{_LISTS} SELECT term, array_to_string(docs, ' ') AS docs FROM l")
_register(
    "codec_position_gaps",
    lambda spark, sf: index_for(spark, sf).postings.select("term", "doc_id", _joined(codecs.delta_encode(F.col("positions"))).alias("gaps")),
    f"{_D}, g AS (SELECT term, doc_id, pos, pos - coalesce(lag(pos) OVER (PARTITION BY term, doc_id ORDER BY pos), 0) AS gap FROM tok) SELECT term, doc_id, string_agg(gap::VARCHAR, ' ' ORDER BY pos) AS gaps FROM g GROUP BY ALL",
)
_register("codec_vbyte_roundtrip", lambda spark, sf: index_for(spark, sf).postings.select("term", "doc_id", _joined(codecs.vbyte_decode(codecs.vbyte_encode(F.col("positions")))).alias("positions")), f"{_D} SELECT term, doc_id, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM tok GROUP BY ALL")

_VBYTE = "array_to_string([CASE WHEN x < 128 THEN printf('%02X', x) WHEN x < 16384 THEN printf('%02X%02X', x & 127 | 128, x >> 7) WHEN x < 2097152 THEN printf('%02X%02X%02X', x & 127 | 128, x >> 7 & 127 | 128, x >> 14) ELSE printf('%02X%02X%02X%02X', x & 127 | 128, x >> 7 & 127 | 128, x >> 14 & 127 | 128, x >> 21) END FOR x IN {}], '')"
_register(
    "codec_vbyte_bytes",
    lambda spark, sf: index_for(spark, sf).postings.select("term", "doc_id", F.hex(codecs.vbyte_encode(F.transform("positions", lambda x: x * 50))).alias("bytes")),
    f"{_D}, l AS (SELECT term, doc_id, list((pos * 50)::BIGINT ORDER BY pos) AS xs FROM tok GROUP BY ALL) SELECT term, doc_id, {_VBYTE.format('xs')} AS bytes FROM l",
)
_PLACES = f"""{_D}, g AS (SELECT term, doc_id, count(*) AS tf, list((pos)::BIGINT ORDER BY pos) AS ps FROM tok GROUP BY ALL),
b AS (SELECT term, doc_id // {BLOCK} AS block, list(doc_id ORDER BY doc_id) AS docs, list(tf ORDER BY doc_id) AS tfs,
      list([ps[i] - CASE WHEN i > 1 THEN ps[i - 1] ELSE 0 END FOR i IN range(1, len(ps) + 1)] ORDER BY doc_id) AS gaps FROM g GROUP BY ALL)"""
_register(
    "codec_block_bytes",
    lambda spark, sf: _blocks(spark, sf).select("term", "block", F.md5(F.hex(codecs.encode_block("docs", "positions")).cast("binary")).alias("digest")),
    f"{_PLACES}, n AS (SELECT term, block, list_concat([len(docs)::BIGINT], {_GAPS}, tfs, flatten(gaps)) AS xs FROM b) SELECT term, block, md5({_VBYTE.format('xs')}) AS digest FROM n",
)
_register(
    "codec_block_decode",
    lambda spark, sf: _blocks(spark, sf).select("term", F.explode(codecs.decode_block(codecs.encode_block("docs", "positions"))).alias("p")).select("term", "p.doc_id", "p.tf", _joined(F.col("p.positions")).alias("positions")),
    ORACLE["saved_postings"],
)
_register("codec_block_counts", lambda spark, sf: _blocks(spark, sf).select("term", F.explode(codecs.decode_block_counts(codecs.encode_block("docs", "positions"))).alias("p")).select("term", "p.doc_id", "p.tf"), ORACLE["idx_postings_tf"])
