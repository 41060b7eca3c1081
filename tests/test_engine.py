import math
import random

import pytest
from lexiforge.functions.analyze import PLAIN, AnalyzerConfig
from lexiforge.operators import metrics
from lexiforge.operators.engine import SearchEngine
from lexiforge.operators.index import SearchIndex, norm_name
from lexiforge.plans.parser import is_boolean, parse, split_query
from lexiforge.sources.text import text_files


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(0, "alpha beta alpha"), (1, "beta gamma"), (2, "alpha gamma gamma delta"), (3, "")]
    return SearchEngine(SearchIndex.of(spark.createDataFrame(rows, "doc_id long, text string"), PLAIN).with_norms().cache())


def scores(df):
    return [(r.doc_id, round(r.score, 6)) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize(
    ("query", "kw", "want"),
    [
        ("alpha delta", {"method": "bm25"}, [(2, 1.540327), (0, 0.894383)]),
        ("alpha alpha", {"method": "BM25"}, [(0, 1.277691), (2, 0.733489)]),
        ("alpha delta", {}, [(2, 0.864341), (0, 0.354577)]),
        ("alpha delta", {"scheme": "nnn.nnn"}, [(0, 2.0), (2, 2.0)]),
        ("alpha delta", {"scheme": "lnu.nnn"}, [(2, 1.75), (0, 1.26489)]),
        ("alpha delta", {"scheme": "Lnn.nnn"}, [(2, 1.777875), (0, 1.106232)]),
        ("alpha delta", {"scheme": "ann.nnn"}, [(2, 1.5), (0, 1.0)]),
        ("alpha delta", {"scheme": "npn.nnn"}, [(2, 0.477121)]),
        ("alpha delta", {"top_k": 1, "scheme": "nnn.nnn"}, [(0, 2.0)]),
        ("alpha delta", {"top_k": None, "scheme": "nnn.nnn"}, [(0, 2.0), (2, 2.0)]),
        ("nothing here", {}, []),
        ("", {}, []),
    ],
)
def test_golden_scores(engine, query, kw, want):
    assert scores(engine.search(query, **kw)) == want


def test_norms(engine):
    got = {r.doc_id: round(r.norm_ltc, 6) for r in engine.index.doc_stats.collect()}
    assert got == {0: 2.024407, 1: 2.348958, 2: 1.284075, 3: 1e6}
    assert engine.index.stats == (4, 2.25, 1.75) and len({norm_name(c).lower() for c in ("lnc", "Lnc", "anc")}) == 3


VECTORS = {
    "foo NOT bar": "foo bar NOT AND",
    "a OR b AND c": "a b c AND OR",
    "NOT a AND b": "a NOT b AND",
    "(a b) OR c": "a b AND c OR",
    '"x y" OR (p AND NOT q)': '"x y" p q NOT AND OR',
    "NOT (a AND NOT b)": "a b NOT AND NOT",
    "NOT NOT a": "a NOT NOT",
    "a ) AND b": "a b AND",
}


@pytest.mark.parametrize(("query", "rpn"), VECTORS.items())
def test_parser(query, rpn):
    assert " ".join(parse(split_query(query)).rpn()) == rpn


@pytest.mark.parametrize("query", ["NOT a", "foo AND", "AND foo", "a OR (b AND )", "a and b OR c", "NOT a AND NOT b"])
def test_malformed_queries(engine, query):
    with pytest.raises(ValueError):
        engine.search(query)


def test_parameters_are_checked(engine):
    for kw in ({"method": "lm"}, {"scheme": "xyz.ltc"}, {"top_k": -1}):
        with pytest.raises(ValueError):
            engine.search("alpha", **kw)
    assert not is_boolean(split_query("a and b")) and is_boolean(split_query("a AND b"))


def docs_of(df):
    return {r.doc_id for r in df.collect()}


def test_boolean_quirks(engine):
    search = lambda q, **kw: docs_of(engine.search(q, method="bm25", **kw))
    assert search("alpha AND gamma") == search("gamma AND alpha") == {2}
    assert search("NOT NOT alpha") == set() and docs_of(engine.match("NOT NOT alpha")) == {0, 2}
    assert search("(alpha AND beta") == set()
    assert search("delta OR NOT alpha") == {2} and docs_of(engine.match("delta OR NOT alpha")) == {1, 2, 3}
    assert search("alpha AND NOT gamma") == {0} and search("unknown AND alpha") == set()
    # the AND is empty, so its words don't score, not even for documents that have them
    assert search("(beta AND delta) OR gamma") == {1, 2}
    assert scores(engine.search("(alpha AND zzz) OR gamma", method="bm25")) == scores(engine.search("gamma", method="bm25"))
    assert search("alpha beta AND alpha") == {0}


def test_stopword_leaf_and_all_scheme_pairs(spark):
    rows = [(i, t) for i, t in enumerate(["AI and AI learn", "machine learning machine", "the cat", "machine learning", "x y z", "other words", "more words"])]
    engine = SearchEngine(SearchIndex.of(spark.createDataFrame(rows, "doc_id long, text string"), AnalyzerConfig()).with_norms().cache())
    assert docs_of(engine.search("the AND cat")) == set()
    assert docs_of(engine.search('"machine learning"')) == {1, 3} and docs_of(engine.search('"information retrieval"')) == set()
    stats = engine.index.stats
    for doc in [t + d + n for t in "nlabL" for d in "ntp" for n in "ncub"]:
        for query in [t + d + n for t in "nlabL" for d in "ntp" for n in "ncub"]:
            rows, (_, norm) = engine._smart(["ai"], {"ai": 1}, doc, query)
            assert rows and rows[0][1] > 0 and math.isfinite(rows[0][1]) and stats[0] == 7
    for doc in ("ltc", "Lpb", "anu", "bnn"):
        assert docs_of(engine.search("AI", scheme=doc + ".ltc")) == {0}


def test_phrases_against_a_scan(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    engine = SearchEngine(SearchIndex.of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PLAIN).cache())
    for phrase in ("aa bb", "aa aa", "aa bb aa", "cc"):
        w = phrase.split()
        want = {i: n for i, t in enumerate(texts) if (n := sum(t.split()[k : k + len(w)] == w for k in range(len(t.split()))))}
        from lexiforge.operators.phrase import phrase_hits

        assert {r.doc_id: r.tf for r in phrase_hits(engine.index.postings, w).collect()} == want
        assert docs_of(engine.search(f'"{phrase}"', method="bm25", top_k=None)) == set(want)


def test_save_and_load(spark, engine, tmp_path):
    engine.index.save(f"{tmp_path}/ix")
    again = SearchEngine(SearchIndex.load(spark, f"{tmp_path}/ix", PLAIN))
    for kw in ({"method": "bm25"}, {}, {"scheme": "Lpc.anu"}):
        assert scores(again.search('alpha delta "gamma gamma"', **kw)) == scores(engine.search('alpha delta "gamma gamma"', **kw))
    plan = again.index.get_tfs("alpha")._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in plan and "PushedFilters" in plan
    again.index.close()
    again.index.close()


def test_empty_corpus(spark):
    engine = SearchEngine(SearchIndex.of(spark.createDataFrame([(0, "")], "doc_id long, text string"), PLAIN))
    assert scores(engine.search("alpha")) == [] and scores(engine.search("alpha AND beta", method="bm25")) == []


def test_metrics(spark):
    run = spark.createDataFrame([(1, r + 1, d) for r, d in enumerate([2, 1, 0, 4])] + [(2, 1, 9)], "query_id long, rank int, doc_id long")
    qrels = spark.createDataFrame([(1, 0), (1, 2), (1, 5), (1, 5)], "query_id long, doc_id long")
    value = lambda df: {r.query_id: round(r.value, 6) for r in df.collect()}
    assert value(metrics.precision_at_k(run, qrels, 3)) == {1: 0.666667, 2: 0}
    assert value(metrics.precision_at_k(run, qrels, 10))[1] == 0.2 and value(metrics.precision_at_k(run, qrels, 0))[1] == 0
    assert value(metrics.recall_at_k(run, qrels, 3))[1] == 0.666667
    assert value(metrics.dcg_at_k(run, qrels, 3))[1] == 1.5
    assert value(metrics.ndcg_at_k(run, qrels, 3)) == {1: 0.703918, 2: 0}
    assert value(metrics.average_precision(run, qrels)) == {1: 0.555556, 2: 0}
    assert value(metrics.reciprocal_rank(run, qrels)) == {1: 1.0, 2: 0}
    assert round(metrics.mean_average_precision(run, qrels).first().value, 6) == 0.277778
    assert metrics.mean_reciprocal_rank(run, qrels).first().value == 0.5
    assert metrics.mean_reciprocal_rank(run.limit(0), qrels).first().value == 0


def test_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, text in (("in/b.txt", "beta\ngamma"), ("in/sub/a.txt", "alpha"), ("in/c.md", "no")):
        (tmp_path / name).write_text(text)
    rows = text_files(spark, f"{tmp_path}/in", f"{tmp_path}/in", glob="*.txt").orderBy("doc_id").collect()
    assert [(r.doc_id, r.key.rsplit("/", 1)[-1], r.text) for r in rows] == [(0, "b.txt", "beta\ngamma"), (1, "a.txt", "alpha")]


def test_batch_equals_single_queries(spark, engine):
    queries = spark.createDataFrame([(7, "alpha delta"), (8, "alpha alpha")], "query_id long, text string")
    got = engine.search_batch(queries, top_k=5).orderBy("query_id", "rank").collect()
    for q, text in ((7, "alpha delta"), (8, "alpha alpha")):
        assert [(r.doc_id, round(r.score, 6)) for r in got if r.query_id == q] == scores(engine.search(text, method="bm25"))


def test_batch_shuffles_postings_by_document_once(engine):
    """Scores, one for each query and document, are never shuffled: between the postings and the ranks there is one
    exchange, by document, and the queries' words are broadcast."""
    queries = engine.index.postings.sparkSession.createDataFrame([(1, "sparse retrieval"), (2, "index")], "query_id long, text string")
    plan = engine.search_batch(queries, top_k=5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and "SortMergeJoin" not in plan
    assert not any("doc_id" in x and "query_id" in x for x in plan.split("\n") if "hashpartitioning(" in x for x in [x.split("hashpartitioning(")[1].split(")")[0]])
