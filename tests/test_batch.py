import pytest

from lexiforge.functions.analyze import PLAIN
from lexiforge.operators.batch import SCHEMES, search_grid, search_many
from lexiforge.operators.engine import SearchEngine
from lexiforge.operators.index import SearchIndex

TEXTS = ["red fish swims", "red red dog runs far", "blue fish and red fish", "dog sees blue dog", "", None, "fish", "red fish swims"]
QUERIES = {
    1: "red fish", 2: "red AND NOT dog", 3: '"red fish"', 4: "(dog OR fish) AND blue", 5: "nothing", 6: '"blue fish" OR dog',
    7: "fish fish dog", 8: "red OR NOT fish", 9: '"dog sees" red', 10: "(red AND NOT red) OR blue", 11: "",
}


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return SearchEngine(SearchIndex.of(docs, PLAIN).with_norms().cache())


def _rows(df, *names):
    return sorted((*(r[n] for n in names), r.doc_id, round(r.score, 9), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("how", [{"method": "bm25"}, {"method": "tfidf", "scheme": "ltc.ltc"}, {"method": "tfidf", "scheme": "Lpu.anb"}])
def test_many_queries_are_the_single_ones(engine, how):
    want = sorted((q, *row) for q, text in QUERIES.items() for row in _rows(engine.search(text, top_k=3, **how)))
    assert _rows(search_many(engine, QUERIES, top_k=3, **how), "query_id") == want


def test_many_with_a_constant_byte_norm(engine):
    other = SearchEngine(engine.index, byte_norm="reference")
    want = sorted((q, *row) for q, text in QUERIES.items() for row in _rows(other.search(text, scheme="nnb.nnb")))
    assert _rows(search_many(other, QUERIES, method="tfidf", scheme="nnb.nnb"), "query_id") == want


def test_no_queries(engine):
    assert search_many(engine, {}).count() == 0 and search_many(engine, {"a": "..."}).columns == ["query_id", "doc_id", "score", "rank"]
    with pytest.raises(ValueError):
        search_many(engine, {1: "red AND"})
    assert search_grid(engine, "").count() == 0 and search_grid(engine, "nothing").count() == 0


@pytest.mark.parametrize("query", ["red fish fish swims", '(red AND "blue fish") OR dog'])
def test_the_grid_is_the_single_schemes(engine, query):
    assert len(set(SCHEMES)) == 3600
    got = _rows(search_grid(engine, query, top_k=None), "scheme")
    for scheme in ["nnn.nnn", "ltc.ltc", "Lpu.anb", "apb.btu", "bnc.Lpc", "ann.lnu", "ntb.npc"]:
        want = _rows(engine.search(query, top_k=None, scheme=scheme))
        assert [(r[1], round(r[2], 7), r[3]) for r in got if r[0] == scheme] == [(d, round(x, 7), n) for d, x, n in want]


def test_stems_in_the_jvm(spark):
    from pyspark.sql import functions as F

    from lexiforge.functions.porter import IRREGULAR, STEP2, STEP3, STEP4, stem, stem_column

    ends = [*(e for e, _ in STEP2 + STEP3), *STEP4, "ed", "ing", "eed", "ied", "ies", "sses", "s", "y", "e", "ll", "lly", "eings", "yed"]
    words = {b + e for b in ("", "a", "by", "try", "yy", "hop", "fall", "trouble", "siz", "o-o", "x100", "ayyy", "conn", "mult", "s", "oss", "cryst") for e in ends} | set(IRREGULAR)
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem_column(F.col("w")).alias("s"))
    assert [(r.w, r.s) for r in df.collect() if r.s != stem(r.w)] == []
