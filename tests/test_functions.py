import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexiforge.functions import codecs
from lexiforge.functions.analyze import PLAIN, AnalyzerConfig, analyze_text, tokens
from lexiforge.functions.porter import stem
from lexiforge.functions.smart import check_scheme
from pyspark.sql import functions as F


def test_analysis_in_order():
    text = "See <b>AI-driven</b> https://x.org/a?b=1 www.foo.bar 2024 4k 2-3 a The été state-of-the-art"
    assert analyze_text(text, PLAIN) == ["see", "ai-driven", "4k", "2-3", "the", "state-of-the-art"]
    assert "the" not in analyze_text(text, AnalyzerConfig(stem=False))
    assert analyze_text(None, PLAIN) == [] and analyze_text("Running dogs", AnalyzerConfig()) == ["run", "dog"]
    assert analyze_text("alpha beta", AnalyzerConfig(stopwords=("alpha",), stem=False)) == ["beta"]


def test_columns_agree_with_the_driver(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["the ", "<b>", "</b>", "Running-Fast ", "http://a.b/c ", "12 ", "x ", "été ", "\t", "dogs "]) for _ in range(20)) for _ in range(60)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for config in (PLAIN, AnalyzerConfig(stem=False), AnalyzerConfig()):
        got = {}
        for r in tokens(df, config).orderBy("doc_id", "pos").collect():
            got.setdefault(r.doc_id, []).append(r.term)
        assert got == {i: a for i, t in enumerate(texts) if (a := analyze_text(t, config))}


def test_a_tag_does_not_span_lines_in_documents(spark):
    df = spark.createDataFrame([(1, "aa <b\nbb> cc <i x=1> dd")], "doc_id long, text string")
    assert [r.term for r in tokens(df, PLAIN).orderBy("pos").collect()] == ["aa", "bb", "cc", "dd"]
    assert analyze_text("aa <b\nbb> cc", PLAIN) == ["aa", "cc"]


def test_stems():
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated sized hopping falling fizzed happy sky relational rational digitizer vietnamization formalize electrical goodness allowance adoption cease controlling roll dying news"
    want = "caress poni tie cat feed agre plaster motor sing conflat size hop fall fizz happi sky relat ration digit vietnam formal electr good allow adopt ceas control roll die news"
    assert [stem(w) for w in words.split()] == want.split()


@given(st.lists(st.integers(0, 2**60)))
@settings(max_examples=200, deadline=None)
def test_vbyte_round_trip(numbers):
    assert codecs.decode_numbers(codecs.encode_numbers(numbers)) == numbers


def test_codecs(spark):
    assert codecs.encode_numbers([0, 127, 128, 300]) == bytes([0, 127, 128, 1, 172, 2])
    assert codecs.decode_numbers(bytes([5, 128])) == [5]
    with pytest.raises(ValueError):
        codecs.encode_numbers([-1])
    df = spark.createDataFrame([([3, 7, 7, 20],), ([],), ([5],), (None,)], "x array<long>")
    rows = df.select("x", codecs.delta_encode(F.col("x")).alias("d"), codecs.delta_decode(codecs.delta_encode(F.col("x"))).alias("u"), codecs.vbyte_decode(codecs.vbyte_encode("x")).alias("v")).collect()
    assert rows[0].d == [3, 4, 0, 13] and all(r.u == r.x and (r.v is None if r.x is None else list(r.v) == r.x) for r in rows)


def test_schemes():
    assert check_scheme("ltc.ltc") == ("ltc", "ltc") and check_scheme("Lpb_ann") == ("Lpb", "ann")
    for bad in ("ltc", "xtc.ltc", "ltc.ltz", "ltc..ltc"):
        with pytest.raises(ValueError):
            check_scheme(bad)


def test_codecs_take_a_batch_at_once(spark):
    """Null and empty rows between others, numbers of one to nine bytes; one call of Python a batch, not one a row."""
    rng = random.Random(4)
    rows = [(i, None if i % 7 == 0 else [] if i % 7 == 1 else [rng.randrange(1 << rng.randint(1, 62)) for _ in range(rng.randint(1, 9))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, x array<long>").repartition(2)
    got = df.select("x", codecs.vbyte_encode("x").alias("b"), codecs.vbyte_decode(codecs.vbyte_encode("x")).alias("v"), codecs.delta_decode("x").alias("s")).collect()
    for r in got:
        assert r.v == r.x and (r.b is None) == (r.x is None) and (r.x is None or codecs.decode_numbers(bytes(r.b)) == r.x)
        assert r.s == (None if r.x is None else [(sum(r.x[: i + 1]) + (1 << 63)) % (1 << 64) - (1 << 63) for i in range(len(r.x))])
    blocks = [([3, 9, 70000], [[1, 500], [0], [7, 8, 9]]), ([1], [[4]]), ([], [])]
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(blocks)], "i long, docs array<long>, positions array<array<long>>").coalesce(1)
    raw = codecs.encode_block("docs", "positions")
    for r in df.select("*", raw.alias("raw"), codecs.decode_block(raw).alias("p"), codecs.decode_block_counts(raw).alias("n")).collect():
        assert [(x.doc_id, x.tf, x.positions) for x in r.p] == [(d, len(p), p) for d, p in zip(r.docs, r.positions, strict=True)]
        assert [(x.doc_id, x.tf, x.positions) for x in r.n] == [(d, len(p), None) for d, p in zip(r.docs, r.positions, strict=True)]
    assert [bytes(r.raw) for r in df.orderBy("i").select(raw.alias("raw")).collect()][0] == codecs.encode_numbers([3, 3, 6, 69991, 2, 1, 3, 1, 499, 0, 7, 1, 1])
    assert "ArrowEvalPython" in df.select(raw)._jdf.queryExecution().executedPlan().toString()
