import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexiforge.llm.packing import CachedEncoder, op4_pack, plan_packing
from test_bpe import odd_texts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_plan_places_every_rank_once():
    rng = random.Random(1)
    for counts in ({1024: 5}, {600: 4, 500: 3, 424: 4, 300: 2, 200: 1}, {n: 200 for n in range(1, 1025)}, {n: rng.randint(0, 400) for n in range(1, 1025)}, {1: 5000}, {}, {513: 10, 2: 3}):
        rows, seen, load = plan_packing(counts), Counter(), defaultdict(list)
        for n, first, ranks, copies, bins, offset in rows:
            assert first == seen[n]
            seen[n] += ranks
            for r in range(ranks):
                load[bins + r // copies].append((offset + r % copies * n, n))
        assert seen == Counter({n: c for n, c in counts.items() if c})
        for own in load.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at <= 1024
        total = sum(n * c for n, c in counts.items())
        if set(counts.values()) == {200}:
            assert len(load) <= -(-total // 1024) * 1.02


def test_two_replace_the_smallest():
    rows = plan_packing({600: 1, 300: 1, 224: 1, 200: 1})
    # greedy takes 600 + 300 and leaves 124; 224 + 200 fill the 424 exactly
    assert {r[0] for r in rows if r[4] == 0} == {600, 224, 200}


def test_query(spark, folder, empty, docs):
    tok = Tokenizer.from_file(PATH)
    rows = op4_pack(spark, folder).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        n = len(ids)
        cut = [0, *range(n % 1024 or 1024, n + 1, 1024)] if n > 1024 else [0, n]
        want.update((r.doc_id, k, i, j - i, zlib.crc32(ids[i:j].tobytes())) for k, (i, j) in enumerate(zip(cut, cut[1:])))
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024
    assert op4_pack(spark, empty).count() == 0


def test_units_are_encoded_like_whole_texts():
    texts, tok = odd_texts(), Tokenizer.from_file(PATH)
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    encoder = CachedEncoder(PATH)
    assert encoder.encode(texts) == want and encoder.encode(texts) == want


def test_units_whose_line_ends_merge_go_to_the_library(monkeypatch):
    texts, tok = odd_texts(), Tokenizer.from_file(PATH)
    encoder = CachedEncoder(PATH)
    encoder.line = [0]  # as if lines could not be told apart
    assert encoder.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    other = Tokenizer.from_file(path)
    assert CachedEncoder(path).encode(texts[:50]) == [np.array(e.ids, "<u4").tobytes() for e in other.encode_batch(texts[:50], add_special_tokens=False)]
