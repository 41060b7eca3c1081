import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexiforge.llm import bpe as module
from lexiforge.llm.bpe import Known, TrieBpe, load, op7_bpe

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(2)
    pools = ["abcdefghij ABC\n\t'  ", "aé漢\U0001f600́​\xa0 \x1c\x85 ", "0123456789.,;:!?-_ ()'stdmlvre", "".join(chr(i) for i in range(1, 256))]
    texts = ["".join(rng.choice(p) for _ in range(rng.randint(0, 60))) for p in pools for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x2FFF), rng.randrange(32, 127)])) for _ in range(40)) for _ in range(200)]
    words = "the they them there then thermal thermometer thermostat anti antique internationalization don't we'll I'm  x's".split(" ")
    texts += [" ".join(rng.choice(words) for _ in range(30)) for _ in range(50)]
    return texts + ["", " ", "\n\n", "a  ", "  a", "<|endoftext|>", "x <|endoftext|> y<|endoftext|><|endoftext|>  ", "a" * 5000, "ab" * 3000, "1" * 999]


def test_same_ids(reference):
    texts, bpe = odd_texts(), load(PATH)
    for t, raw, e in zip(texts, bpe.encode_batch(texts), reference.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]
        assert ids == e.ids, t
        assert bpe.decode(ids) == reference.decode(ids, skip_special_tokens=False)


def test_every_token_is_its_own_encoding(reference):
    bpe = load(PATH)
    some = set(random.Random(4).sample(sorted(bpe.ids), 3000))
    got = bpe.encode_words(some)
    assert all(b"".join(bpe.bytes[i] for i in ids) == w for w, ids in got.items())
    assert bpe.decode([255, 254, 97]) == reference.decode([255, 254, 97], skip_special_tokens=False)


def test_query(spark, folder, empty, docs, reference):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(reference.decode(ids, skip_special_tokens=False))))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, op7_bpe(spark, folder).collect()), key=key) == sorted(want, key=key)
    assert op7_bpe(spark, empty).count() == 0


def test_long_words(reference, monkeypatch):
    """Beyond DEPTH a word goes on by itself: same ids, and memory of a few bytes a byte."""
    rng = random.Random(9)
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(300_000))
    tracemalloc.start()
    raw = load(PATH).encode_batch([long])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)] == reference.encode(long, add_special_tokens=False).ids
    assert peak < 100 * len(long)
    monkeypatch.setattr(module, "DEPTH", 3)
    bpe = TrieBpe(PATH)
    for t, raw, e in zip(odd_texts(), bpe.encode_batch(odd_texts()), reference.encode_batch(odd_texts(), add_special_tokens=False), strict=True):
        assert [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)] == e.ids, t


def test_what_is_kept_is_bounded():
    k = Known(1000)
    for a in range(0, 100, 4):
        k.update(dict.fromkeys(k.missing({str(i) for i in range(a, a + 4)}), b""))
    assert k.size <= 1000 and len(k) <= 5


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        TrieBpe(str(public_tokenizers.path("word_bpe_49k.json")))
