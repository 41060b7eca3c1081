import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from lexiforge.llm.pieces import BYTE, ChunkTable, Model, fields, model_path, op13_sentencepiece, piece_ids

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts():
    rng = random.Random(5)
    pools = ["abc DEF\n\t' ▁  ", "aé漢\U0001f600 \xa0　\x1c\x85 ▁", "0123456789.,; -_()", "".join(map(chr, range(256))) + "   "]
    texts = ["".join(rng.choice(p) for _ in range(rng.randint(0, 60))) for p in pools for _ in range(400)]
    return texts + ["", " ", "  ", "   ", "▁", "▁▁", "a ", "a▁", " a", "a  ", "<s> </s><unk>", "<0x0A>", "ab" * 5000, "x\ty\r\nz", "\x00"]


def test_same_ids_and_text(library):
    table = ChunkTable(PATH)
    for t, ids in zip(odd_texts(), table.encode_batch(odd_texts()), strict=True):
        assert ids.tolist() == library.encode(t), t
        assert table.decode(ids.tolist()) == library.decode(ids.tolist())
    for t, (n, i, d) in zip(odd_texts(), table.digests(odd_texts()), strict=True):
        ids = library.encode(t)
        assert (n, i, d) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_each_chunk_is_segmented_once(library):
    table, asked = ChunkTable(PATH), []

    class Spy:
        def encode(self, texts, **kw):
            asked.extend(texts)
            return library.encode(texts, **kw)

    table.library = Spy()
    table.encode_batch(["the cat the cat", "a  cat", "cat"])
    table.encode_batch(["the cat"])
    assert sorted(asked) == [" cat", "a", "cat", "the"]  # of " the", " cat", " a", "  cat"


def test_a_full_table_keeps_what_is_met(library):
    table = ChunkTable(PATH, keep=4000)
    for k in range(60):
        texts = [f"the word{k} x{k}y", "the cat"]
        assert [x.tolist() for x in table.encode_batch(texts)] == [library.encode(t) for t in texts]
        assert len(table.table) + len(table.older) < 40 and " the" in table.table


def test_chunks_that_do_not_decode_to_themselves(library):
    table = ChunkTable(PATH)
    table.digests(["a cat"])
    table.other[" cat"] = b" dog"
    assert table.digests(["a cat"])[0][2] == hashlib.sha256(b"a dog").hexdigest()


def test_models_whose_pieces_cross_take_whole_texts(library, tmp_path):
    raw = library.serialized_model_proto()
    model = Model(raw)
    assert model.cuts and sum(k == BYTE for _, k in model.pieces) == 256 and len(model.pieces) == library.vocab_size()
    # a piece with a marker inside, in place of one of as many bytes
    old = next(p for p, k in model.pieces if len(p.encode()) == 4 and k == 1)
    tag = b"\x0a\x04"
    crossed = raw.replace(tag + old.encode(), tag + "x▁".encode(), 1)
    assert crossed != raw and not Model(crossed).cuts
    path = tmp_path / "crossing.model"
    path.write_bytes(raw)
    table = ChunkTable(str(path))
    table.surface = None  # as for such a model
    for t, ids in zip(odd_texts(), table.encode_batch(odd_texts()), strict=True):
        assert ids.tolist() == library.encode(t) and table.decode(ids.tolist()) == library.decode(ids.tolist())
    assert dict(fields(b"\x08\x96\x01\x12\x02ab")) == {1: 150, 2: b"ab"}


def test_query(spark, folder, empty, docs, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, op13_sentencepiece(spark, folder).collect()), key=key) == sorted(want, key=key)
    assert op13_sentencepiece(spark, empty).count() == 0
    got = {r.doc_id: r.ids for r in piece_ids(docs.where("doc_id in (0, 1, 5)"), model_path()).collect()}
    assert got == {0: [], 1: [], 5: library.encode("One two three four")}
