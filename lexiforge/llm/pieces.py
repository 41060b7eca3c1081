"""SentencePiece BPE over a table of distinct chunks.

The library writes a marker (U+2581) before the text and for every space. Where no piece has a marker behind another
character, no piece reaches over the place between a word and the marker after it, so a text is cut there into chunks
(markers and the word after them) whose ids don't depend on each other. A task keeps a table of its distinct chunks;
each new one is segmented and decoded once, and a text's ids are looked up in it by position. Models whose pieces cross
markers, or that don't only put markers for spaces, take whole texts as chunks.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .bpe import no_collection
from .common import slabs, small_batches

MARK = "▁"
CHUNKS = re.compile(" +[^ ]*|[^ ]+")

#: About as many bytes of known chunks are kept by a worker.
KEEP = 256 << 20
# Numbers of the model file's fields, types of pieces and of models.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


def fields(raw: bytes):
    """(number, value) of each field of a protocol buffer message: int, or bytes."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = raw[at]
            at, out, shift = at + 1, out | (b & 127) << shift, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """What cutting and decoding need to know of a model file."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, int]] = []
        spec: dict[int, dict] = {TRAINER: {}, NORMALIZER: {}}
        for number, value in fields(raw):
            if number == PIECES:
                p = dict(fields(value))
                self.pieces.append((p[1].decode(), p.get(3, NORMAL)))
            elif number in spec:
                spec[number] = dict(fields(value))
        trainer, normalizer = spec[TRAINER], spec[NORMALIZER]
        plain = not normalizer.get(2) and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1
        inside = any(MARK in p.lstrip(MARK) for p, _ in self.pieces)
        odd = any(kind in (USER, UNUSED) for _, kind in self.pieces)
        self.cuts = trainer.get(3, 1) == BPE and not trainer.get(24, 0) and plain and not inside and not odd

    def surfaces(self) -> list[bytes] | None:
        """The bytes that each id stands for, markers as spaces; None where decoding isn't putting them together."""
        if not self.cuts:
            return None
        return [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode() for p, kind in self.pieces]


class ChunkTable:
    """Encoder and decoder of a model file.

    The table has each chunk's ids as decimals with commas. Chunks that do not decode to themselves stand in another
    table with what they decode to; a text without such chunks decodes to its chunks put together. Where the table is
    full it becomes the older one, from which chunks that are still met move back."""

    def __init__(self, path: str, keep: int = KEEP):
        with open(path, "rb") as f:
            raw = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.surface, self.unknown = Model(raw).surfaces(), self.library.unk_id()
        self.one_mark = self.library.encode(MARK + MARK)[:1] if self.library.piece_to_id(MARK) == self.unknown else [self.library.piece_to_id(MARK)]
        self.decimal = [str(i) for i in range(self.library.vocab_size())]
        self.keep, self.size = keep // 2, 0
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """The text's chunks, markers as spaces, the first with the marker that the library puts before a text."""
        if not text:
            return []
        return CHUNKS.findall(" " + text.replace(MARK, " ")) if self.surface else [text]

    def learn(self, chunks: set[str]) -> None:
        """Segment and decode those of chunks that are not in the table, each once."""
        if self.size > self.keep:
            self.older, self.table, self.size = self.table, {}, 0
            self.other = {c: x for c, x in self.other.items() if c in self.older}
        new = chunks.difference(self.table)
        moved = new.intersection(self.older)
        self.table.update((c, self.older[c]) for c in moved)
        new = list(new - moved)
        self.size += sum(map(len, moved)) + 190 * len(moved)
        # the library puts the first marker back; of a lone one it would be given nothing
        found = self.library.encode([c[1:] for c in new] if self.surface else new, num_threads=1) if new else []
        decimal, known = self.decimal.__getitem__, self.table
        for c, ids in zip(new, found, strict=True):
            if c == " " and self.surface:
                ids = self.one_mark
            known[c] = row = ",".join(map(decimal, ids)).encode()
            self.size += 190 + len(c) + len(row)
            back = self._decoded(ids)
            if back != c.encode():
                self.other[c] = back

    def _decoded(self, ids: list[int]) -> bytes:
        if self.surface is None or self.unknown in ids:
            return self.library.decode(ids).encode()
        return b"".join([self.surface[i] for i in ids])

    def _rows(self, texts: list[str | None]):
        """The chunks of each text and its ids as decimals."""
        with no_collection():
            cut = [self.chunks(t or "") for t in texts]
            self.learn(set().union(*cut))
            at = self.table.__getitem__
            return cut, [b",".join(map(at, c)) for c in cut]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        return [np.array(row.split(b","), np.int32) if row else np.zeros(0, np.int32) for row in self._rows(texts)[1]]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the marker before the text goes."""
        if self.surface is None:
            return self.library.decode(list(ids))
        raw = self._decoded(list(ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", errors="replace")

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids, digest of their decimals and of the text that they decode to."""
        out, skip = [], 1 if self.surface else 0
        for cut, row in zip(*self._rows(texts), strict=True):
            if self.other and not self.other.keys().isdisjoint(cut):
                raw = b"".join([self.other[c] if c in self.other else c.encode() for c in cut])
            else:
                raw = "".join(cut).encode()
            out.append((row.count(b",") + 1 if row else 0, hashlib.sha256(row).hexdigest(), hashlib.sha256(memoryview(raw)[skip:]).hexdigest()))
        return out


@lru_cache(maxsize=2)
def load(path: str) -> ChunkTable:
    """One table a process: it serves all tasks of a Python worker."""
    return ChunkTable(path)


def _ids(path: str):
    def run(batches):
        for (doc_id,), text in slabs(batches, ["doc_id"]):
            ids = load(path).encode_batch(text.to_pylist())
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _digest(path: str):
    def run(batches):
        for (doc_id,), text in slabs(batches, ["doc_id"]):
            n, i, d = zip(*load(path).digests(text.to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(n, pa.int64()), pa.array(i), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def piece_ids(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of each row of (doc_id, text), without begin or end ids."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_ids(path), "doc_id long, ids array<int>")


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, text) the number and digest of its ids and the digest of the text they decode to."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_digest(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text; null is empty: no ids, the empty text.

    Repeated rows and ids each have their row, a null doc_id stays null, other columns don't matter; an empty table
    gives no rows. Memory follows the longest text (its chunks and ids) and the longest word, which the library
    segments in one go."""
    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
