"""Byte-level BPE over a trie of distinct words.

Texts are cut into units, a run of non-space with the space before it, which byte-level BPE never merges across.
A batch's new units are cut into words; distinct words go into a trie, and a depth-first walk gives every node
the last token of its prefix's encoding: of the tokens that end there, the one that BPE would leave standing
beside the last token of what comes before it. So a prefix that many words share is encoded once. The trie ends
at DEPTH bytes: from there a longer word, which nothing is likely to share, goes on by itself in two arrays.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
from array import array
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches

_W = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # Unicode White_Space
UNITS = re.compile(f"[{_W}]?[^{_W}]+|[{_W}]+(?=[{_W}][^{_W}])|[{_W}]+")
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+(?![^{_W}])|[{_W}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Bytes of a word that are put in the trie, and about as many bytes of known units, and words, that are kept.
DEPTH, KEEP = 1024, 160 << 20


def is_byte_level(spec: dict) -> bool:
    """Whether a tokenizers JSON file cuts and encodes as this module does: bytes alone, the default pattern."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    own = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and spec.get("normalizer") is None and spec.get("post_processor") is None
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    exact = not any(a.get(k) for a in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return model.get("type", "BPE") == "BPE" and own and plain and exact


def words_of(units: set[str]) -> dict[str, list[str]]:
    """The words that each unit is cut into."""
    letters = (u for u in units if u.isascii() and (u[1:] if u[0] == " " else u).isalpha())
    cut = {u: [u] for u in letters}  # such a unit is a word
    cut.update((u, WORDS.findall(u)) for u in units if u not in cut)
    return cut


@contextmanager
def no_collection():
    """For code that makes many small objects and no cycles, which would be looked through again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Known(dict):
    """Texts' ids; starts anew where it would take more than about most bytes."""

    def __init__(self, most: int = KEEP):
        super().__init__()
        self.most, self.size = most, 0

    def missing(self, texts: set) -> set:
        """Those of texts that aren't known, after making room for them."""
        new = texts.difference(self)
        size = 170 * len(new) + 2 * sum(map(len, new))
        if self.size + size > self.most and self:
            self.clear()
            self.size, new = 0, texts
            size = 170 * len(new) + 2 * sum(map(len, new))
        self.size += size
        return new


class TrieBpe:
    """Encoder and decoder of a tokenizers JSON file with a byte-level BPE model; ValueError for other files."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not is_byte_level(spec):
            raise ValueError(f"{path} has no plain byte-level BPE model")
        model, alphabet = spec["model"], byte_alphabet()
        raw = {t: bytes(alphabet[c] for c in t) for t in model["vocab"] if all(c in alphabet for c in t)}
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.ids = {b: model["vocab"][t] for t, b in raw.items() if t not in self.special}
        self.bytes: list[bytes] = [b""] * (max(chain(model["vocab"].values(), self.special.values())) + 1)
        for b, i in self.ids.items():
            self.bytes[i] = b
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.merge: dict[tuple[int, int], int] = {}
        parents: dict[int, tuple[int, int, int]] = {}  # token: (rank, left, right)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = self.ids[raw[left]], self.ids[raw[right]]
            self.merge[a, b] = rank
            parents.setdefault(self.ids[raw[left] + raw[right]], (rank, a, b))
        self.parents = parents
        self._back: dict = {}  # the tokens' bytes from their ends, each token under -1
        for b, i in self.ids.items():
            at = self._back
            for c in reversed(b):
                at = at.setdefault(c, {})
            at[-1] = i
        self._beside: dict[int, bool] = {}
        self._spines: dict[int, tuple] = {}
        self._units, self._words = Known(), Known()
        self._cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """From the byte at token's left (1) or right (2) edge up to token: (part, rank at which the next absorbs it)."""
        key = 2 * token + side
        out = self._spines.get(key)
        if out is None:
            parts, ranks = [token], [float("inf")]
            while (p := self.parents.get(parts[-1])) is not None:
                parts.append(p[side])
                ranks.append(p[0])
            out = self._spines[key] = list(zip(parts[::-1], ranks[::-1], strict=True))
        return out

    def beside(self, a: int, b: int) -> bool:
        """Whether BPE on the bytes of a and b ends with these two tokens.

        Merges run by rank, so at every rank the boundary has the part of a's right spine and of b's left
        spine that stand then; the pair breaks if those two merge before either is absorbed. At one rank
        the merge further left comes first."""
        key = (a << 20) | b
        ok = self._beside.get(key)
        if ok is None:
            left, right, i, j, ok = self._spine(a, 2), self._spine(b, 1), 0, 0, True
            while True:
                (x, x_gone), (y, y_gone) = left[i], right[j]
                rank = self.merge.get((x, y))
                if rank is not None and rank < x_gone and rank <= y_gone:
                    ok = False
                    break
                if x_gone == y_gone == float("inf"):
                    break
                if x_gone <= y_gone:
                    i += 1
                else:
                    j += 1
            if len(self._beside) > 4_000_000:
                self._beside.clear()
            self._beside[key] = ok
        return ok

    def encode_words(self, words: set[bytes]) -> dict[bytes, list[int]]:
        """Ids of each word: one trie, one depth-first walk."""
        children: list[dict[int, int]] = [{}]
        ends: dict[int, list[bytes]] = {}
        for w in words:
            at = 0
            for c in w[:DEPTH]:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                at = nxt
            ends.setdefault(at, []).append(w)
        out: dict[bytes, list[int]] = {}
        back, known, beside = self._back, self._beside, self.beside
        depths = 2 + min(DEPTH, max(map(len, words), default=0))
        path, last, size = [0] * depths, [0] * depths, [0] * depths  # by the prefix's length
        walk = [(n, c, 1) for c, n in children[0].items()]
        while walk:
            node, byte, depth = walk.pop()
            path[depth] = byte
            # the tokens that end here, short ones first
            tokens, at, n = [], back, depth
            while n and (at := at.get(path[n])) is not None:
                n -= 1
                t = at.get(-1)
                if t is not None:
                    tokens.append((t, n))
            for t, before in reversed(tokens):
                if before:
                    ok = known.get(last[before] << 20 | t)
                    if not (beside(last[before], t) if ok is None else ok):
                        continue
                last[depth], size[depth] = t, before
                break
            for w in ends.get(node, ()):
                if len(w) > DEPTH:
                    out[w] = self._go_on(w, last, size)
                    continue
                got, d = [], depth
                while d:
                    got.append(last[d])
                    d = size[d]
                out[w] = got[::-1]
            for c, n in children[node].items():
                walk.append((n, c, depth + 1))
        return out

    def _go_on(self, w: bytes, last: list[int], size: list[int]) -> list[int]:
        """Ids of a word of more than DEPTH bytes from the last tokens of its prefixes up to there; eight bytes a
        byte of it are held."""
        last, size = (array("i", x[: DEPTH + 1]) for x in (last, size))
        back, known, beside = self._back, self._beside, self.beside
        for depth in range(DEPTH + 1, len(w) + 1):
            tokens, at, n = [], back, depth
            while n and (at := at.get(w[n - 1])) is not None:
                n -= 1
                t = at.get(-1)
                if t is not None:
                    tokens.append((t, n))
            for t, before in reversed(tokens):
                if before:
                    ok = known.get(last[before] << 20 | t)
                    if not (beside(last[before], t) if ok is None else ok):
                        continue
                last.append(t)
                size.append(before)
                break
        got, d = [], len(w)
        while d:
            got.append(last[d])
            d = size[d]
        return got[::-1]

    def learn(self, units: set[str]) -> None:
        """Encode units that are not known yet; their words that are known are not encoded again."""
        if not units:
            return
        with no_collection():
            self._learn(units)

    def _learn(self, units: set[str]) -> None:
        cut = {u: [w.encode() for w in words] for u, words in words_of(units).items()}
        every = set(chain.from_iterable(cut.values()))
        new = self._words.missing(every)
        for w, i in self.encode_words(new).items():
            self._words[w] = struct.pack(f"<{len(i)}I", *i)
        known = self._words
        for u, words in cut.items():
            self._units[u] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        parts: list[list[str | int]] = []
        for t in texts:
            if self._cut and self._cut.search(t):
                row: list[str | int] = []
                done = 0
                for m in self._cut.finditer(t):
                    row += [t[done : m.start()], self.special[m[0]]]
                    done = m.end()
                parts.append([*row, t[done:]])
            else:
                parts.append([t])
        rows = [[UNITS.findall(x) if isinstance(x, str) else x for x in row] for row in parts]
        self.learn(self._units.missing(set().union(*(x for row in rows for x in row if isinstance(x, list)))))
        known = self._units.__getitem__
        return [b"".join([b"".join(map(known, x)) if isinstance(x, list) else x.to_bytes(4, "little") for x in row]) for row in rows]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> TrieBpe:
    """One encoder a process: its known units serve all tasks of a Python worker."""
    return TrieBpe(path)


def _digest(path: str):
    def run(batches):
        bpe = load(path)
        dec = [str(i).encode() for i in range(len(bpe.bytes))]
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                texts = [t or "" for t in batch.column(1).slice(a, 500).to_pylist()]
                rows = []
                for ids in bpe.encode_batch(texts):
                    got = np.frombuffer(ids, "<u4").tolist()
                    joined = hashlib.sha256(b",".join(map(dec.__getitem__, got))).hexdigest()
                    rows.append((len(got), joined, hashlib.sha256(bpe.decode(got).encode()).hexdigest()))
                n, i, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 500), pa.array(n, pa.int64()), pa.array(i), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, text) the number and digest of its ids and the digest of the text they decode to."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_digest(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text; null is empty: no ids, the empty text.

    Repeated rows each have their row, other columns don't matter. A very long word is encoded in memory of about
    eight times its bytes, a long text in that of its ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe_digests(docs, tokenizer_path())
