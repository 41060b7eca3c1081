"""Personal data by weak supervision.

Base matches (fixed patterns) always count. Besides, wider candidate patterns of the same kinds are voted on
by regex, structure, gazetteer, context and boundary labelers (1 for, -1 against, 0 abstains). How often each
candidate shape gets each combination of votes is counted over the whole corpus; from these counts an
expectation-maximisation estimates the labelers' reliabilities and each combination's posterior, which trains
the final classifier (logistic regression on votes and shape). Candidates that it accepts and that no base
match of their kind touches become spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, trim

KINDS = ("email", "ip", "card", "phone")

# ---- base matches. The lookbehinds and possessive repeats only keep the search linear: a match that starts
# inside a run of digits would have started at the run's first digit.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _octets(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        i = at
        while i > done and text[i - 1] in _LOCAL_CHARS:
            i -= 1
        m = _DOMAIN.match(text, at + 1) if i < at else None
        if m:
            out.append((i, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind; a match that fails its check is dropped, not retried."""
    return {
        "email": _emails(text) if "@" in text else [],
        "ip": [m.span() for m in _IP.finditer(text) if _octets(m[0])],
        "card": [m.span() for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else [],
    }


# ---- candidates
_CANDIDATES = {
    "email": re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}\b"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,7}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
}
_MAY = {"email": ("(at)", "[at]", "{at}", " at "), "ip": (":",)}

# ---- gazetteers and cues
TLDS = frozenset("com org net edu gov mil int info biz io de fr es it nl uk us ca eu ch at be pl pt se no dk fi".split())
#: First digits of payment cards by network.
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38", "30")
FOR = {
    "email": ("mail", "contact", "write", "address", "reach", "courriel", "correo"),
    "ip": ("ip", "host", "server", "addr", "client", "node"),
    "card": ("card", "visa", "credit", "debit", "payment", "amex", "carte", "tarjeta", "karte"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "cell", "contact", "ruf", "llam", "appel"),
}
AGAINST = ("version", "isbn", "order", "invoice", "serial", "ticket", "price", "total", "page", "build", "token", "hash", "key", "sha", "uuid", "id=", "no.", "$", "€")


def _votes(kind: str, text: str, i: int, j: int) -> tuple[str, int]:
    """The labelers' votes as signs, and the class of the candidate's shape."""
    s, digits = text[i:j], _digits(text[i:j])
    before, after = text[max(0, i - 48) : i].lower(), text[j : j + 16].lower()
    if kind == "email":
        tail = re.split(r"[^A-Za-z0-9-]+", s.rstrip(")]} "))[-1].lower()
        regex = 1 if re.search(r"[(\[{]at[)\]}]", s) else 0
        structure = 1 if re.search(r"dot|[(\[{]", s) and len(s) < 80 else -1
        gazetteer = 1 if tail in TLDS else -1
    elif kind == "ip":
        regex, structure, gazetteer = 1, 1 if len(set(s.split(":"))) > 2 else -1, 0
    elif kind == "card":
        regex = 1 if re.fullmatch(r"[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}", s) else 0
        structure = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
    else:
        regex = 1 if s.startswith("(") or re.fullmatch(r"[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}", s) else -1
        structure = 1 if 9 <= len(digits) <= 12 else -1
        gazetteer = -1 if re.fullmatch(r"(?:19|20)[0-9]{2}[ .-].*", s) or len(set(digits)) <= 2 else 0
    context = 1 if any(c in before for c in FOR[kind]) else -1 if any(c in before or c in after for c in AGAINST) else 0
    boundary = -1 if (i and (text[i - 1].isalnum() or text[i - 1] in "=_#/\\")) or (j < len(text) and (text[j].isalnum() or text[j] in "=_#/\\")) else 0
    return "".join("-0+"[v + 1] for v in (regex, structure, gazetteer, context, boundary)), min(9, (j - i) // 4)


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, votes and shape) of each candidate that no base match of any kind touches."""
    out = []
    taken = sorted(span for spans in base.values() for span in spans)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for kind in KINDS:
        if kind in _MAY and not any(x in text for x in _MAY[kind]):
            continue
        for m in _CANDIDATES[kind].finditer(text):
            i, j = m.span()
            before = bisect_left(starts, j)
            if not before or reach[before - 1] <= i:
                votes, shape = _votes(kind, text, i, j)
                out.append((kind, i, j, f"{votes}{shape}"))
    return out


# ---- reliabilities and the final classifier


def estimate(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of each votes pattern, the labelers' P(vote | class) and the prior, by expectation-maximisation.

    Starts from the majority of votes; add-one smoothing keeps every estimate off 0 and 1."""
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([["-0+".index(c) for c in k] for k in keys])
    post = 1 / (1 + np.exp(-(v - 1).sum(1).astype(float)))
    rel, prior = np.zeros((2, v.shape[1], 3)), 0.5
    for _ in range(rounds):
        for c, w in enumerate((n * (1 - post), n * post)):
            for lf in range(v.shape[1]):
                # a labeler leans towards its own vote: the pseudo-counts say which class is which
                rel[c, lf] = np.bincount(v[:, lf], w, 3) + (np.array([1, 1, 3]) if c else np.array([3, 1, 1]))
                rel[c, lf] /= rel[c, lf].sum()
        prior = ((n * post).sum() + 1) / (n.sum() + 2)
        both = [np.log(p) + np.log(rel[c, np.arange(v.shape[1]), v]).sum(1) for c, p in enumerate((1 - prior, prior))]
        new = 1 / (1 + np.exp(np.clip(both[0] - both[1], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return dict(zip(keys, post.tolist(), strict=True)), rel, prior


def _features(keys: list[str]) -> np.ndarray:
    x = np.zeros((len(keys), 1 + 15 + 10))
    for r, k in enumerate(keys):
        x[r, 0] = 1
        for lf, c in enumerate(k[:5]):
            x[r, 1 + 3 * lf + "-0+".index(c)] = 1
        x[r, 16 + int(k[5])] = 1
    return x


def fit_classifier(counts: dict[str, int], posterior: dict[str, float], ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression on the posteriors, by Newton's method."""
    keys = list(counts)
    x, n, y = _features(keys), np.array([counts[k] for k in keys], float), np.array([posterior[k[:5]] for k in keys])
    w = np.zeros(x.shape[1])
    n = n / max(1.0, n.sum() / 1e4)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (n * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class PiiModel:
    weights: dict[str, np.ndarray]
    reliability: dict[str, np.ndarray]
    threshold: float = 0.5

    def accepts(self, kind: str, key: str) -> bool:
        return kind in self.weights and self.probability(kind, key) >= self.threshold

    def probability(self, kind: str, key: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(_features([key])[0] @ self.weights[kind], -30, 30))))

    def __hash__(self):
        return id(self)

    @lru_cache(maxsize=20_000)  # noqa: B019
    def _accepts(self, kind: str, key: str) -> bool:
        return self.accepts(kind, key)

    def spans(self, text: str) -> tuple[dict, list[tuple[int, int, int]]]:
        """Base matches by kind, and all spans as (start, kind's place, end)."""
        base = base_spans(text)
        found = [(i, k, j) for k, kind in enumerate(KINDS) for i, j in base[kind]]
        for kind, i, j, key in candidates(text, base):
            if self._accepts(kind, key):
                found.append((i, KINDS.index(kind), j))
        return base, sorted(found)


def _count_keys(batches):
    seen: dict[tuple[str, str], int] = {}
    for batch in batches:
        for t in batch.column(0):
            t = t.as_py()
            if t:
                for kind, _, _, key in candidates(t, base_spans(t)):
                    seen[kind, key] = seen.get((kind, key), 0) + 1
    yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in seen], pa.string()), "key": pa.array([k for _, k in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def fit_pii(docs: DataFrame, text: str = "text") -> PiiModel:
    """Reliabilities and classifiers from the vote counts of all texts (at most 3**5 * 10 keys a kind)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_count_keys, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    weights, reliability = {}, {}
    for kind in KINDS:
        counts = {r.key: r.n for r in rows if r.kind == kind}
        if counts:
            patterns: dict[str, int] = {}
            for k, n in counts.items():
                patterns[k[:5]] = patterns.get(k[:5], 0) + n
            posterior, reliability[kind], _ = estimate(dict(sorted(patterns.items())))
            weights[kind] = fit_classifier(dict(sorted(counts.items())), posterior)
    return PiiModel(weights, reliability)


def _find(model: PiiModel):
    def run(batches):
        trim()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows = []
            for t in texts:
                base, found = model.spans(t.as_py() or "")
                told = sorted((i, k, j) for k, kind in enumerate(KINDS) for i, j in base[kind])
                say = lambda spans: ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in spans)
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(say(told).encode()).hexdigest(), say(found)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def _redact(columns: list[str], text: str, model: PiiModel):
    def run(batches):
        for batch in batches:
            at, out = batch.schema.names.index(text), []
            for t in batch.column(at):
                t = t.as_py()
                found = model.spans(t)[1] if t else []
                parts, done = [], 0
                for i, k, j in found:
                    if i >= done:
                        parts += [t[done:i], f"<{KINDS[k].upper()}>"]
                    done = max(done, j)
                out.append("".join(parts) + t[done:] if found else t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else batch.column(batch.schema.names.index(c)) for c in columns], columns)

    return run


def redact_pii(docs: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """docs with each span (of overlapping ones their union) replaced by its kind in angle brackets."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_redact(docs.columns, text, model), T.StructType(docs.schema.fields))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every whole text; null and empty texts have none. Repeated rows give repeated rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(_find(fit_pii(docs)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
