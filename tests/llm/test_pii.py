import hashlib
import random
import re
from collections import Counter

from lexiforge.llm.pii import base_spans, estimate, fit_pii, op1_pii, redact_pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def plain(text):
    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d),
        "phone": lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15,
    }
    return {k: [m.span() for m in p.finditer(text) if ok[k](m[0])] for k, p in PLAIN.items()}


def test_base_equals_the_plain_patterns():
    rng = random.Random(4)
    for alphabet in ("ab.@-1+ ", "0123. -+()", "4111 -.", "a@b.c@d._%+-é1"):
        for _ in range(3000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert base_spans(t) == plain(t), t
    t = "x 4111 1111 1111 1111, 1.2.3.4.5.6.7.8 a.b@c.d@e.f +1 (988) 555-2485. 256.1.1.1 0001.2.3.4"
    assert base_spans(t) == plain(t)


def test_em_finds_the_reliable_labelers():
    rng = random.Random(1)
    seen = Counter()
    for _ in range(4000):
        y = rng.random() < 0.3
        vote = lambda p: "+" if (rng.random() < p) == y else "-"
        seen[vote(0.95) + vote(0.9) + vote(0.55) + ("0" if rng.random() < 0.5 else vote(0.8)) + vote(0.85)] += 1
    posterior, rel, prior = estimate(dict(seen))
    assert abs(prior - 0.3) < 0.05 and rel[1, 0, 2] > 0.85 > rel[1, 2, 2]
    assert posterior["+++0+"] > 0.9 and posterior["---0-"] < 0.1


def test_query(spark, folder, empty, docs):
    rows = {(r.doc_id, r.base_sha256): r for r in op1_pii(spark, folder).collect()}
    for d in docs.collect():
        want = plain(d.text or "")
        told = sorted((i, list(PLAIN).index(k), k, j) for k, s in want.items() for i, j in s)
        r = rows[d.doc_id, hashlib.sha256(",".join(f"{k}:{i}:{j}" for i, _, k, j in told).encode()).hexdigest()]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in PLAIN]
        assert all(f"{k}:{i}:{j}" in r.spans.split(",") for i, _, k, j in told)
    assert op1_pii(spark, empty).count() == 0


def test_method_adds_spans(spark):
    texts = [f"please call our office phone (212) 555-{1000 + i} or mail joe{i} [at] example [dot] com" for i in range(60)]
    texts += [f"order no. 2021-{1000 + i}-{5000 + i} page" for i in range(60)] + ["ordinary words at home. dot and at"] * 50
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = fit_pii(df)
    out = [r.text for r in redact_pii(df, model).orderBy("doc_id").collect()]
    assert all("<PHONE>" in t and "<EMAIL>" in t for t in out[:60])
    assert all(a == b for a, b in zip(out[60:], texts[60:]) if not any(plain(b).values()))
