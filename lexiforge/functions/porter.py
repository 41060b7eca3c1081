"""The Porter stemmer (Porter, 1980), with the common later additions for short and irregular words."""

from __future__ import annotations

from functools import lru_cache

# Words with stems of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning",
    "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning",
    "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    return w if w.endswith("ss") or not w.endswith("s") else w[:-1]


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        if w.endswith(end):
            base = w[: -len(end)]
            if "v" not in _shape(base):
                return w
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if _doubled(base):
                return base if base[-1] in "lsz" else base[:-1]
            return base + "e" if _measure(base) == 1 and _short(base) else base
    return w


def _derived(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _derived(w[:-2])
    for end, new in STEP2:
        if w.endswith(end):
            base = w[: -len(end)]
            return base + new if _measure(w[:-3] if end == "logi" else base) > 0 else w
    return w


def _third(w: str) -> str:
    for end, new in STEP3:
        if w.endswith(end):
            base = w[: -len(end)]
            return base + new if _measure(base) > 0 else w
    return w


def _fourth(w: str) -> str:
    for end in STEP4:
        if w.endswith(end):
            base = w[: -len(end)]
            ok = _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t"))
            return base if ok else w
    return w


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and _shape(w)[-2] == "c":
        w = w[:-1] + "i"
    w = _fourth(_third(_derived(w)))
    if w.endswith("e"):
        base = w[:-1]
        m = _measure(base)
        if m > 1 or (m == 1 and not _short(base)):
            w = base
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


# ---- the same rules as replacements, for the JVM and for SQL

_C, _V, _END_C = "[^aeiouy]", "[aeiouy]", "[^aeiouywxY]"
_M0, _M1 = f"{_C}*{_V}+{_C}", f"{_C}*{_V}+{_C}+{_V}+{_C}"


def _undouble() -> list[tuple[str, str]]:
    """A doubled consonant but l, s, z becomes one; nine to a rule, since SQL names no more groups."""
    pairs = [(f"({x}){x}~$", i % 9 + 1) for i, x in enumerate("bcdfghjkmnpqrtvwx0123456789")]
    rules = [("|".join(p for p, _ in pairs[a : a + 9]), "".join(f"${k}" for _, k in pairs[a : a + 9])) for a in range(0, len(pairs), 9)]
    return [*rules, ("(y)Y~$", "$1")]


#: (pattern, replacement), one after the other; patterns are in what Java and RE2 share. Y is y as a consonant. A mark
#: (#, ~) at the end, or before the ending that a step is about, says that the step's later rules don't apply.
RULES: list[tuple[str, str]] = [
    (f"(^|{_V})y", "$1Y"),
    # plurals
    ("sses$", "ss#"), ("^(.)ies$", "$1ie#"), ("ies$", "i#"), ("([^s#])s$", "$1"), ("#", ""),
    # past and -ing
    ("^(.)ied$", "$1ie#"), ("ied$", "i#"), (f"^({_M0}.*)eed$", "$1ee#"), ("eed$", "eed#"), (f"^(.*{_V}.*)(?:ed|ing)$", "$1~"),
    ("(at|bl|iz)~$", "$1e"), ("(ll|ss|zz)~$", "$1"), *_undouble(), (f"^({_C}+{_V}{_END_C}|{_V}{_C})~$", "$1e"), ("[#~]", ""),
    (f"(.{_C})y$", "$1i"),
    # double suffixes
    (f"^({_M0}.*)alli$", "$1al"),
    ("(ational|tional|enci|anci|izer|bli|alli|entli|eli|ousli|ization|ation|ator|alism|iveness|fulness|ousness|aliti|iviti|biliti|fulli|logi)$", "#$1"),
    (f"^({_M0}.*)#(?:(tion)al|(ent|e|ous|ful)li|(ive|ful|ous)ness|(al)(?:ism|iti))$", "$1$2$3$4$5"),
    (f"^({_M0}.*)#(?:(at)(?:ional|ion|or)|(iz)(?:er|ation)|(bl)i|(enc|anc)i|(iv)iti)$", "$1$2$3$4$5$6e"),
    (f"^({_M0}.*)#biliti$", "$1ble"), (f"^(.*{_V}.*)#logi$", "$1log"), ("#", ""),
    # -ic-, -full, -ness
    ("(icate|ative|alize|iciti|ical|ful|ness)$", "#$1"), (f"^({_M0}.*)#(?:(ic)(?:ate|iti|al)|(al)ize|ative|ful|ness)$", "$1$2$3"), ("#", ""),
    # -ant, -ence
    ("(al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ou|ism|ate|iti|ous|ive|ize)$", "#$1"), ("([st])ion$", "$1#ion"), (f"^({_M1}.*)#.+$", "$1"), ("#", ""),
    # a final e, a doubled l
    (f"^({_M1}.*)e$", "$1#"), (f"^({_C}+{_V}{_END_C}e|{_V}{_C}e)$", "$1#"), (f"^({_C}*{_V}+{_C}+{_V}*)e$", "$1"), ("#", ""),
    (f"^({_C}*{_V}+{_C}+{_V}+(?:{_C}.*)?l)l$", "$1"),
]


def stem_column(word):
    """The stem of a lower-case token (letters, digits and hyphens), as an expression of built-in functions."""
    from pyspark.sql import functions as F

    out = word
    for pattern, new in RULES:
        out = F.regexp_replace(out, pattern, new)
    own = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    return F.when(F.length(word) <= 2, word).otherwise(F.coalesce(own[word], F.translate(out, "Y", "y")))
