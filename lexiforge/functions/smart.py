"""SMART term, document and normalisation weights: Column builders, and the same as numbers for queries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TF, DF, NORM = "nlabL", "ntp", "ncub"


def check_scheme(scheme: str) -> tuple[str, str]:
    """Document and query code of ddd?qqq, with any character between."""
    if len(scheme) != 7:
        raise ValueError(f"a scheme has seven characters like ltc.ltc, not {scheme!r}")
    doc, query = scheme[:3], scheme[4:]
    for code in (doc, query):
        for letter, known in zip(code, (TF, DF, NORM), strict=True):
            if letter not in known:
                raise ValueError(f"unknown letter {letter!r} in scheme {scheme!r}")
    return doc, query


def tf_weight(code: str, tf: Column, max_tf: Column, avg_tf: Column) -> Column:
    return {
        "n": lambda: tf.cast("double"),
        "l": lambda: 1 + F.log10(tf),
        "a": lambda: 0.5 + 0.5 * tf / max_tf,
        "b": lambda: F.lit(1.0),
        "L": lambda: (1 + F.log10(tf)) / (1 + F.log10(avg_tf)),
    }[code]()


def df_weight(code: str, df: Column, n: Column) -> Column:
    return {
        "n": lambda: F.lit(1.0),
        "t": lambda: F.log10(n / df),
        "p": lambda: F.when(df < n, F.greatest(F.lit(0.0), F.log10((n - df) / df))).otherwise(0.0),
    }[code]()


def tf_number(code: str, tf: float, max_tf: float, avg_tf: float) -> float:
    log = 1 + math.log10(tf)
    return {"n": tf, "l": log, "a": 0.5 + 0.5 * tf / max_tf, "b": 1.0, "L": log / (1 + math.log10(avg_tf))}[code]


def df_number(code: str, df: int, n: int) -> float:
    if code == "p":
        return max(0.0, math.log10((n - df) / df)) if df < n else 0.0
    return 1.0 if code == "n" else math.log10(n / df)


def unique_norm(unique: Column | float, avg_unique: float, slope: float = 0.2):
    """1 / (1 - slope + slope * unique / avg_unique); 1 where either is 0."""
    if isinstance(unique, Column):
        return F.when(unique > 0, 1 / (1 - slope + slope * unique / avg_unique)).otherwise(1.0) if avg_unique else F.lit(1.0)
    return 1 / (1 - slope + slope * unique / avg_unique) if unique and avg_unique else 1.0


def byte_norm(size: Column | float, alpha: float = 0.5):
    """size ** -alpha; 1 where size is 0."""
    if isinstance(size, Column):
        return F.when(size > 0, 1 / F.pow(size.cast("double"), F.lit(alpha))).otherwise(1.0)
    return size**-alpha if size else 1.0
