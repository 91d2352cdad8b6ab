"""Text transforms and perturbations as column expressions; seeded ones depend on the text alone."""

from __future__ import annotations

import random
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Closing forms of opening brackets; other characters stay as they are (fixed values).
_MIRROR = str.maketrans("<[({", ">])}")


def delimit(c: Column, left: str = "<<", right: str | None = None) -> Column:
    return F.concat(F.lit(left), c, F.lit(right if right is not None else left[::-1].translate(_MIRROR)))


def datamark(c: Column, marker: str = "^") -> Column:
    """Puts a marker before every run of white space that follows a character."""
    safe = marker.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, r"(\S)(\s+)", f"$1{safe}$2")


def encode64(c: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"[\r\n]", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def right_to_left(c: Column) -> Column:
    return F.concat(F.lit("‮"), c, F.lit("‬"))


def normal_form(form: str) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return run


def seeded(edit: Callable[[str, random.Random], str], seed: int = 0) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else edit(t, random.Random(f"{seed}:{t}")))

    return run


def _each(share: float, change: Callable[[str, random.Random], str]) -> Callable[[str, random.Random], str]:
    return lambda t, r: "".join(change(ch, r) if r.random() < share else ch for ch in t)


#: Latin letters and Cyrillic look-alikes (fixed values).
LOOKALIKES = {"a": "а", "c": "с", "e": "е", "o": "о", "p": "р", "x": "х", "y": "у", "A": "А", "B": "В", "E": "Е", "K": "К", "O": "О", "P": "Р", "T": "Т"}
#: Combining grave, acute, circumflex, tilde, macron, breve, dot above, diaeresis (fixed values).
MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308"
#: White space that replaces a blank: no-break space and tab (fixed values).
BLANKS = "\u00a0\t"

PERTURBATIONS: dict[str, Callable[[str, random.Random], str]] = {
    "zero_width": _each(0.5, lambda ch, r: ch + "​"),
    "homoglyph": _each(0.3, lambda ch, r: LOOKALIKES.get(ch, ch)),
    "diacritic": _each(0.3, lambda ch, r: unicodedata.normalize("NFC", ch + r.choice("́̀̈")) if ch.isalpha() else ch),
    "whitespace": _each(0.3, lambda ch, r: r.choice(("\t", " ", "  ")) if ch == " " else ch),
    "case": _each(0.5, lambda ch, r: ch.swapcase()),
    "punctuation": _each(0.1, lambda ch, r: ch + r.choice(".,;!")),
    "invisible": _each(0.2, lambda ch, r: ch + r.choice("‌‍⁠")),
    "token_split": lambda t, r: " ".join(w[: (k := r.randrange(1, len(w) - 1))] + " " + w[k:] if len(w) >= 5 else w for w in t.split(" ")),
}


def sweep(df: DataFrame, row_id: str, text: str, strategies: dict[str, Callable[[Column], Column]], scorer: Callable[[Column], Column], threshold: float) -> DataFrame:
    """(strategy, n, mean_before, mean_after, asr): share of rows that a strategy takes from at or above the threshold to below it."""
    d = df.where(F.col(text).isNotNull()).select(row_id, F.col(text).alias("t"))
    parts = [d.select(F.lit(name).alias("strategy"), scorer(F.col("t")).alias("before"), scorer(f(F.col("t"))).alias("after")) for name, f in strategies.items()]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    hit = F.col("before") >= threshold
    return all_.groupBy("strategy").agg(
        F.count("*").alias("n"), F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"),
        F.avg((hit & (F.col("after") < threshold)).cast("double")).alias("asr"),
    )
