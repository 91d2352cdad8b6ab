"""Text quality statistics of documents, and which documents are no prose.

Every document gets its statistics: word count, mean word length, symbol ratio,
share of lines ending in punctuation, share of common words. For the greater
part of it (the median over its lines, a line weighing as the square root of
its length, which stands between counting lines and counting characters) it
further gets how short its lines are (one over their words), the length of
words, the share of symbols and of common words, the cells a word, and how
periodic its words are.

For every language the centre and scatter of prose are estimated robustly from
all documents: it starts from medians and mean deviations from them (median
deviations are 0 where most prose is alike, as in how lines end) and
concentrates, each step taking mean and covariance of the documents within CORE
of the last, until that set stands still. A document's squared Mahalanobis distance, less where there is little
text to tell from, is the sum of its statistics' contributions. Beyond CUTOFF
it is no prose, and the statistics that are beyond prose name the kind: the
cells a word make a table, short lines a list, anything else junk.

A document's language is the one whose common words it uses most (ties and
documents without any: its own language tag's first two letters, else "en"), as
tags may be missing or wrong. Null, empty and blank texts have null statistics
and no kind; a repeated doc_id is one row each time. A language of fewer than
LEAST_DOCS documents is held against all languages together; fewer than that in
all give null distances and no kinds.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.text import alnum_counts, chunks, token_hashes
from tallywright.session import cut

#: Statistics in the distance, in order.
STATS = ("log_words", "short_lines", "word_length", "symbols", "common", "cells", "punct_lines", "period")
#: Squared distance within which a document belongs to the prose that a step takes its moments from (chi-squared, 8 degrees of freedom, 0.9999).
CORE = 31.8
#: Squared distance beyond which a document is no prose; prose has heavier tails than a normal distribution.
CUTOFF = 60.0
#: Characters at which a squared distance counts by half.
FEW_CHARS = 75.0
STEPS, LEAST_DOCS = 10, 50
#: Words of a window; longest period looked for.
WINDOW, PERIODS = 64, 12
#: Of fewer words a period is no sign.
PERIOD_WORDS = 64
#: Where the share of words that stood a period before, the share of symbols and the letters a word end being those of lists and tables.
ENDLESS, MERE_SYMBOLS, LONG_WORD = 0.8, 0.5, 12.0

_ENDS = frozenset(".!?…:;\"'»”’)")
_DELIMITER = np.isin(np.arange(256), [ord(c) for c in "|\t;,"])


class _Common:
    """Hashes of the common words with a bit for each language that has them."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in pairs}) or ["en"]
        at, h = token_hashes([w for _, w in pairs])
        self.hash, where = np.unique(h, return_inverse=True)
        self.bits = np.zeros((len(self.hash), len(self.langs)), np.int64)
        if len(h):
            self.bits[where, [self.langs.index(pairs[i][0]) for i in at]] = 1


def _median(v: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Weighted median of the values of each of n owners (sorted); the middle of the two where it lies between them; 0 for owners without any."""
    if not len(v):
        return np.zeros(n)
    order = np.lexsort((v, owner))
    v, weight = v[order], weight[order].astype(float)
    total = np.cumsum(weight)
    ends = np.cumsum(np.bincount(owner, minlength=n))
    before = np.append(0, total)[np.append(0, ends[:-1])]
    half = (before + np.append(0, total)[ends]) / 2
    low = np.searchsorted(total, half - 1e-9 * np.maximum(half, 1), side="left")
    high = np.searchsorted(total, half + 1e-9 * np.maximum(half, 1), side="right")
    some = ends > np.append(0, ends[:-1])
    low, high = np.minimum(low, len(v) - 1), np.minimum(high, len(v) - 1)
    return np.where(some, (v[low] + v[np.minimum(high, np.maximum(ends - 1, 0))]) / 2, 0.0)


def _visible(lines: list[str]) -> list[str]:
    """Lines without format characters and combining marks, any white space as a blank; tabs stay."""
    joined = "\x00".join(s.replace("\x00", " ") for s in lines)
    for c in set(joined):
        if c > "\x7f":
            if c.isspace():
                joined = joined.replace(c, " ")
            elif unicodedata.category(c) in ("Cf", "Mn"):
                joined = joined.replace(c, "")
    return joined.split("\x00") if lines else []


def _layout(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Visible characters, all characters and inner delimiters (bars, tabs, commas, semicolons, gaps of blanks) of each line."""
    if not lines:
        return (np.zeros(0, np.int64),) * 3
    raw = np.frombuffer(("\x00".join(lines) + "\x00").encode("utf-8", "surrogatepass"), np.uint8)
    end = np.flatnonzero(raw == 0)
    start = np.append(0, end[:-1] + 1)

    def count(mask: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(mask))
        return upto[end] - upto[start]

    first_byte = (raw & 0xC0) != 0x80
    bare = np.array([len(s.rstrip(" ;,.|").encode("utf-8", "surrogatepass")) for s in lines])
    inner = np.arange(len(raw)) < np.repeat(start + bare, end - start + 1)
    blank = raw == 32
    gap = blank & np.append(blank[1:], False) & ~np.append(False, blank[:-1])
    return count((raw > 32) & first_byte), count((raw > 0) & first_byte), count(inner & (_DELIMITER[raw] | gap))


def _period(doc: np.ndarray, h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document, in its median window: the share of words that stood a fixed number of words before, of PERIOD_WORDS at least and as it is."""
    n = len(words)
    windows = -(-words // WINDOW)
    first = np.cumsum(windows) - windows
    at = np.arange(len(h)) - (np.cumsum(words) - words)[doc]
    window = first[doc] + at // WINDOW
    size = np.bincount(window, minlength=windows.sum())
    most, echo = np.zeros(len(size)), np.zeros(len(size))
    for p in range(1, PERIODS + 1):
        same = np.zeros(len(h), bool)
        same[p:] = (h[p:] == h[:-p]) & (window[p:] == window[:-p])
        found = np.bincount(window, same, minlength=len(size))
        most, echo = np.maximum(most, found / np.maximum(size - p, PERIOD_WORDS)), np.maximum(echo, found / np.maximum(size - p, 1))
    owner = np.repeat(np.arange(n), windows)
    return _median(most, size, owner, n), _median(echo, size, owner, n)


def _batch(texts: list[str | None], tags: list[str | None], common: _Common) -> dict[str, np.ndarray | list]:
    n, lines, owner = len(texts), [], []
    for i, t in enumerate(texts):
        if t:
            mine = [s for s in map(str.strip, t.splitlines()) if s]
            lines += mine
            owner += [i] * len(mine)
    owner = np.array(owner, np.int64)
    row, h = token_hashes(lines)
    words = np.bincount(row, minlength=len(lines))
    hits = np.zeros((len(lines), len(common.langs)), np.int64)
    if len(common.hash) and len(h):
        at = np.searchsorted(common.hash, h)
        at[at == len(common.hash)] = 0
        known = np.flatnonzero(common.hash[at] == h)
        for k in range(len(common.langs)):
            hits[:, k] = np.bincount(row[known], common.bits[at[known], k], minlength=len(lines))
    visible, size, delimiters = _layout(_visible(lines))
    letters = alnum_counts(lines)
    symbols = np.maximum(visible - letters, 0)
    best = hits.max(axis=1) if len(lines) else np.zeros(0, np.int64)  # lines of another language, as quotations, count by their own
    total = lambda x: np.bincount(owner, x, minlength=n)
    by_doc = np.stack([total(hits[:, k]) for k in range(len(common.langs))], 1)
    doc_words, doc_visible, doc_lines = total(words).astype(np.int64), total(visible), np.bincount(owner, minlength=n)
    langs = []
    for tag, mine in zip(tags, by_doc):
        tag = (tag or "").lower()[:2]
        ties = [common.langs[k] for k in np.flatnonzero(mine == mine.max())]
        langs.append(tag if tag in ties else "en" if mine.max() == 0 else ties[0])
    part = {
        "short_lines": 1 / np.maximum(words, 1), "word_length": letters / np.maximum(words, 1), "symbols": symbols / np.maximum(visible, 1),
        "common": best / np.maximum(words, 1), "cells": np.minimum(delimiters / (words + 1), 1.0),
    }
    weight = np.sqrt(size)
    out = {k: _median(v, weight, owner, n) for k, v in part.items()}
    ends = np.array([s[-1] in _ENDS for s in lines], float)
    period, echo = _period(owner[row], h, doc_words)
    return out | {
        "lang": langs, "word_count": doc_words, "mean_word_length": total(letters) / np.maximum(doc_words, 1), "symbol_ratio": total(symbols) / np.maximum(doc_visible, 1),
        "punct_lines": total(ends) / np.maximum(doc_lines, 1), "common_words": total(best) / np.maximum(doc_words, 1), "lines": doc_lines, "visible": doc_visible.astype(np.int64),
        "known_words": by_doc.max(axis=1).astype(np.int64), "log_words": np.log1p(doc_words), "period": period, "echo": echo,
    }


_KINDS = {
    "lang": "string", "word_count": "bigint", "mean_word_length": "double", "symbol_ratio": "double", "punct_lines": "double", "common_words": "double", "lines": "bigint",
    "visible": "bigint", "known_words": "bigint", "log_words": "double", "short_lines": "double", "word_length": "double", "symbols": "double", "common": "double", "cells": "double", "period": "double", "echo": "double",
}
SCHEMA = "doc_id bigint, " + ", ".join(f"{k} {v}" for k, v in _KINDS.items())
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}


def _statistics(common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, tags = b.column(1).to_pylist(), b.column(2).to_pylist()
            for lo, hi in chunks(texts):
                got = _batch(texts[lo:hi], tags[lo:hi], common.value)
                blank = got["lines"] == 0
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), *(pa.array(got[k], _ARROW[kind], mask=blank) for k, kind in _KINDS.items())], ["doc_id", *_KINDS]
                )

    return run


def statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row of statistics a document; one narrow pass. common_words is small (a few hundred words a language)."""
    pairs = [(r["lang"], r["word"]) for r in common_words.where("lang is not null and word is not null").select("lang", "word").distinct().collect()]
    shared = documents.sparkSession.sparkContext.broadcast(_Common(pairs))
    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(_statistics(shared), SCHEMA)


class Prose:
    """Centre, inverse scatter and spreads of prose by language (a few numbers a language); "" stands for all of them."""

    def __init__(self) -> None:
        self.center: dict[str, np.ndarray] = {}
        self.inverse: dict[str, np.ndarray] = {}
        self.spread: dict[str, np.ndarray] = {}

    def put(self, lang: str, center: np.ndarray, cov: np.ndarray) -> None:
        self.center[lang], self.inverse[lang], self.spread[lang] = center, np.linalg.inv(cov), np.sqrt(np.diag(cov))

    def contributions(self, lang: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Each statistic's share of the squared distance; NaN where no prose is known."""
        parts = np.full(x.shape, np.nan)
        for k in set(lang.tolist()):
            use = k if k in self.center else ""
            if use in self.center:
                m = lang == k
                d = x[m] - self.center[use]
                parts[m] = d * (d @ self.inverse[use])
        return parts


def _matrix(b: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([b.column(first + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(STATS))], 1)


def _moments(prose: Prose, alone: frozenset[str]):
    """Arrow kernel: sums of products of the documents within CORE, by language and for all languages together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            lang, x = np.array(b.column(0).to_pylist(), object), _matrix(b, 1)
            for group in (lang, np.full(len(lang), "", object)):
                near = prose.contributions(group, x).sum(1) <= CORE
                for k in set(group.tolist()) & alone:
                    m = near & (group == k)
                    z = np.column_stack([np.ones(m.sum()), x[m]])
                    sums[k] = sums.get(k, 0) + z.T @ z
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * s.size), pa.array(np.arange(s.size, dtype=np.int32)), pa.array(s.reshape(-1))], ["lang", "cell", "v"])

    return run


def fit_prose(stats: DataFrame) -> Prose:
    """Robust centre and scatter of each language over all documents with common words.

    A statistic's variance gets a hundredth of its mean deviation over all
    documents, squared, so that one which prose never varies in keeps a finite
    weight.
    """
    x = stats.where("known_words > 0").select("lang", *STATS)
    every = x.select(F.explode(F.array("lang", F.lit(""))).alias("lang"), *STATS)
    middle = {r["lang"]: r for r in every.groupBy("lang").agg(F.count("*").alias("n"), *[F.percentile_approx(s, 0.5, 10000).alias(s) for s in STATS]).collect()}
    known = {k: np.array([r[s] for s in STATS]) for k, r in middle.items() if r["n"] >= LEAST_DOCS}
    prose = Prose()
    if not known:
        return prose
    center = F.create_map(*[c for k, m in known.items() for c in (F.lit(k), F.array(*[F.lit(float(v)) for v in m]))])
    away = [F.abs(F.col(s) - center[F.col("lang")][j]) for j, s in enumerate(STATS)]
    wide = every.where(F.col("lang").isin(list(known))).groupBy("lang").agg(
        *[F.avg(d).alias(f"a{j}") for j, d in enumerate(away)]
    )
    ridge = {}
    for r in wide.collect():
        mean = np.array([r[f"a{j}"] for j in range(len(STATS))])
        ridge[r["lang"]] = np.diag(np.maximum(0.01 * mean, 1e-6) ** 2)
        prose.put(r["lang"], known[r["lang"]], np.diag((1.2533 * mean) ** 2) + ridge[r["lang"]])
    size, before = len(STATS) + 1, {}
    moving = set(known)
    for _ in range(STEPS):
        got: dict[str, np.ndarray] = {k: np.zeros(size * size) for k in moving}
        for r in x.mapInArrow(_moments(prose, frozenset(moving)), "lang string, cell int, v double").groupBy("lang", "cell").agg(F.sum("v").alias("v")).collect():
            got[r["lang"]][r["cell"]] = r["v"]
        for k, s in got.items():
            s = s.reshape(size, size)
            if s[0, 0] < LEAST_DOCS / 2 or before.get(k) == s[0, 0]:
                moving.discard(k)
                continue
            before[k] = s[0, 0]
            mean = s[0, 1:] / s[0, 0]
            prose.put(k, mean, s[1:, 1:] / s[0, 0] - np.outer(mean, mean) + ridge[k])
        if not moving:
            break
    return prose


def kinds(center: np.ndarray, spread: np.ndarray, x: np.ndarray, echo: np.ndarray) -> np.ndarray:
    """list, table or junk of documents that are no prose.

    Endless repetition, mere symbols and runs of characters longer than words
    are junk by definition. Of the rest, more cells a word than prose ever has
    make a table, shorter lines than prose ever has a list; what is neither is
    junk.
    """
    at = {s: k for k, s in enumerate(STATS)}
    own = (x - center) / spread
    far = own**2 > CORE
    none = (echo > ENDLESS) | (x[:, at["symbols"]] > MERE_SYMBOLS) | (x[:, at["word_length"]] > LONG_WORD)
    table, short = far[:, at["cells"]] & (own[:, at["cells"]] > 0), far[:, at["short_lines"]] & (own[:, at["short_lines"]] > 0)
    return np.where(none, "junk", np.where(table, "table", np.where(short, "list", "junk")))


def _judge(prose: Prose):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, x = np.array(b.column(1).to_pylist(), object), np.nan_to_num(_matrix(b, 2))
            visible = np.nan_to_num(b.column(2 + len(STATS)).to_numpy(zero_copy_only=False).astype(float))
            parts = prose.contributions(lang, x) * (visible / (visible + FEW_CHARS))[:, None]
            parts[np.equal(lang, None)] = np.nan
            d = parts.sum(1)
            at = np.flatnonzero(d > CUTOFF)
            kind = np.full(len(d), None, object)
            if len(at):
                use = [k if k in prose.center else "" for k in lang[at]]
                echo = b.column(3 + len(STATS)).to_numpy(zero_copy_only=False)[at]
                kind[at] = kinds(np.stack([prose.center[k] for k in use]), np.stack([prose.spread[k] for k in use]), x[at], echo)
            none = np.isnan(d)
            shares = pa.StructArray.from_arrays([pa.array(parts[:, k], pa.float64(), mask=none) for k in range(len(STATS))], list(STATS), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.float64(), mask=none), shares, pa.array(kind.tolist(), pa.string())], ["doc_id", "lang", "distance", "contributions", "kind"])

    return run


def judged(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, lang, distance, contributions, kind): squared distance from prose, each statistic's part of it, and kind (null: prose)."""
    stats = cut(statistics(documents, common_words))
    shares = ", ".join(f"{s}: double" for s in STATS)
    return stats.select("doc_id", "lang", *STATS, "visible", "echo").mapInArrow(
        _judge(fit_prose(stats)), f"doc_id bigint, lang string, distance double, contributions struct<{shares}>, kind string"
    )


def no_prose(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, kind): documents that are mainly list, table or junk."""
    return judged(documents, common_words).where("kind is not null and doc_id is not null").select("doc_id", "kind").distinct()
