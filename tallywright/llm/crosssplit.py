"""Evaluation rows that repeat or nearly repeat a training row: a passage scan.

The normal form of a row is the sequence of its distinct words in one global
order, rare words first and the frequent ones in an arbitrary fixed order that
parts the words of stock phrases, each word written as a few letters, so order and
repetition of words in the text do not matter. An evaluation row of n words is
cut into reach(n, t) + 1 passages of that sequence. A training row that
overlaps by t or more differs in at most reach(n, t) words, and one word that
is missing or put in between breaks one passage only, so at least one passage
stands whole in the training row's normal form. Passages of rare words are one
word long, those of frequent words as long as it takes to be selective.

The passages are sharded by evaluation row. One shard at a time, of at most
SHARD_PASSAGES passages, is sent to all tasks, which build an Aho-Corasick
automaton of it and scan the normal forms of all training rows, in one narrow
pass a shard. A passage may be found anywhere in a training row; the intervals
matched there are merged into the number of covered words of each evaluation
row and training row. What sizes and signatures do not rule out is checked on
the whole word sets.

Where the evaluation side is so large that it would take more than
BROADCAST_SHARDS passes, both sides go to shards by their first words instead:
passages, and of each training row the parts that start with words of the shard.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.text import chunks, mix64
from tallywright.llm.neardup import _members, _sets_of
from tallywright.llm.wordsets import Frequency, Sets, allowed, bucket, current_thresholds, i64, reach, u64
from tallywright.session import broadcast_if_small, cut

#: A passage is lengthened until it is expected in this many rows.
PASSAGE_ROWS = 16
#: Most words of a passage; of a longer or heavier one its beginning is searched.
PASSAGE_WORDS = 7
#: Passages in one automaton (about 150 MB).
SHARD_PASSAGES = 800_000
#: Passes over the training rows, each with a shard of passages, before both sides are shuffled to shards.
BROADCAST_SHARDS = 16
#: Training rows a task scans at most.
TASK_ROWS = 2_000_000
#: Code points scanned, and pairs compared, at a time.
SCAN_CHARS, SCAN_PAIRS = 2_000_000, 2_000_000
BROADCAST_IDS = 1_000_000
#: Characters behind passages: blank + rank + 1 (high ranks are lowered), below those of words.
_GAP, _RANKS = 32, 32


_SPLIT = re.compile("([@-\x7f]+)([ -?])")


class _Sequences:
    """Normal forms of a batch: words of each row in the global order, with their letters and weights."""

    def __init__(self, sets: Sets, freq: Frequency, shards: int):
        b = bucket(sets.h)
        nats = freq.nats[b]
        # rare words first; the others by hash, as words of a stock phrase are about equally frequent
        order = np.lexsort((mix64(sets.h), freq.frequent[b], sets.row))
        self.row, h, self.nats = sets.row, sets.h[order], nats[order].astype(np.float64)
        often = freq.frequent[b[order]]
        self.lone = ~often
        self.rare = np.bincount(sets.row[~often], minlength=len(sets.n))
        # Six-bit digits: three for a frequent word, six for a rare one; the first digit tells which.
        head = np.where(often, 0x40, 0x60) + (h >> np.uint64(59)).astype(np.int64)
        tail = [0x40 + ((h >> np.uint64(59 - 6 * k)) & np.uint64(63)).astype(np.int64) for k in range(1, 6)]
        self.chars = np.stack([head, *tail], 1).astype(np.uint8)
        self.chars[often, 3:] = 0
        total = np.cumsum(self.nats)
        self.before = total - self.nats
        self.before -= np.repeat(self.before[sets.first[sets.n > 0]], sets.n[sets.n > 0]) if len(h) else 0
        self.end = (sets.first + sets.n)[self.row]
        # by the first word if a passage has one word, else by the first two, so a frequent word has many shards
        after, follow = np.append(h[1:], np.uint64(0)), np.append(self.nats[1:], 0.0)
        with np.errstate(over="ignore"):
            pair = mix64(h) * np.uint64(3) + mix64(after ^ np.uint64(0x9E3779B97F4A7C15))
        self.shard = np.stack([mix64(h) % np.uint64(shards), mix64(pair) % np.uint64(shards)]).astype(np.int64)
        self.salts = np.maximum(1, np.ceil(np.exp(-np.stack([self.nats, self.nats + follow])) * shards / 16)).astype(np.int64)

    def strings(self, owner: np.ndarray, at: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Joins the passages (at, length) of each owner (sorted) by their ranks: the owners and their strings.

        A rank stands behind its passage as a character that no word has."""
        if not len(at):
            return np.zeros(0, np.int64), []
        span = length + 1
        inner = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
        which = np.repeat(np.arange(len(at)), span)
        gap = inner == length[which]
        word = np.where(gap, 0, at[which] + inner)
        chars = self.chars[word]
        chars[gap] = 0
        chars[gap, 0] = rank[which[gap]]
        size = (chars != 0).sum(1)
        text = chars.reshape(-1)
        text = text[text != 0].tobytes().decode("ascii")
        upto = np.cumsum(size)[np.cumsum(span) - 1]
        last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
        ends = upto[last].tolist()
        return owner[last], [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _passages(s: _Sequences, sets: Sets, need: np.ndarray, same: np.ndarray, enough: float):
    """(at, length, rank) of need[row] passages of each row of s.

    Rare words are passages by themselves. The frequent words are cut, in
    order, into what is still needed: as many good passages (of weight
    ``enough``, if there is as much) as partners of the same size and as many
    rare words call for (``same``), the rest from what is left.
    """
    n, rare, first = sets.n, s.rare, sets.first
    late = np.maximum(need - rare, 0)
    good = np.clip(same - 2 * rare, 1, np.maximum(late, 1))
    total = np.bincount(s.row, s.nats * ~s.lone, minlength=len(n))
    words = n - rare
    late = np.minimum(late, words)
    target1 = np.minimum(enough, total / np.maximum(good + 0.5 * (late - good), 1))
    order = np.argsort(-words, kind="stable")
    order = order[late[order] > 0]
    done, acc, left, begin = (np.zeros(len(n), x) for x in (np.int64, np.float64, np.float64, np.int64))
    left += total
    at, length, rank = [], [], []
    for step in range(int(words[order].max()) if len(order) else 0):
        rows = order[: np.searchsorted(-words[order], -step, side="left")]
        rows = rows[done[rows] < late[rows]]
        if not len(rows):
            break
        here = first[rows] + rare[rows] + step
        acc[rows] += s.nats[here]
        still = late[rows] - done[rows]
        goal = np.where(done[rows] < good[rows], target1[rows], left[rows] / still)
        cut_now = (acc[rows] >= goal - 1e-9) | (words[rows] - step - 1 < still)
        rows, here = rows[cut_now], here[cut_now]
        at.append(first[rows] + rare[rows] + begin[rows])
        length.append(step + 1 - begin[rows])
        rank.append(done[rows].copy())
        left[rows] -= acc[rows]
        acc[rows] = 0
        begin[rows] = step + 1
        done[rows] += 1
    place = np.arange(len(s.row)) - first[s.row]
    single = np.flatnonzero(s.lone & (place < need[s.row]))
    at = np.concatenate([single, *at])
    length = np.concatenate([np.ones(len(single), np.int64), *length])
    rank = np.concatenate([np.full(len(single), -1), *rank])
    # what is left may weigh more than enough: the beginning that fits a window stands for the whole
    return at, np.minimum(length, _windows(s, enough)[1][at]), rank


def _windows(s: _Sequences, enough: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, length, rank): from each word until the weight is ``enough``, PASSAGE_WORDS at most: as far as a passage that starts there can go."""
    at = np.arange(len(s.row))
    length = np.ones(len(at), np.int64)
    for step in range(1, PASSAGE_WORDS):
        ahead = at + step
        ok = ahead < s.end
        ok[ok] = s.before[ahead[ok]] - s.before[at[ok]] < enough - 1e-9
        length += ok
    return at, length, np.full(len(at), -1)


def _spread(splits: list[str], limits: list[float], train: str, freq: Frequency, shards: int):
    """Arrow kernel: (row_id, split, text) -> passages (kind 0) and scanned parts (kind 1) by shard, once a class and task."""
    enough = float(np.log(max(freq.rows / PASSAGE_ROWS, 2.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_of, seen = {s: i for i, s in enumerate(splits)} | {train: len(splits)}, set()
        for b in batches:
            code = np.array([code_of.get(s, -1) for s in b.column(1).to_pylist()], np.int64)
            texts = b.column(2).to_pylist()
            sets = Sets(texts)
            fresh = _fresh(code, sets, seen)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            s = _Sequences(sets, freq, shards)
            limit = np.array([*limits, 1.0])[code]
            need, same = reach(sets.n, limit) + 1, allowed(sets.n, sets.n, limit) + 1
            for kind, mine in ((0, fresh & (code < len(splits))), (1, fresh & (code == len(splits)))):
                at, length, rank = _passages(s, sets, need, same, enough) if kind == 0 else _windows(s, enough + 1e-6)  # sums differ in their last digits
                ok = mine[s.row[at]]
                at, length, rank = at[ok], length[ok], rank[ok]
                if kind == 1:  # passages of one word and longer ones have shards of their own
                    long = length > 1
                    at, length = np.concatenate([at, at[long]]), np.concatenate([np.ones(len(at), np.int64), length[long]])
                    rank = np.full(len(at), -1)
                by = (length > 1).astype(np.int64)
                if kind == 0:  # to every salt of its first words
                    salts = s.salts[by, at]
                    salt = np.arange(salts.sum()) - np.repeat(np.cumsum(salts) - salts, salts)
                    at, length, rank, by = (np.repeat(x, salts) for x in (at, length, rank, by))
                else:
                    salt = ids[s.row[at]].astype(np.int64) % s.salts[by, at]
                shard = (s.shard[by, at] + salt * 7919) % shards
                owner = s.row[at] * shards + shard
                order = np.argsort(owner, kind="stable")
                owner, strings = s.strings(owner[order], at[order], length[order], np.minimum(rank[order] + 1, _RANKS - 1) + _GAP)
                row = owner // shards
                yield pa.RecordBatch.from_arrays(
                    [pa.array((owner % shards * 2 + kind).astype(np.int32)), i64(ids[row]), i64(sets.n[row] << 32 | np.minimum(s.rare[row], 0xFFFF) << 16 | code[row]), i64(sets.sig[row]), pa.array(strings, pa.string())],
                    ["part", "row_id", "meta", "sig", "passages"],
                )

    return run


def _prepare(splits: list[str], limits: list[float], train: str, freq: Frequency):
    """Arrow kernel: (row_id, split, text) -> passages of evaluation rows (kind 0), normal forms of training rows (kind 1), once a class and task."""
    enough = float(np.log(max(freq.rows / PASSAGE_ROWS, 2.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_of, seen = {s: i for i, s in enumerate(splits)} | {train: len(splits)}, set()
        for b in batches:
            code = np.array([code_of.get(s, -1) for s in b.column(1).to_pylist()], np.int64)
            sets = Sets(b.column(2).to_pylist())
            fresh = _fresh(code, sets, seen)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            s = _Sequences(sets, freq, 1)
            meta = sets.n << 32 | np.minimum(s.rare, 0xFFFF) << 16 | code
            limit = np.array([*limits, 1.0])[code]
            at, length, rank = _passages(s, sets, reach(sets.n, limit) + 1, allowed(sets.n, sets.n, limit) + 1, enough)
            ok = np.flatnonzero((fresh & (code < len(splits)))[s.row[at]])
            ok = ok[np.argsort(s.row[at[ok]], kind="stable")]
            row, strings = s.strings(s.row[at[ok]], at[ok], length[ok], np.minimum(rank[ok] + 1, _RANKS - 1) + _GAP)
            size = np.bincount(s.row, (s.chars != 0).sum(1), minlength=len(code)).astype(np.int64)
            end, text = np.cumsum(size), s.chars.reshape(-1)
            text = text[text != 0].tobytes().decode("ascii")
            normal = lambda row: [text[e - z : e] for e, z in zip(end[row].tolist(), size[row].tolist())]
            yield _prepared(0, ids, meta, sets, row, np.bincount(s.row[at[ok]], minlength=len(code))[row], strings, normal(row))
            row = np.flatnonzero(fresh & (code == len(splits)) & (sets.n > 0))
            yield _prepared(1, ids, meta, sets, row, sets.n[row], [None] * len(row), normal(row))

    return run


def _prepared(kind: int, ids, meta, sets: Sets, row: np.ndarray, parts: np.ndarray, strings: list, normal: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(row), kind, np.int32)), i64(ids[row]), i64(meta[row]), i64(sets.sig[row]), pa.array(parts.astype(np.int32)), pa.array(strings, pa.string()), pa.array(normal, pa.string())],
        ["kind", "row_id", "meta", "sig", "parts", "passages", "normal"],
    )


def _fresh(code: np.ndarray, sets: Sets, seen: set) -> np.ndarray:
    """Rows of a known split whose split and word set this task has not had yet."""
    fresh = np.zeros(len(code), bool)
    for i, k in enumerate(zip(code.tolist(), sets.ident.tolist())):
        if k not in seen and k[0] >= 0:
            seen.add(k)
            fresh[i] = True
    return fresh


#: The automaton a Python worker built last: tasks of one shard follow each other.
_LAST: dict[str, _Automaton] = {}


def _built(key: str, shard, limits: list[float]) -> _Automaton:
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = _Automaton(*shard.value[:4], np.array(limits), shard.value[4])
    return _LAST[key]


def _scan_all(shard, key: str, limits: list[float]):
    """Arrow kernel over normal forms of training rows: the pairs that a broadcast shard of passages finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _built(key, shard, limits)
        for b in batches:
            ids, meta, sig, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), u64(b.column(2)), b.column(3).to_pylist()
            for lo, hi in chunks(texts, SCAN_CHARS):
                yield from automaton.scan(texts[lo:hi], ids[lo:hi], meta[lo:hi], sig[lo:hi], whole=True)

    return run


class _Automaton:
    """Aho-Corasick automaton over the passages of one shard."""

    def __init__(self, ids: list, meta: list, sig: list, passages: list[list[str]], limit: np.ndarray, normal: list[str] | None = None):
        import ahocorasick

        self.ids, self.sig = np.concatenate(ids), np.concatenate(sig)
        meta = np.concatenate(meta)
        self.n, rare, self.code = meta >> 32, meta >> 16 & 0xFFFF, meta & 0xFFFF
        found = [_SPLIT.findall(t) for batch in passages for t in batch]
        holder = np.repeat(np.arange(len(found)), [len(x) for x in found])
        which, index = pd.factorize(np.array([p for x in found for p, _ in x], object))
        ranks = np.frombuffer("".join([r for x in found for _, r in x]).encode("ascii"), np.uint8).astype(np.int64) - _GAP - 1
        self.trie = ahocorasick.Automaton()
        for i, p in enumerate(index):
            self.trie.add_word(p, i)
        self.trie.make_automaton()
        self.size = np.array([len(p) for p in index], np.int64)
        self.words = np.array([1 if p[0] >= "`" else len(p) // 3 for p in index], np.int64)
        # A passage of rank k is needed only for training rows with k < allowed + 1 - rare - their rare words,
        # as rare words that match are found by themselves: postings by code and by what they call for.
        self.limit, self.codes = limit, len(limit)
        self.slope = (1 - limit) / (1 + limit)
        code = self.code[holder]
        call = np.where(ranks < 0, -1e6, ranks + rare[holder] - self.slope[code] * self.n[holder])
        cell = which * self.codes + code
        order = np.lexsort((call, cell))
        self.posting = holder[order]
        self.sorted = cell[order] * 1e8 + call[order]
        self.first = np.searchsorted(cell[order], np.arange(len(index) * self.codes + 1))
        self.word_first, self.word = _words_of(normal, self.n, rare) if normal is not None else (None, None)

    def scan(self, texts: list[str], ids, meta, sig, whole: bool = False) -> Iterator[pa.RecordBatch]:
        """Pairs found in texts: whole normal forms, or parts of them that begin where a passage may."""
        joined = chr(_GAP) + "".join(t + chr(_GAP) if whole else t for t in texts)
        hits = np.fromiter(self.trie.iter(joined), "i8,i8").view(np.int64).reshape(-1, 2)
        if not len(hits):
            return
        n, rare = meta >> 32, meta >> 16 & 0xFFFF
        words_of = _words_of(texts, n, rare) if whole else None
        start = hits[:, 0] - self.size[hits[:, 1]]
        ends = np.cumsum([len(t) + whole for t in texts])
        row = np.searchsorted(ends, hits[:, 0] - 1, side="right")
        if whole:  # rare words have six letters and come first, the others three; a hit within a word is none
            inside = start - np.append(0, ends)[row]
            late = inside - 6 * rare[row]
            word = np.where(late < 0, inside // 6, rare[row] + late // 3)
            ok = np.where(late < 0, inside % 6, late % 3) == 0
            hits, row, word = hits[ok], row[ok], word[ok]
        else:
            hits, row = (x[np.frombuffer(joined.encode("ascii"), np.uint8)[start] == _GAP] for x in (hits, row))
            once = np.unique(hits[:, 1] * len(texts) + row, return_index=True)[1]
            hits, row = hits[once], row[once]
            word = np.full(len(hits), -1)
        for code in range(self.codes):
            cell = hits[:, 1] * self.codes + code
            some = np.flatnonzero(self.first[cell + 1] > self.first[cell])
            offer = 1 + self.slope[code] * n[row[some]] - rare[row[some]] + 1e-6
            count = np.maximum(np.searchsorted(self.sorted, cell[some] * 1e8 + offer) - self.first[cell[some]], 0)
            some, count = some[count > 0], count[count > 0]
            total, lo = np.cumsum(count), 0
            while lo < len(some):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SCAN_PAIRS, side="right")))
                x = some[lo:hi]
                yield from self._pairs(self.first[cell[x]], count[lo:hi], word[x], self.words[hits[x, 1]], row[x], ids, n, sig, self.limit[code], words_of)
                lo = hi

    def _pairs(self, first, c, word, words, row, ids, n, sig, t, words_of) -> Iterator[pa.RecordBatch]:
        at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        e, row = self.posting[np.repeat(first, c) + at], np.repeat(row, c)
        apart = np.bitwise_count(self.sig[e] ^ sig[row])
        ok = (apart <= (1 - t) / (1 + t) * (self.n[e] + n[row]) + 1e-6) & (np.minimum(self.n[e], n[row]) >= t * np.maximum(self.n[e], n[row]) - 1e-9)
        e, row, word, words = e[ok], row[ok], np.repeat(word, c)[ok], np.repeat(words, c)[ok]
        if len(e):
            key, which = np.unique(e * len(ids) + row, return_inverse=True)
            e, row, size = key // len(ids), key % len(ids), covered(which, word, words, len(key))
            if words_of is not None:
                both = _common(self.word_first, self.word, e, *words_of, row)
                ok = (both >= t / (1 + t) * (self.n[e] + n[row]) - 1e-6) | (np.minimum(self.n[e], n[row]) >= 0xFFFF)
                e, row, size = e[ok], row[ok], size[ok]
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.code[e].astype(np.int32)), i64(self.ids[e]), i64(ids[row]), i64(size)], ["code", "row_id", "train_id", "covered"]
            )


def _words_of(normal: list[str], n: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, word): the words of normal forms as numbers by their letters; different words seldom have the same."""
    chars = np.frombuffer("".join(normal).encode("ascii"), np.uint8).astype(np.int64) & 63
    start = np.cumsum([0, *map(len, normal)])[:-1]
    first = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - first[row]
    late = place >= rare[row]
    at = start[row] + np.where(late, 3 * place + 3 * rare[row], 6 * place)
    chars = np.append(chars, np.zeros(6, np.int64))
    word = (chars[at] << 12) | (chars[at + 1] << 6) | chars[at + 2]
    return np.append(first, len(row)), np.where(late, word, (1 << 36) | (word << 18) | (chars[at + 3] << 12) | (chars[at + 4] << 6) | chars[at + 5])


def _common(first_a, word_a, a, first_b, word_b, b) -> np.ndarray:
    """At least the number of words that rows a and b of each pair have in common (more where different words have the same letters)."""
    out = np.zeros(len(a), np.int64)
    size = (first_a[a + 1] - first_a[a]) + (first_b[b + 1] - first_b[b])
    cut_at = np.searchsorted(np.cumsum(size), np.arange(SCAN_PAIRS, size.sum() + SCAN_PAIRS, SCAN_PAIRS), side="right")
    for lo, hi in zip([0, *cut_at], [*cut_at, len(a)]):
        if lo >= hi:
            continue
        keys = []
        for first, word, x in ((first_a, word_a, a[lo:hi]), (first_b, word_b, b[lo:hi])):
            span = first[x + 1] - first[x]
            which = np.repeat(np.arange(len(x)), span)
            at = np.arange(len(which)) - (np.cumsum(span) - span)[which] + first[x][which]
            keys.append(which << 37 | word[at])
        # on either side a word counts once; words of one row with the same letters may hide one in common, so they are added
        one, more = zip(*(np.unique(k, return_counts=True) for k in keys))
        both, at_a, at_b = np.intersect1d(*one, assume_unique=True, return_indices=True)
        out[lo:hi] = np.bincount(both >> 37, np.minimum(more[0][at_a], more[1][at_b]), minlength=hi - lo)
    return out


def covered(pair: np.ndarray, word: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Words of each pair's training row in the union of its intervals (word, words); intervals without a place (-1) are apart."""
    order = np.lexsort((word, pair))
    pair, word, words = pair[order], word[order], words[order]
    end = word + words
    # the furthest end of the pair's earlier intervals: ends rise by pair, so a running maximum does not leave a pair
    far = np.maximum.accumulate(end + pair * (1 << 40)) - pair * (1 << 40)
    before = np.append(0, far[:-1])
    before[np.append(True, pair[1:] != pair[:-1])] = 0
    new = np.where(word < 0, words, np.maximum(end - np.maximum(word, before), 0))
    return np.bincount(pair, new, minlength=n).astype(np.int64)


def _scan(limits: list[float]):
    """Arrow kernel over rows sorted by part: builds each shard's automaton, then scans the training parts with it."""
    limit = np.array(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, automaton, waiting, chars = None, ([], [], [], []), None, ([], [], [], []), 0

        def scan():
            nonlocal waiting, chars
            ids, meta, sig, texts = waiting
            waiting, chars = ([], [], [], []), 0
            if texts and automaton is not None:
                yield from automaton.scan([t for x in texts for t in x], np.concatenate(ids), np.concatenate(meta), np.concatenate(sig))

        for b in batches:
            part = b.column(0).to_numpy()
            edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
            for lo, hi in zip(edge, [*edge[1:], len(part)]):
                piece = (b.column(1).to_numpy()[lo:hi], b.column(2).to_numpy()[lo:hi], u64(b.column(3))[lo:hi], b.column(4).slice(lo, hi - lo).to_pylist())
                now, kind = divmod(int(part[lo]), 2)
                if now != shard:
                    yield from scan()
                    shard, held, automaton = now, ([], [], [], []), None
                if kind == 0:
                    for x, y in zip(held, piece):
                        x.append(y)
                    continue
                if automaton is None and held[0]:
                    automaton, held = _Automaton(*held, limit), ([], [], [], [])
                if automaton is None:
                    continue
                for x, y in zip(waiting, piece):
                    x.append(y)
                chars += sum(map(len, piece[3]))
                if chars > SCAN_CHARS:
                    yield from scan()
        yield from scan()

    return run


class CrossSplitOverlap:
    """Rows of evaluation splits that overlap with a training row by their split's threshold or more.

    rows: row_id BIGINT, split STRING, text STRING, source STRING; other columns
    are ignored. Null ids and splits and texts without words match nothing; no
    training rows, or an empty table, give empty results.
    """

    def __init__(self, rows: DataFrame, thresholds: dict[str, float], train: str = "train", shard_passages: int = SHARD_PASSAGES, broadcast_shards: int = BROADCAST_SHARDS):
        self.splits = [s for s in thresholds if s != train]
        if len(self.splits) >= 1 << 16:
            raise ValueError("at most 65,535 splits")
        self.shard_passages, self.broadcast_shards = shard_passages, broadcast_shards
        self.limits = [float(thresholds[s]) for s in self.splits]
        self.train, self.all = train, rows
        self.rows = rows.select(F.col("row_id").cast("bigint").alias("row_id"), "split", "text").where(
            F.col("row_id").isNotNull() & F.col("split").isin([*self.splits, train]) & (F.length("text") > 0)
        )
        self._flagged: DataFrame | None = None

    def coverage(self) -> DataFrame:
        """(code, row_id, train_id, covered): words of an evaluation row's passages found in a training row; one row a class on either side and task."""
        freq = Frequency.of(self.rows.select("text"))
        prepared = cut(self.rows.mapInArrow(_prepare(self.splits, self.limits, self.train, freq), "kind int, row_id bigint, meta bigint, sig bigint, parts int, passages string, normal string"))
        wanted = prepared.where("kind = 0").agg(F.sum("parts")).first()[0] or 0
        shards, sc = max(1, -(-wanted // self.shard_passages)), self.rows.sparkSession.sparkContext
        if shards > self.broadcast_shards:
            return self._shuffled(freq, wanted)
        passages = prepared.where("kind = 0").withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards)))
        normal = prepared.where("kind = 1").select("row_id", "meta", "sig", "normal")
        # every task builds the automaton: as few tasks as keep all cores busy, but of TASK_ROWS rows at most
        tasks = max(-(-sc.defaultParallelism // shards), -(-prepared.where("kind = 1").count() // TASK_ROWS))
        normal = normal.coalesce(tasks)
        found = None
        for k in range(shards):
            # at most about SHARD_PASSAGES passages of evaluation rows
            got = passages.where(F.col("shard") == k).select("row_id", "meta", "sig", "passages", "normal").toArrow()
            if not got.num_rows:
                continue
            held = ([got["row_id"].to_numpy()], [got["meta"].to_numpy()], [got["sig"].to_numpy().view(np.uint64)], [got["passages"].to_pylist()], got["normal"].to_pylist())
            part = normal.mapInArrow(_scan_all(sc.broadcast(held), f"{id(self)}-{uuid.uuid4()}", self.limits), "code int, row_id bigint, train_id bigint, covered bigint")
            found = part if found is None else found.unionByName(part)
        if found is None:
            return prepared.where("false").selectExpr("kind as code", "row_id", "row_id as train_id", "row_id as covered")
        # a row's passages are in one shard and a training row in one task, but hits are taken in blocks
        return found.groupBy("code", "row_id", "train_id").agg(F.sum("covered").alias("covered"))

    def _shuffled(self, freq: Frequency, wanted: int) -> DataFrame:
        shards = max(4, -(-wanted // self.shard_passages))
        spread = self.rows.mapInArrow(
            _spread(self.splits, self.limits, self.train, freq, shards), "part int, row_id bigint, meta bigint, sig bigint, passages string"
        )
        found = (
            spread.withColumn("shard", F.shiftright("part", 1))
            .repartitionById(shards, F.col("shard").cast("int"))  # one shard a task
            .drop("shard")
            .sortWithinPartitions("part")
            .mapInArrow(_scan(self.limits), "code int, row_id bigint, train_id bigint, covered bigint")
        )
        return found.groupBy("code", "row_id", "train_id").agg(F.sum("covered").alias("covered"))

    def overlaps(self) -> DataFrame:
        """(code, row_id, train_id, overlap, covered, words): checked pairs of class representatives; covered of the evaluation row's words stand in found passages."""
        pairs = cut(self.coverage())
        ids = cut(pairs.select("row_id").union(pairs.select("train_id")).distinct())
        sets = (
            self.rows.join(broadcast_if_small(ids, ids.count(), BROADCAST_IDS), "row_id", "left_semi")
            .select("row_id", "text")
            .mapInArrow(_sets_of, "row_id bigint, words array<bigint>")
        )
        limit = F.element_at(F.array(*[F.lit(t) for t in self.limits]), F.col("code") + 1)
        return (
            pairs.join(sets.select("row_id", F.col("words").alias("wa")), "row_id")
            .join(sets.select(F.col("row_id").alias("train_id"), F.col("words").alias("wb")), "train_id")
            .withColumn("both", F.size(F.array_intersect("wa", "wb")))
            .withColumn("overlap", F.col("both") / (F.size("wa") + F.size("wb") - F.col("both")))
            .where(F.col("overlap") >= limit)
            .select("code", "row_id", "train_id", "overlap", F.col("covered"), F.size("wa").alias("words"))
        )

    def covered_rows(self) -> DataFrame:
        """(split, row_id, coverage): every evaluation row with an overlapping training row, copies included, and the largest share of its words that passages found in one such row cover."""
        if self._flagged is None:
            if not self.splits:
                return self.rows.where("false").select("split", "row_id", F.lit(0.0).alias("coverage"))
            hits = self.overlaps().groupBy("row_id").agg(F.max(F.col("covered") / F.col("words")).alias("coverage"))
            members = self.rows.where(F.col("split") != self.train).mapInArrow(_members(self.splits), "code int, ident bigint, row_id bigint")
            classes = members.join(hits, "row_id").groupBy("code", "ident").agg(F.max("coverage").alias("coverage"))
            split = F.element_at(F.array(*[F.lit(s) for s in self.splits]), F.col("code") + 1)
            self._flagged = members.join(classes, ["code", "ident"]).select(split.alias("split"), "row_id", "coverage").distinct()
        return self._flagged

    def flagged(self) -> DataFrame:
        """(split, row_id): every evaluation row with an overlapping training row, copies included."""
        return self.covered_rows().select("split", "row_id").distinct()

    def report(self) -> DataFrame:
        """(split, source, drop_indices, n_affected, mean_coverage): the flagged rows by split and source (null sources together)."""
        source = self.all.select(F.col("row_id").cast("bigint").alias("row_id"), "source").distinct()
        return (
            self.covered_rows().join(source, "row_id").groupBy("split", "source")
            .agg(F.sort_array(F.collect_set("row_id")).alias("drop_indices"), F.count_distinct("row_id").alias("n_affected"), F.avg("coverage").alias("mean_coverage"))
        )


def cross_split_overlap(rows: DataFrame, checks: DataFrame, evaluation: tuple[str, ...] = ("dev", "test", "ood")) -> CrossSplitOverlap:
    """Overlaps of evaluation splits with train, at the thresholds that ``checks`` holds for CrossSplitLeakageCheck (0.9 where it holds none)."""
    got = current_thresholds(checks, "CrossSplitLeakageCheck")
    return CrossSplitOverlap(rows, {s: got.get(s, 0.9) for s in evaluation})
