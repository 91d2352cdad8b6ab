"""Evaluation texts inside training text: a BM25 search with block-max pruning.

The test items are the indexed side: every word has a list of the items that
hold it with its impact on each (BM25 with the items as the collection), cut
into blocks of items with the block's largest impact. Every passage of every
document, 32 words with an overlap that keeps any ten consecutive words
together, is a query. An item's threshold is the least score that a passage
holding ten consecutive words of it (or all, if it has fewer) can have, so
retrieving everything at or above the threshold misses nothing. As in WAND, a
passage's words are ordered by their largest impacts, and only lists from the
pivot on, where these add up to the least threshold, bring up blocks; a block
is read only if the block maxima of the passage's words reach the least
threshold in it; what is left is scored item by item. Retrieved pairs are
verified word by word.

The index is sparse and grows with the words of the items. It is sent to the
tasks in shards of at most SHARD_WORDS words of items, one narrow pass over the
documents for each, so that a task holds one shard whatever the number of
items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallywright.functions.text import chunks, token_hashes

RUN, PASSAGE = 10, 32
BLOCK = 16
#: Words of the items in one shard (about 40 bytes each in the index).
SHARD_WORDS = 1_000_000
#: Passages searched at a time.
SOME_PASSAGES = 20_000
K1, B = 1.2, 0.75
#: Sums of impacts differ in their last digits.
EPS = 1e-6


def _spans(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): the places of all given spans, and the span each belongs to."""
    which = np.repeat(np.arange(len(length)), length)
    return which, np.arange(len(which)) - (np.cumsum(length) - length)[which] + first[which]


class ItemIndex:
    """Posting lists of words over items, cut into blocks, and each item's threshold and runs."""

    def __init__(self, ids: list[str], texts: list[str | None]):
        rows, h = token_hashes(texts)
        at = np.searchsorted(rows, np.arange(len(ids) + 1))
        words = [h[at[i] : at[i + 1]] for i in range(len(ids))]
        self.vocab, df = np.unique(np.concatenate([np.unique(w) for w in words]) if len(h) else h, return_counts=True)
        n = sum(len(w) > 0 for w in words)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        mean = len(h) / max(n, 1)
        cells, found = [], []
        for i, w in enumerate(words):
            if not len(w):
                continue
            u, tf = np.unique(w, return_counts=True)
            v = np.searchsorted(self.vocab, u)
            impact = idf[v] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            k = min(RUN, len(w))
            runs = [w[s : s + k] for s in range(len(w) - k + 1)]
            score = dict(zip(u.tolist(), impact.tolist()))
            least = min(sum(score[x] for x in set(r.tolist())) for r in runs)
            found.append((least, i, k, {r.tobytes() for r in runs}))
            cells.append((v, impact))
        # blocks of items with like thresholds, so that one low threshold opens one block
        order = sorted(range(len(found)), key=lambda x: found[x][0])
        self.ids = [ids[found[x][1]] for x in order]
        self.threshold = np.array([found[x][0] for x in order]) - EPS
        self.runs = [found[x][2:] for x in order]
        if not order:
            return
        word = np.concatenate([cells[x][0] for x in order])
        self.item = np.repeat(np.arange(len(order)), [len(cells[x][0]) for x in order])
        self.impact = np.concatenate([cells[x][1] for x in order])
        by_word = np.argsort(word, kind="stable")  # items stay in order
        word, self.item, self.impact = word[by_word], self.item[by_word], self.impact[by_word]
        blocks = -(-len(order) // BLOCK)
        key = word * blocks + self.item // BLOCK
        self.list_first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.list_size = np.diff(np.append(self.list_first, len(key)))
        self.list_block = self.item[self.list_first] // BLOCK
        self.list_top = np.maximum.reduceat(self.impact, self.list_first)
        self.word_first = np.searchsorted(word[self.list_first], np.arange(len(self.vocab) + 1))
        self.top = np.append(np.maximum.reduceat(self.list_top, self.word_first[:-1]), 0.0)  # the last: words of no item
        self.block_least = np.minimum.reduceat(self.threshold, np.arange(0, len(order), BLOCK))
        self.blocks = blocks

    def search(self, rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) pairs verified in a batch of tokenised texts (tokens in text order)."""
        if not len(self.ids) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.vocab, h)
        at[at == len(self.vocab)] = 0
        word = np.where(self.vocab[at] == h, at, len(self.vocab))
        n = np.bincount(rows, minlength=rows[-1] + 1)
        first = np.cumsum(n) - n
        stride = PASSAGE - RUN + 1
        count = np.maximum(-(-(n - PASSAGE) // stride), 0) + 1
        count[n == 0] = 0
        owner = np.repeat(np.arange(len(n)), count)
        begin = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * stride
        end = np.minimum(begin + PASSAGE, first[owner] + n[owner])
        total = np.append(0, np.cumsum(self.top[word]))
        live = np.flatnonzero(total[end] - total[begin] >= self.threshold[0])
        out_row, out_item = [], []
        for lo in range(0, len(live), SOME_PASSAGES):
            some = live[lo : lo + SOME_PASSAGES]
            for x, j in zip(*self._retrieve(word, begin[some], end[some])):
                k, runs = self.runs[j]
                w = h[begin[some[x]] : end[some[x]]]
                if any(w[i : i + k].tobytes() in runs for i in range(len(w) - k + 1)):
                    out_row.append(owner[some[x]])
                    out_item.append(j)
        return np.array(out_row, np.int64), np.array(out_item, np.int64)

    def _retrieve(self, word: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
        """(passage, item) of all items whose threshold a passage reaches."""
        passage, place = _spans(begin, end - begin)
        known = word[place] < len(self.vocab)
        # distinct words of each passage, by rising largest impact
        key = np.unique(passage[known] * len(self.vocab) + word[place[known]])
        passage, w = key // len(self.vocab), key % len(self.vocab)
        order = np.lexsort((self.top[w], passage))
        passage, w = passage[order], w[order]
        total = np.cumsum(self.top[w])
        start = np.searchsorted(passage, passage)
        upto = total - (total[start] - self.top[w[start]])
        # a list before the pivot adds too little to bring up an item by itself
        from_pivot = upto >= self.threshold[0]
        lists = self.word_first[w + 1] - self.word_first[w]
        which, at = _spans(self.word_first[w[from_pivot]], lists[from_pivot])
        blocks = np.unique(passage[from_pivot][which] * self.blocks + self.list_block[at])
        if not len(blocks):
            return [], []
        # block maxima of all words of the passages that are left
        mine = np.flatnonzero(np.isin(passage, np.unique(blocks // self.blocks)))
        which, at = _spans(self.word_first[w[mine]], lists[mine])
        key = passage[mine[which]] * self.blocks + self.list_block[at]
        cell = np.searchsorted(blocks, key)
        cell[cell == len(blocks)] = 0
        ok = blocks[cell] == key
        cell, at = cell[ok], at[ok]
        bound = np.bincount(cell, self.list_top[at], minlength=len(blocks))
        ok = (bound >= self.block_least[blocks % self.blocks])[cell]
        cell, at = cell[ok], at[ok]
        which, place = _spans(self.list_first[at], self.list_size[at])
        key = blocks[cell[which]] // self.blocks * len(self.ids) + self.item[place]
        pair, where = np.unique(key, return_inverse=True)
        score = np.bincount(where, self.impact[place], minlength=len(pair))
        pair = pair[score >= self.threshold[pair % len(self.ids)]]
        return (pair // len(self.ids)).tolist(), (pair % len(self.ids)).tolist()


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = index.value
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(texts):
                rows, h = token_hashes(texts[lo:hi])
                row, item = mine.search(rows, h)
                found = sorted(set(zip(row.tolist(), item.tolist())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(ids[lo + r]) for r, _ in found], pa.int64()), pa.array([mine.ids[j] for _, j in found], pa.string())], ["doc_id", "item_id"]
                )

    return run


def leaked_items(documents: DataFrame, items: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id): documents whose words hold ten consecutive words of the item, or all if it has fewer.

    Null ids and null or empty texts match nothing; items without words are
    never found; a repeated doc_id or item_id gives each pair once.
    """
    spark = documents.sparkSession
    docs = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), "text").where("doc_id is not null and length(text) > 0")
    found, ids, texts, size = None, [], [], 0

    def one_pass() -> DataFrame:
        part = docs.mapInArrow(_search(spark.sparkContext.broadcast(ItemIndex(ids, texts))), "doc_id bigint, item_id string")
        return part if found is None else found.unionByName(part)

    for r in items.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"]) // 5 + 1
        if size >= shard_words:
            found, ids, texts, size = one_pass(), [], [], 0
    if ids or found is None:
        found = one_pass()
    return found.distinct()
