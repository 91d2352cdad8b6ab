"""Words of a text, for whole Arrow batches at a time.

Words: format characters (category Cf) are removed, NFKC is applied, the text
is lower-cased, and the longest runs of letters and digits are taken. Spark has
no NFKC, so this is a Python kernel; it works on one buffer per batch instead
of row by row, and ASCII rows never pass the Unicode steps.

Null texts are treated as empty; a text without letters or digits has no words.
"""

from __future__ import annotations

import unicodedata

import numpy as np

_SEP = "\x00"
_TABLE = bytes(
    0 if c == 0 else c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _fold_unicode(rows: list[str]) -> list[str]:
    """Cf removal, NFKC and lower case; other non-alphanumeric non-ASCII characters become blanks.

    Only the few characters of a batch that need it are replaced, and only rows
    that are not in NFKC yet are normalised.
    """
    joined = _SEP.join(rows)
    for c in set(joined):
        if c > "\x7f" and unicodedata.category(c) == "Cf" or c == "\xad":
            joined = joined.replace(c, "")
    nfkc = unicodedata.normalize
    joined = _SEP.join([r if unicodedata.is_normalized("NFKC", r) else nfkc("NFKC", r) for r in joined.split(_SEP)])
    joined = joined.lower()
    for c in set(joined):
        if c > "\x7f" and not c.isalnum():
            joined = joined.replace(c, " ")
    return joined.split(_SEP)


def fold(texts: list[str | None]) -> list[bytes]:
    """UTF-8 of each text with its words separated by blanks and nothing else beside them."""
    return _buffer(texts).split(b"\x00")[: len(texts)] if texts else []


def _buffer(texts: list[str | None]) -> bytes:
    rows = [("" if t is None else t.replace(_SEP, " ") if _SEP in t else t) for t in texts]
    odd = [i for i, t in enumerate(rows) if not t.isascii()]
    if odd:
        for i, t in zip(odd, _fold_unicode([rows[i] for i in odd]), strict=True):
            rows[i] = t
    return (_SEP.join(rows) + _SEP).encode("utf-8", "surrogatepass").translate(_TABLE)


def alnum_counts(texts: list[str | None]) -> np.ndarray:
    """Letters and digits of each text's words."""
    if not texts:
        return np.zeros(0, np.int64)
    buf = np.frombuffer(_buffer(texts), np.uint8)
    upto = np.append(0, np.cumsum((buf > 32) & ((buf & 0xC0) != 0x80)))
    end = np.flatnonzero(buf == 0)
    return upto[end] - upto[np.append(0, end[:-1] + 1)]


def words(text: str | None) -> list[str]:
    """Words of one text in order."""
    return [w.decode("utf-8", "surrogatepass") for w in fold([text])[0].split()]


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash): the 64-bit hash of every word with the index of its row, in text order."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    buf = np.frombuffer(_buffer(texts), np.uint8)
    inside = buf > 32
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    chars = buf[inside].astype(np.uint64)
    place = np.arange(len(chars)) - np.repeat(first, lens)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(lens.max()), _BASE, np.uint64))
        h = np.add.reduceat((chars + np.uint64(1)) * power[place], first)
        h = mix64(h + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    rows = np.searchsorted(np.flatnonzero(buf == 0), starts)
    return rows, h


def distinct_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """As token_hashes, each word once a row, sorted by row and hash."""
    rows, h = token_hashes(texts)
    if len(texts) < 1 << 16:
        order = np.argsort((rows.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    else:
        order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
    return rows[keep], h[keep]


def shingle_hashes(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash): the distinct hashes of every k consecutive words of each row, sorted by row and hash; a row of fewer words has one of all its words."""
    rows, h = token_hashes(texts)
    n = np.bincount(rows, minlength=len(texts))
    first = np.cumsum(n) - n
    place = np.arange(len(h)) - first[rows] if len(h) else rows
    begins = place <= np.maximum(n[rows] - k, 0) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(begins)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            inside = at + j < (first + n)[rows[at]]
            word = np.where(inside, h[np.minimum(at + j, len(h) - 1)], np.uint64(0))
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(j))
    rows = rows[at]
    order = np.lexsort((out, rows))
    rows, out = rows[order], out[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (out[1:] != out[:-1])
    return rows[keep], out[keep]


def chunks(texts: list[str | None], limit: int = 2_000_000):
    """(start, end) ranges of texts of about ``limit`` characters each, so that long texts don't add up in memory."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
