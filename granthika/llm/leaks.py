"""Evaluation passages inside corpus documents (problem 8).

Pigeonhole edit matching over words. Every window of ``window`` consecutive words of a test item is
split into ``budget + 1`` pieces: a document stretch within ``budget`` word edits of the window must hold
at least one piece unchanged. Pieces are looked up by a rolling hash, and every hit is verified with
Myers' bit-parallel edit distance, computed for all hits of a batch at once.

The piece index is built from the test items alone. Its size is checked: up to ``index_limit`` item words it
travels with the tasks; beyond that the items are cut into several indexes of that size and the documents are
scanned once for each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Everything that is neither letter, mark nor digit is dropped from a word before comparison.
NOT_WORD = r"[^\p{L}\p{M}\p{N}\s]+"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = 0


def plain_words(text: F.Column) -> F.Column:
    """Lower case without punctuation, white space kept; null stays null."""
    return F.regexp_replace(F.lower(text), NOT_WORD, "")


def myers_words(patterns: np.ndarray, texts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Least edit distance of each pattern to any stretch of its text, by Myers' bit vectors.

    ``patterns`` is (n, m) with m <= 63, ``texts`` (n, t) word numbers, 0 standing for an unknown word;
    of text k only the first ``lengths[k]`` words count. The pattern must match whole, the text's ends are free.
    """
    n, m = patterns.shape
    one = np.uint64(1)
    high = np.uint64(1 << (m - 1))
    plus = np.full(n, (1 << m) - 1, np.uint64)
    minus = np.zeros(n, np.uint64)
    score = np.full(n, m, np.int64)
    best = score.copy()
    for t in range(texts.shape[1]):
        word = texts[:, t]
        eq = np.zeros(n, np.uint64)
        for j in range(m):
            eq |= ((patterns[:, j] == word) & (word != _NONE)).astype(np.uint64) << np.uint64(j)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus)
        mh = plus & xh
        score = score + ((ph & high) != 0) - ((mh & high) != 0)
        ph, mh = ph << one, mh << one
        plus = mh | ~(xv | ph)
        minus = ph & xv
        best = np.where((t < lengths) & (score < best), score, best)
    return best


def _rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on; 0 where one of them is unknown."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        part = ids[k : k + n]
        out = out * _BASE + part.astype(np.uint64)
        known &= part != _NONE
    out ^= out >> np.uint64(29)
    return np.where(known, np.maximum(out, np.uint64(1)), np.uint64(0))


class PieceIndex:
    """Pieces of all windows of the items: sorted hashes with the place of each piece."""

    def __init__(self, items: list[tuple[int, str]], window: int, budget: int) -> None:
        self.window, self.budget = window, budget
        self.size = window // (budget + 1)
        self.vocabulary: dict[str, int] = {}
        words, owners, starts, ends = [], [], [], []
        for item, text in items:
            split = text.split()
            first = len(words)
            words += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split]
            words.append(_NONE)
            owners += [item] * (len(split) + 1)
            starts += [first] * (len(split) + 1)
            ends += [first + len(split)] * (len(split) + 1)
        self.words = np.array(words, np.int64)
        self.owners, self.starts, self.ends = (np.array(x, np.int64) for x in (owners, starts, ends))
        hashes = _rolling(self.words, self.size)
        places = np.flatnonzero(hashes)
        order = np.argsort(hashes[places], kind="stable")
        self.places, self.hashes = places[order], hashes[places][order]

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in ``ids``, place in the items) of equal pieces."""
        found = _rolling(ids, self.size)
        low = np.searchsorted(self.hashes, found, "left")
        high = np.searchsorted(self.hashes, found, "right")
        count = np.where(found != 0, high - low, 0)
        at = np.repeat(np.arange(len(found)), count)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return at, self.places[np.repeat(low, count) + within]

    def verify(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, place: np.ndarray):
        """Pairs (row of the hit, item, distance) of the windows around the hits that keep the budget.

        ``lo`` and ``hi`` bound the document of each word. A hit can be any piece of its window, so each
        of the ``budget + 1`` offsets is tried.
        """
        out = []
        m, k = self.window, self.budget
        for piece in range(k + 1):
            first = place - piece * self.size
            ok = (first >= self.starts[place]) & (first + m <= self.ends[place])
            if not ok.any():
                continue
            a, p = at[ok], first[ok]
            begin = np.maximum(a - piece * self.size - k, lo[a])
            end = np.minimum(a - piece * self.size + m + k, hi[a])
            keep = end - begin >= m - k
            a, p, begin, end = a[keep], p[keep], begin[keep], end[keep]
            for s in range(0, len(a), 200_000):
                cut = slice(s, s + 200_000)
                texts = ids[np.minimum(begin[cut, None] + np.arange(m + 2 * k), len(ids) - 1)]
                best = myers_words(self.words[p[cut, None] + np.arange(m)], texts, end[cut] - begin[cut])
                good = best <= k
                out.append((a[cut][good], self.owners[p[cut]][good], best[good]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _scan(index: PieceIndex):
    get = index.vocabulary.get

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, counts, ids = batch.column(0).to_numpy(zero_copy_only=False), [], []
            for text in batch.column(1).to_pylist():
                split = text.split()
                counts.append(len(split) + 1)
                ids += [get(w, _NONE) for w in split]
                ids.append(_NONE)
            ids, counts = np.array(ids, np.int64), np.array(counts, np.int64)
            ends = np.cumsum(counts)
            row = np.repeat(np.arange(len(docs)), counts)
            at, place = index.hits(ids)
            at, item, distance = index.verify(ids, (ends - counts)[row], (ends - 1)[row], at, place)
            key = np.lexsort((distance, item, row[at]))
            row_k, item_k, distance_k = row[at][key], item[key], distance[key]
            first = np.ones(len(key), bool)
            first[1:] = (row_k[1:] != row_k[:-1]) | (item_k[1:] != item_k[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(item_k[first]), pa.array(docs[row_k[first]], pa.int64()), pa.array(distance_k[first].astype(np.int32))],
                ["item_id", "doc_id", "edits"],
            )

    return scan


def find_leaks(items: DataFrame, documents: DataFrame, *, window: int = 12, budget: int = 1, index_limit: int = 2_000_000) -> DataFrame:
    """(item_id, doc_id, edits): documents with a stretch within ``budget`` word edits of a window of the item.

    ``items`` has item_id, text and ``documents`` has doc_id, text; other columns are ignored. Null ids
    and texts, empty texts and texts of fewer than ``window`` words give no row. Repeated rows and ids give one row
    for each (item_id, doc_id) with the least number of edits. Words are compared without case and punctuation;
    a token of punctuation alone is no word. ``window`` may be 2 to 63 and must be at least ``budget + 1``.
    ``index_limit`` bounds the words of one piece index; more items mean more passes, never fewer items.
    """
    if not 2 <= window <= 63 or not 0 <= budget < window:
        raise ValueError("window must be 2 to 63 words and budget less than that")
    wanted = items.select(F.col("item_id").cast("long"), plain_words(F.col("text")).alias("words")).where("item_id is not null and words is not null").distinct()
    corpus = documents.select(F.col("doc_id").cast("long").alias("doc_id"), plain_words(F.col("text")).alias("words")).where("doc_id is not null and words is not null")
    scans, part, size = [], [], 0

    def scan_part() -> None:  # the index goes to the tasks' files here, the driver keeps none
        scans.append(corpus.mapInArrow(_scan(PieceIndex(part, window, budget)), "item_id long, doc_id long, edits int"))
        part.clear()

    for row in wanted.orderBy("item_id", "words").toLocalIterator():
        part.append((row.item_id, row.words))
        size += row.words.count(" ") + 1
        if size >= index_limit:
            scan_part()
            size = 0
    if part or not scans:
        scan_part()
    out = functools.reduce(DataFrame.unionByName, scans)
    return out.groupBy("item_id", "doc_id").agg(F.min("edits").alias("edits"))


def exact_leaks(leaks: DataFrame) -> DataFrame:
    """Of ``find_leaks`` the pairs whose window stands in the document word for word."""
    return leaks.where("edits = 0").select("item_id", "doc_id")
