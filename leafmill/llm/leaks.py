"""Evaluation passages inside training documents: exact filters, then Smith-Waterman alignment.

Words are runs of letters and digits without case. A document is aligned with an item, word by word, only if one of two
conditions holds that no reported pair can fail, whatever other documents hold: as many shared n-grams on one diagonal
as ``run`` equal words have, or a stretch in which the words that the item knows outweigh the others by as much as an
alignment of ``min_share`` needs. Documents stream through Arrow partitions once and are never shuffled.

The items travel with the tasks. They are a test set of fixed size; ``max_item_words`` is checked and, beyond it, the items
are worked off in blocks of that many words, each block against all documents.

Defined results: null or empty texts on either side never match; items with fewer than ``n`` words cannot match; repeated
rows give one result; a null id gives none; empty tables give no rows; texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


WORD = regex.compile(r"[^\W_]+")
MATCH, MISMATCH, GAP = 2, -1, -1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Rolling 64-bit identifiers of the n-grams of word numbers; 0 where one holds a word unknown to the items."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    ok = np.ones(m, bool)
    for k in range(n):
        part = ids[k : k + m]
        h = (h ^ (part.astype(np.uint64) + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(29)
        ok &= part >= 0
    return np.where(ok, h | np.uint64(1), np.uint64(0))


class Held:
    """Inverted lists: which sequences hold a value, and how often."""

    def __init__(self, seqs: list[np.ndarray]):
        self.n = len(seqs)
        pairs = [np.unique(v, return_counts=True) for v in seqs]
        values = np.concatenate([v for v, _ in pairs]) if pairs else np.empty(0, np.int64)
        order = np.argsort(values, kind="stable")
        self.owner = np.repeat(np.arange(self.n), [len(v) for v, _ in pairs])[order]
        self.times = np.concatenate([c for _, c in pairs])[order] if pairs else values
        self.values, self.first = np.unique(values[order], return_index=True)
        self.size = np.diff(np.append(self.first, len(values)))

    def common(self, part: np.ndarray) -> np.ndarray:
        """For each sequence how many of its values occur in the part; never fewer than an alignment can match."""
        if not len(part) or not len(self.values):
            return np.zeros(self.n)
        at = np.minimum(np.searchsorted(self.values, part), len(self.values) - 1)
        there = np.zeros(len(self.values), bool)
        there[at[self.values[at] == part]] = True
        at = np.flatnonzero(there)
        size, first = self.size[at], self.first[at]
        take = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.owner[take], self.times[take], self.n)


class Items:
    """The evaluation items as word numbers, with the items and places of each n-gram."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.n, self.vocab, self.seqs = n, {}, {}
        for item, text in rows:
            self.seqs[item] = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words(text)], np.int64)
        self.at: dict[int, list[tuple[int, int]]] = {}
        for item, ids in self.seqs.items():
            for pos, g in enumerate(grams(ids, n).tolist()):
                self.at.setdefault(g, []).append((item, pos))
        self.known = np.array(sorted(self.at), np.uint64)

    def numbers(self, text: str) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, -1) for w in words(text)], np.int64)

    def bounds(self, min_share: float) -> "Items":
        """What an alignment of the share needs: points, matched words, and the most words of a document it can span."""
        self.names, self.masks = list(self.seqs), {}
        size = np.array([len(v) for v in self.seqs.values()], np.int64)
        self.points = MATCH * size * (min_share - 1e-6)  # shares are rounded to six places
        self.needed = np.where(size < self.n, np.inf, self.points / MATCH)
        # matched words are at most the item's, and each other word costs a point
        self.spans = np.maximum(1, np.ceil(size + MATCH * size - self.points)).astype(np.int64)
        self.width = int(self.spans.max(initial=1))
        self.own = [np.unique(v) for v in self.seqs.values()]
        self.held = Held(list(self.seqs.values())), Held([grams(v, 2) for v in self.seqs.values()])
        return self

    def in_order(self, i: int, part: list[int]) -> int:
        """The longest common subsequence of an item and a part, bit by bit: no alignment matches more words."""
        if i not in self.masks:
            at: dict[int, int] = {}
            for k, w in enumerate(self.seqs[self.names[i]].tolist()):
                at[w] = at.get(w, 0) | 1 << k
            self.masks[i] = at
        at, size = self.masks[i], len(self.seqs[self.names[i]])
        row = full = (1 << size) - 1
        for w in part:
            u = row & at[w]
            row = ((row + u) | (row - u)) & full
        return size - row.bit_count()

    def stretches(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By item the stretches of a document outside of which no alignment can reach the share."""
        out: dict[int, list[tuple[int, int]]] = {}
        mark = np.zeros(len(self.vocab) + 1, bool)  # the last place is that of unknown words, -1
        for start in range(0, max(1, len(ids) - self.width), self.width):
            part = ids[start : start + 2 * self.width]
            common = self.held[0].common(part)
            if not (common >= self.needed).any():
                continue
            # m matched words, p pairs of them adjacent on both sides: at least m - p - 1 other words lie between
            both = common + self.held[1].common(grams(part, 2)) + 1
            for i in np.flatnonzero((common >= self.needed) & (both >= self.points)).tolist():
                mark[self.own[i]] = True
                known = mark[part]
                mark[self.own[i]] = False
                total = np.concatenate(([0], np.cumsum(np.where(known, MATCH, GAP))))
                span, whole = int(self.spans[i]), []
                for e in np.flatnonzero(total - _lowest(total, span + 1) >= self.points[i]).tolist():
                    a = max(0, e - span)
                    if whole and a <= whole[-1][1]:
                        whole[-1] = (whole[-1][0], e)
                    else:
                        whole.append((a, e))
                for a, b in whole:
                    m = self.in_order(i, part[a:b][known[a:b]].tolist())
                    if min(MATCH * m, m + both[i] - common[i]) >= self.points[i]:
                        out.setdefault(self.names[i], []).append((start + a, start + b))
        return out


def _lowest(v: np.ndarray, k: int) -> np.ndarray:
    """The least of the ``k`` values up to each place."""
    if len(v) <= k:
        return np.minimum.accumulate(v)
    most = v.max()
    rows = np.concatenate((np.full(k - 1, most), v, np.full(-(len(v) + k - 1) % k, most))).reshape(-1, k)
    up, down = np.minimum.accumulate(rows, 1).ravel(), np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(down[: len(v)], up[k - 1 : k - 1 + len(v)])


def _hits(ids: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    g = grams(ids, items.n)
    if not len(g) or not len(items.known):
        return np.empty(0, np.int64), g
    k = np.minimum(np.searchsorted(items.known, g), len(items.known) - 1)
    return np.flatnonzero((items.known[k] == g) & (g != 0)), g


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman score of two word sequences and their longest run of equal words; linear gaps, a row at a time."""
    best = longest = 0
    h = np.zeros(len(b) + 1, np.int64)
    run = np.zeros(len(b) + 1, np.int64)
    ramp = -GAP * np.arange(len(b) + 1)
    for x in a:
        same = b == x
        t = np.empty_like(h)
        t[0] = 0
        np.maximum(h[:-1] + np.where(same, MATCH, MISMATCH), h[1:] + GAP, out=t[1:])
        np.maximum(t, 0, out=t)
        h = np.maximum.accumulate(t + ramp) - ramp
        np.maximum(h, 0, out=h)
        nxt = np.zeros_like(run)
        nxt[1:] = np.where(same & (b >= 0), run[:-1] + 1, 0)
        run = nxt
        best, longest = max(best, int(h.max())), max(longest, int(run.max()))
    return best, longest


def _passages(spots: list[tuple[int, int]], length: int, total: int) -> list[tuple[int, int]]:
    """Stretches of the document that the item would cover, as (document place, item place) seeds place it, merged."""
    out: list[list[int]] = []
    pad = max(8, length // 4)
    for at, pos in sorted(spots):
        a, b = max(0, at - pos - pad), min(total, at - pos + length + pad)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _merged(passages: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(passages):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if i is not None and t:
                yield i, t


def _leaks(items: Items, run: int, edited: bool = True) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, text in _each(batches):
            ids = items.numbers(text)
            at, g = _hits(ids, items)
            spots: dict[int, list[tuple[int, int]]] = {}
            for p in at.tolist():
                for item, pos in items.at[int(g[p])]:
                    spots.setdefault(item, []).append((p, pos))
            near = items.stretches(ids) if edited else {}
            for item in {*spots, *near}:
                seq, found = items.seqs[item], spots.get(item, [])
                if item not in near and max(Counter(p - pos for p, pos in found).values()) < run - items.n + 1:
                    continue
                score = longest = 0
                for a, b in _merged(_passages(found, len(seq), len(ids)) + near.get(item, [])):
                    s, r = align(seq, ids[a:b])
                    score, longest = max(score, s), max(longest, r)
                rows.append((doc, item, score, round(score / (MATCH * len(seq)), 6), longest))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32()), strict=True)], names=["doc_id", "item_id", "score", "share", "longest_run"])

    return work


def leaks(documents: DataFrame, eval_items: DataFrame, run: int = 16, n: int = 5, min_share: float = 0.5, max_item_words: int = 1_000_000, edited: bool = True) -> DataFrame:
    """Documents with the items that leaked into them: alignment score, its share of a full copy, longest verbatim run.

    A pair is reported if the run is at least ``run`` words or the alignment reaches ``min_share`` of a full copy.
    Without ``edited`` only pairs with such a run are looked for.
    """
    docs = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = [(r[0], r[1]) for r in eval_items.select("item_id", "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator()]
    parts: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in rows:
        size += len(r[1].split())
        if size > max_item_words and parts[-1]:
            parts.append([])
            size = len(r[1].split())
        parts[-1].append(r)
    out = None
    for part in parts:
        items = Items(part, n)
        found = docs.mapInArrow(_leaks(items.bounds(min_share), run, edited), "doc_id bigint, item_id bigint, score int, share double, longest_run int")
        out = found if out is None else out.unionByName(found)
    out = out.where((F.col("longest_run") >= run) | (F.col("share") >= min_share))
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("share").alias("share"), F.max("longest_run").alias("longest_run"))
