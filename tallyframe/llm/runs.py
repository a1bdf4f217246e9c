"""Periodic runs in word sequences, found by longest common extensions over a difference cover.

A run is a stretch of words with smallest period q and at least ``max(least, 2 q)`` words that neither neighbour extends.
For each q, a grid with a point every q words has a point i in the first q words of every such run, and the words from i on
equal those from i + q on. So a run follows from two questions for the pair (i, i + q): how far do the words agree to the right,
and how far to the left. All grids together have n log n points; most pairs differ in their first word and are gone at once.

Agreement is a longest common extension. A difference cover of 31 has six residues such that any two places reach places of
these residues in the same number of steps, fewer than 31. So a few words are compared, and only pairs that agree up to
the synchronised places go on: suffixes at covered places alone are sorted, by doubling in steps of 31 words; the agreement of
neighbours in that order is kept in a sparse table of minima, from which that of any two is a range minimum. To the left it
is the same on the reversed words. Suffixes are sorted only for documents that have a pair which gets that far.

A stretch with several periods is found for each; the smallest one counts. Documents are independent. A task works on
some 400,000 words at a time, of many documents or of one long one, and on arrays in proportion to them.

Odd cases: a null or empty text has no words and no run. A null doc_id counts as empty text where its digits are asked for.
Rows that repeat are rows of their own. Only doc_id and text are read; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyframe.llm.common import map_batches

LEAST = 12  # words of a run
STEP = 31
COVER = (0, 1, 3, 8, 12, 18)  # each difference modulo STEP occurs between two of them
FIRST = 4  # words that are compared before covered places count
TOGETHER = 400_000  # words of documents that are worked on at once
PAIRS = 1_000_000  # grid points that are tested at once


def _steps_to_cover() -> np.ndarray:
    """Of two places modulo STEP, how many words on both are at covered places; FIRST at least."""
    covered = np.isin(np.arange(STEP), COVER)
    out = np.zeros((STEP, STEP), np.int64)
    for d in range(FIRST + STEP - 1, FIRST - 1, -1):
        both = np.ix_(*[np.roll(covered, -d)] * 2)
        out[both] = d
    return out


_SYNC = _steps_to_cover()


class Extensions:
    """Longest common extensions to the right in ``words``; each document ends with a word that occurs nowhere else."""

    def __init__(self, words: np.ndarray, doc_of: np.ndarray):
        self.words, self.doc_of = words, doc_of
        self.index = None

    def _prepare(self, docs: np.ndarray) -> None:
        """Sort the suffixes at covered places of the documents ``docs`` (a flag for each)."""
        words, n = self.words, len(self.words)
        places = np.flatnonzero(np.isin(np.arange(n) % STEP, COVER) & docs[self.doc_of])
        count = len(places)
        self.index = np.full(n, -1, np.int64)
        self.index[places] = np.arange(count)
        # Ranks by ever more words: the document, then one word after the other, then doubled. A place beyond the document
        # needs no rank, since the word that ends it has told the suffix from all others before.
        rank = self._ranked(self.doc_of[places].astype(np.int64))
        for d in range(STEP):
            tied = self._tied(rank)
            if not len(tied):
                break
            rank = self._refined(rank, tied, words[np.minimum(places[tied] + d, n - 1)])
        levels, width = [rank], STEP
        while len(tied := self._tied(rank)):
            after = self.index[np.minimum(places[tied] + width, n - 1)]
            rank = self._refined(rank, tied, np.where(after >= 0, rank[after], 0))
            levels.append(rank)
            width *= 2
        self.rank = rank
        order = np.empty(count, np.int64)
        order[rank] = places
        # How far neighbours in the order agree: by the levels of doubling from the widest on, then word by word.
        a, b, agree = order[:-1].copy(), order[1:].copy(), np.zeros(max(count - 1, 0), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            ia, ib = self.index[np.minimum(a, n - 1)], self.index[np.minimum(b, n - 1)]
            same = (ia >= 0) & (ib >= 0)
            same[same] = levels[k][ia[same]] == levels[k][ib[same]]
            step = (STEP << k) * same
            a, b, agree = a + step, b + step, agree + step
        rows = np.arange(len(a))
        while len(rows):
            rows = rows[words[a[rows]] == words[b[rows]]]
            a[rows] += 1
            b[rows] += 1
            agree[rows] += 1
        self.minima = [agree]
        while 1 << len(self.minima) <= len(agree):
            half, last = 1 << (len(self.minima) - 1), self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _ranked(values: np.ndarray) -> np.ndarray:
        """The place of each value among all, equal ones sharing the first."""
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, bool)
        rank = np.empty(len(values), np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
        return rank

    @staticmethod
    def _tied(rank: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)

    @staticmethod
    def _refined(rank: np.ndarray, tied: np.ndarray, values: np.ndarray) -> np.ndarray:
        """``rank`` after rows that share one are ordered by ``values``."""
        old = rank[tied]
        order = np.lexsort((values, old))
        r, v = old[order], values[order]
        at = np.arange(len(r))
        group = np.concatenate(([True], r[1:] != r[:-1]))
        new = group.copy()
        new[1:] |= v[1:] != v[:-1]
        offset = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        out = rank.copy()
        out[tied[order]] = r + offset
        return out

    def _by_ranks(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The extension of two different covered places each: the least agreement between them in the order."""
        a, b = self.rank[self.index[i]], self.rank[self.index[j]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.minima[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from ``i`` and ``j`` (later, in the same document) on, for arrays of both."""
        words, out = self.words, np.zeros(len(i), np.int64)
        sync = _SYNC[i % STEP, j % STEP]
        rows, d = np.arange(len(i)), 0
        far = []
        while len(rows):
            there = sync[rows] == d
            far.append(rows[there])
            rows = rows[~there]
            rows = rows[words[i[rows] + d] == words[j[rows] + d]]
            out[rows] += 1
            d += 1
        far = np.concatenate(far) if far else rows
        if len(far):
            if self.index is None or (self.index[i[far] + sync[far]] < 0).any():
                self._prepare(self._wanted(i[far]))
            out[far] = sync[far] + self._by_ranks(i[far] + sync[far], j[far] + sync[far])
        return out

    def _wanted(self, places: np.ndarray) -> np.ndarray:
        """Flags of the documents of ``places`` and of those that were wanted before."""
        wanted = np.zeros(int(self.doc_of[-1]) + 1, bool)
        wanted[self.doc_of[places]] = True
        if self.index is not None:
            wanted[self.doc_of[self.index >= 0]] = True
        return wanted


def _grid(lengths: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place, period) of the grids of all documents, some at a time; documents come by falling length."""
    longest = int(lengths[0]) // 2 if len(lengths) else 0
    if not longest:
        return
    # The grid of q goes through all documents of at least 2 q words, which come first.
    q = np.arange(1, longest + 1)
    with_room = np.searchsorted(-lengths, -2 * q, side="right")
    ends = starts[with_room - 1] + lengths[with_room - 1]
    points = ends // q + 1
    sums = np.concatenate(([0], np.cumsum(points)))
    first = 0
    while first < longest:
        last = max(first + 1, int(np.searchsorted(sums, sums[first] + PAIRS, side="right")) - 1)
        periods = np.repeat(q[first:last], points[first:last])
        within = np.arange(len(periods)) - np.repeat(sums[first:last] - sums[first], points[first:last])
        yield within * periods, periods
        first = last


def find_runs(sequences: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of sequences of word numbers: which sequence, start, length and period; by sequence, start and period."""
    empty = np.empty(0, np.int64)
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    order = order[: int(np.sum([len(s) >= least for s in sequences]))] if len(sequences) else order
    if not len(order):
        return empty, empty, empty, empty
    lengths = np.array([len(sequences[k]) for k in order], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) + 1  # a word of its own before, between and after all
    total = int(starts[-1] + lengths[-1]) + 1
    top = max(int(sequences[k].max()) for k in order) + 1
    words = np.empty(total, np.int64)
    words[0], words[starts + lengths] = top, top + 1 + np.arange(len(order))
    # The word after a document ends it to the right, the one before it to the left.
    doc_of, from_left = np.zeros(total, np.int64), np.zeros(total, np.int64)
    doc_of[starts[1:]], from_left[starts[1:] - 1] = 1, 1
    doc_of, from_left = np.cumsum(doc_of), np.cumsum(from_left)
    for at, k in zip(starts.tolist(), order.tolist(), strict=True):
        words[at : at + len(sequences[k])] = sequences[k]
    right = Extensions(words, doc_of)
    left = Extensions(words[::-1].copy(), (len(order) - 1 - from_left)[::-1].copy())

    found = []
    for place, period in _grid(lengths, starts):
        there = place + period < total
        place, period = place[there], period[there]
        hit = words[place] == words[place + period]
        place, period = place[hit], period[hit]
        hit = doc_of[place] == doc_of[place + period]
        place, period = place[hit], period[hit]
        if not len(place):
            continue
        ahead = right(place, place + period)
        # To the left of i and i + q, as places of the reversed words. A run that reaches q words back has an earlier point.
        behind = left(total - place - period, total - place)
        ok = (ahead + behind >= period) & (ahead + behind + period >= least) & (behind < period)
        found.append((place[ok] - behind[ok], (ahead + behind + period)[ok], period[ok]))
    if not found:
        return empty, empty, empty, empty
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    smallest = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1]))) if len(start) else np.empty(0, bool)
    start, length, period = start[smallest], length[smallest], period[smallest]
    rank = doc_of[start]
    which, start = order[rank], start - starts[rank]
    by = np.lexsort((period, start, which))
    return which[by], start[by], length[by], period[by]


def numbered_words(texts: list[str | None]) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """The words of each text, and their numbers; equal words have equal numbers."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    number: dict[bytes, int] = {}
    for own in words:
        for w in own:
            if w not in number:
                number[w] = len(number)
    of = number.__getitem__
    return words, [np.fromiter(map(of, own), np.int64, len(own)) for own in words]


def spread(doc_id: object, n: int) -> np.ndarray | None:
    """Which word stands at each place once one document in ten, by the CRC-32 of its id, repeats a passage to its end."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


def runs_of(docs: DataFrame, least: int = LEAST, rewrite: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per document: doc_id, runs (start, length and period in words, by start and period) and collapsed.

    ``collapsed``: the words joined by one space, without those that a run has after its first period.
    ``rewrite``: from doc_id and the number of words the word that is to stand at each place, or None.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, at = batch.column("doc_id"), batch.column("text"), 0
            while at < batch.num_rows:
                held, until = 0, at
                while until < batch.num_rows and (until == at or held < 6 * TOGETHER):  # about so many bytes
                    held += len(texts[until].as_py() or "")
                    until += 1
                yield _found(ids.slice(at, until - at), texts.slice(at, until - at).to_pylist(), least, rewrite)
                at = until

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs array<struct<start: int, length: int, period: int>>, collapsed string"
    return map_batches(docs.select("doc_id", "text"), go, schema)


def _found(ids: pa.Array, texts: list[str | None], least: int, rewrite) -> pa.RecordBatch:
    words, numbers = numbered_words(texts)
    if rewrite is not None:
        for k, doc_id in enumerate(ids.to_pylist()):
            places = rewrite(doc_id, len(words[k]))
            if places is not None:
                numbers[k] = numbers[k][places]
                words[k] = [words[k][p] for p in places.tolist()]
    which, start, length, period = find_runs(numbers, least)
    counts = np.bincount(which, minlength=len(texts)) if len(which) else np.zeros(len(texts), np.int64)
    ends = np.cumsum(counts)
    collapsed = []
    for own, a, b in zip(words, (ends - counts).tolist(), ends.tolist(), strict=True):
        if a < b:
            change = np.zeros(len(own) + 1, np.int64)
            np.add.at(change, start[a:b] + period[a:b], 1)
            np.add.at(change, start[a:b] + length[a:b], -1)
            own = [own[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        collapsed.append(b" ".join(own))
    fields = [pa.array(c.astype(np.int32)) for c in (start, length, period)]
    of_runs = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
    offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
    text = pa.array(collapsed, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, of_runs), text], ["doc_id", "runs", "collapsed"])
