"""Stretches of words that repeat with a period, by Kruskal's order over common prefixes.

The suffixes of a document are the nodes of a graph, neighbours in suffix order its edges,
weighted by the length of their common prefix (LCP). Edges are taken by decreasing LCP and
unite classes of suffixes; each class keeps its positions in order. When a union makes two
positions i < j neighbours and j - i is at most the LCP, the words from i to j + LCP repeat
with period j - i, at least twice. No position of the class lies between them, so that is the
smallest period; and every run is met so, at its first word and the word one period later.

A document is judged by itself, so nothing is shuffled: a task takes documents as they come.
Suffixes of many documents are sorted together in numpy, by classes of doubled length. Only
documents with some repeated stretch of half the least length are sorted, and only classes
whose nearest positions are no farther apart than their greatest LCP are united one by one.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A run has at least so many words, and at least two periods.
LEAST_LENGTH = 12
#: Documents are sorted together up to so many words, or one by one where one has more.
TOGETHER = 200_000

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes of words, the last of which stands nowhere else: positions
    such that those with a common prefix lie together, and the length of the common prefix of
    each two neighbours.

    A class of suffixes that agree in their first 2^k words is named by its place in the
    order; only classes of several suffixes are sorted again.
    """
    n = len(words)
    rank = np.zeros(n + 1, np.int64)
    levels, open_, step = [], np.arange(n), 0
    while len(open_):
        key = words if step == 0 else rank[open_] * (n + 1) + rank[np.minimum(open_ + step, n)]
        by = np.argsort(key, kind="stable")
        at, key = open_[by], key[by]
        new = np.append(True, key[1:] != key[:-1])
        old = rank[at]
        heads = np.append(True, old[1:] != old[:-1])
        index = np.arange(len(at))
        place = old + index - np.maximum.accumulate(np.where(heads, index, 0))
        rank[at] = np.maximum.accumulate(np.where(new, place, 0))
        levels.append(rank.copy())
        open_ = at[~(new & np.append(new[1:], True))]
        step = max(1, 2 * step)
    order = np.empty(n, np.int64)
    order[rank[:n]] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a + lcp] == levels[k][b + lcp]
        lcp[same] += 1 << k
    return order, lcp


def united(positions: list[int], lcp: list[int]):
    """Rows (i, j, lcp): positions that become neighbours in the position set of a class, as
    edges between neighbours of `positions` (in suffix order) are taken by decreasing lcp.

    A class is an interval of the suffix order, known by both its ends; the smaller of two
    position sets goes into the larger.
    """
    other, held = list(range(len(positions))), [[p] for p in positions]
    for k in sorted(range(len(lcp)), key=lcp.__getitem__, reverse=True):
        level, first, last = lcp[k], other[k], other[k + 1]
        small, big = held[k], held[k + 1]
        if len(small) > len(big):
            small, big = big, small
        gaps: list = []
        for p in small:
            at = bisect_left(big, p)
            if gaps and gaps[-1][0] == at:
                gaps[-1][1].append(p)
            else:
                gaps.append((at, [p]))
        for at, some in reversed(gaps):
            if at:
                yield big[at - 1], some[0], level
            if at < len(big):
                yield some[-1], big[at], level
            big[at:at] = some
        other[first], other[last] = last, first
        held[first] = held[last] = big


def _repeating(words: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """Numbers of the documents in which some `span` words stand twice (or seem to)."""
    n = len(words) - span + 1
    if n < 2:
        return doc[:0]
    with np.errstate(over="ignore"):
        mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        code = doc[:n].astype(np.uint64)
        for k in range(span):
            code = code * np.uint64(0xD1342543DE82EF95) + mixed[k : n + k]
    whole = np.flatnonzero(doc[:n] == doc[span - 1 :])
    code = code[whole]
    by = np.argsort(code)
    return np.unique(doc[whole[by[1:][code[by][1:] == code[by][:-1]]]])


def runs_of(words: np.ndarray, doc: np.ndarray, least: int = LEAST_LENGTH) -> list[tuple[int, int, int, int]]:
    """All runs (document, start, length, period) of documents numbered in doc, words as ids.

    Starts count from the document's first word.
    """
    doc = np.asarray(doc)
    some = np.isin(doc, _repeating(words, doc, -(-least // 2)))
    words, doc = words[some], doc[some]
    if not len(words):
        return []
    # words of other documents are other words, and one that stands nowhere else ends each
    numbers, first, count = np.unique(doc, return_index=True, return_counts=True)
    which = np.repeat(np.arange(len(numbers)), count)
    text = np.full(len(words) + len(numbers), -1)
    text[np.arange(len(words)) + which] = words + which * (int(words.max()) + 1)
    begins = first + np.arange(len(numbers))
    text[begins + count] = -1 - np.arange(len(numbers))

    order, lcp = suffix_order(text)
    edge = lcp >= -(-least // 2)
    starts = np.flatnonzero(edge & ~np.append(False, edge[:-1]))
    ends = np.flatnonzero(edge & ~np.append(edge[1:], False)) + 1
    if not len(starts):
        return []
    sizes = ends - starts + 1
    group = np.repeat(np.arange(len(starts)), sizes)
    within = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    position = order[np.repeat(starts, sizes) + within]
    by = np.lexsort((position, group))
    gap = np.diff(position[by], prepend=0)
    gap[np.cumsum(sizes) - sizes] = len(text)
    nearest = np.minimum.reduceat(gap, np.cumsum(sizes) - sizes)
    longest = np.maximum.reduceat(np.append(lcp, 0), np.stack([starts, ends], 1).ravel())[::2]
    found = []
    at = np.searchsorted(begins, np.arange(len(text)), side="right") - 1
    for k in np.flatnonzero(nearest <= longest):
        a, b = starts[k], ends[k]
        for i, j, level in united(order[a : b + 1].tolist(), lcp[a:b].tolist()):
            period = j - i
            if period <= level and period + level >= least and (i == 0 or text[i - 1] != text[j - 1]):
                found.append((int(numbers[at[i]]), int(i - begins[at[i]]), period + level, period))
    return sorted(found)


class _Ids(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def periodic_runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """Rows (doc_id, n_words, runs, text), one for each row of docs (doc_id, text).

    Words are what stands between spaces and the control characters 9 to 13. runs are all
    maximal runs, by start, then period: stretches of words with smallest period `period` and
    `length` of at least `least` words and two periods, which no neighbouring word continues.
    text has the words that remain when each run keeps its first period only, joined by one space.

    Null texts have no words and an empty text. Rows are judged one by one: null and repeated
    doc_ids stay as they are, other columns are ignored. A document is held whole by its task.
    """
    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def judged(held):
        ids = _Ids()
        number = np.fromiter((ids[w] for _, words in held for w in words), np.int64)
        sizes = [len(words) for _, words in held]
        runs: list[list] = [[] for _ in held]
        for d, *run in runs_of(number, np.repeat(np.arange(len(held)), sizes), least):
            runs[d].append(run)
        for (_, words), mine in zip(held, runs):
            if mine:
                drop = np.zeros(len(words) + 1, np.int64)
                for start, length, period in mine:
                    drop[start + period] += 1
                    drop[start + length] -= 1
                words = list(compress(words, np.cumsum(drop[:-1]) == 0))
            yield mine, b" ".join(words).decode()

    def run(batches):
        for batch in batches:
            doc, texts = batch.column(0), batch.column(1).cast(pa.binary())
            first, held, n = 0, [], 0
            for k, text in enumerate(texts):
                words = (text.as_py() or b"").split()
                held.append((k, words))
                n += len(words)
                if n >= TOGETHER or k == len(texts) - 1:
                    runs, kept = zip(*judged(held))
                    rows = [[dict(zip(("start", "length", "period"), r)) for r in mine] for mine in runs]
                    yield pa.RecordBatch.from_arrays(
                        [doc.slice(first, len(held)), pa.array([len(w) for _, w in held], pa.int64()), pa.array(rows, pa.list_(_RUN)), pa.array(kept, pa.string())],
                        names=["doc_id", "n_words", "runs", "text"],
                    )
                    first, held, n = k + 1, [], 0

    return slim.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, text string")
