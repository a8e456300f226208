"""Periodic runs: stretches of words that repeat with a period, at least twice over.

Periods below ``SHORT`` are found by direct lag scans: neighbours of equal words at each lag.  Longer ones go by scale, a scale
being the periods from 2**s up to twice that.  In a run of period q, windows of 2**s words that lie q apart hold the same words,
so their least k-mers (by a hash of the k-mer, the leftmost of equals) lie q apart too.  At each scale the window minima are taken,
those with equal k-mers are paired, and every pair is a seed: its distance is the period, and the run is the stretch around it in
which words that far apart are equal.  K-mers are numbered exactly, by doubling, so no hash decides anything but the sampling.

Inside a run of a short period the same k-mer recurs many times.  Occurrences that overlap by half or more are taken together
as a cluster, which is itself periodic; two clusters give one seed per distinct distance instead of one per pair, and a cluster
none with itself.  The seeds of a scale thus grow with the text, not with the square of a run.

Texts of a batch are searched together, as one row of numbers in which no two texts share a number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, text_column

SHORT = 16        # periods below it are found by lag scans; a power of two
LEAST = 12        # words in a run
BATCH = 1 << 19   # words searched together, if no text is longer

RUN_DDL = "array<struct<start: long, length: long, period: long>>"


class Names:
    """Exact numbers for the stretches of 2**level words at every position: equal numbers, equal words.

    Stretches that occur once need no place in a table: they get a number of their own, below zero."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.levels = [self._tidy(ids)]
        self.own = -1 - np.arange(len(ids))
        while 1 << len(self.levels) <= longest:
            last, step = self.levels[-1], 1 << len(self.levels) - 1
            at = np.flatnonzero((last[:-step] >= 0) & (last[step:] >= 0)) if step < len(ids) else np.zeros(0, np.int64)
            out = self.own.copy()
            if len(at):
                out[at] = np.unique(last[at] * len(ids) + last[at + step], return_inverse=True)[1]
                out = self._tidy(out)
            self.levels.append(out)

    @staticmethod
    def _tidy(names: np.ndarray) -> np.ndarray:
        """Numbers that occur once become numbers below zero."""
        out = -1 - np.arange(len(names))
        held = np.flatnonzero(names >= 0)
        if len(held):
            _, which, counts = np.unique(names[held], return_inverse=True, return_counts=True)
            again = counts[which] > 1
            out[held[again]] = which[again]
        return out

    def _common(self, x: np.ndarray, y: np.ndarray, backward: bool) -> np.ndarray:
        """Length of the common stretch that starts at x and y, or that ends before them; x < y."""
        total, n = np.zeros(len(x), np.int64), len(self.own)
        for level in range(len(self.levels) - 1, -1, -1):
            names, step = self.levels[level], 1 << level
            a, b = (x - total - step, y - total - step) if backward else (x + total, y + total)
            inside = (a >= 0) & (b + step <= n)
            total += step * (inside & (names[np.where(inside, a, 0)] == names[np.where(inside, b, 1)]))
        return total

    def stretch(self, x: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch around x in which words are equal to those ``lag`` later: its start and its end."""
        return x - self._common(x, x + lag, True), x + self._common(x, x + lag, False)


def _short_runs(ids: np.ndarray, least: int) -> list[np.ndarray]:
    found = []
    for lag in range(1, min(SHORT, len(ids))):
        edges = np.flatnonzero(np.diff(np.r_[False, ids[lag:] == ids[:-lag], False]))
        starts, ends = edges[::2], edges[1::2]
        long_enough = ends - starts + lag >= max(least, 2 * lag)
        starts, ends = starts[long_enough], ends[long_enough]
        found.append(np.stack([starts, ends - starts + lag, np.full(len(starts), lag)], 1))
    return found


def _minima(names: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash in a window of that many neighbours, the leftmost of equals; only of names that recur."""
    order = names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # odd, so that no two names share a value
    order ^= order >> np.uint64(32)
    n = len(order)
    if n < window:
        return np.zeros(0, np.int64)
    held = np.arange(n)
    reach = 1
    while reach < window:  # the least of a window of 2 * reach, then of the whole window, from two that overlap
        step = min(reach, window - reach)
        a, b = held[:len(held) - step], held[step:]
        held = np.where(order[a] <= order[b], a, b)
        reach += step
    kept = held[np.r_[True, held[1:] != held[:-1]]]
    return kept[names[kept] >= 0]


def _seeds(names: np.ndarray, at: np.ndarray, k: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of every two equal k-mers among ``at`` that lie ``low`` up to twice ``low`` apart, one for each
    distance of two clusters."""
    at = at[np.lexsort((at, names[at]))]
    name = names[at]
    joined = (name[1:] == name[:-1]) & (at[1:] - at[:-1] <= k // 2)
    first = np.r_[0, np.flatnonzero(~joined) + 1]
    last = np.r_[first[1:], len(at)] - 1
    steps = np.zeros(len(at), np.int64)
    steps[1:][joined] = (at[1:] - at[:-1])[joined]
    gcds = np.gcd.reduceat(steps, first)
    name, begin, end = name[first], at[first], at[last]
    xs, lags = [], []
    for t in range(1, len(first)):
        a = np.flatnonzero((name[t:] == name[:-t]) & (begin[t:] - end[:-t] < 2 * low))
        if not len(a):
            break
        b = a + t
        step = np.gcd(gcds[a], gcds[b])
        least, most = begin[b] - end[a], end[b] - begin[a]
        # distances are least, least + step, ... up to most; of two single k-mers there is one
        step = np.where(step == 0, 1, step)
        skip = np.maximum(0, -((least - low) // step))
        least = least + skip * step
        count = np.maximum(0, (np.minimum(most, 2 * low - 1) - least) // step + 1)
        a, b = np.repeat(a, count), np.repeat(b, count)
        nth = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        lag = np.repeat(least, count) + nth * np.repeat(step, count)
        xs.append(np.maximum(begin[a], begin[b] - lag))
        lags.append(lag)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *xs]), np.concatenate([empty, *lags])


def find_runs(ids: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs in a row of numbers, by start, then period; none longer than ``longest``."""
    found = _short_runs(ids, least)
    if longest >= 2 * SHORT:
        names = Names(ids, longest)
        low = SHORT
        while 2 * low <= longest:
            level = low.bit_length() - 3  # k-mers of a quarter of the scale
            k, kmers = low >> 2, names.levels[level]
            if (kmers < 0).all():
                break  # a run at this or a later scale would hold some k-mer twice
            at = _minima(kmers, low - k + 1)
            if len(at) > 1:
                x, lag = _seeds(kmers, at, k, low)
                start, end = names.stretch(x, lag)
                run = end - start >= np.maximum(lag, least - lag)
                found.append(np.stack([start, end - start + lag, lag], 1)[run])
            low *= 2
    runs = np.concatenate([np.zeros((0, 3), np.int64), *found])
    # a stretch that also has a shorter period is a run of that one only
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    apart = np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)] if len(runs) else np.zeros(0, bool)
    runs = runs[apart]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _search(texts: list[list[bytes]], least: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(kept words, runs) of each text."""
    parts, at, base = [], [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + base)
        base += len(known) + 1
        parts.append(np.array([base - 1]))  # a number that occurs once ends every text
        at.append(len(words) + 1)
    starts = np.cumsum([0, *at])
    runs = find_runs(np.concatenate(parts), max(map(len, texts)), least)
    cuts = np.searchsorted(runs[:, 0], starts)
    for i, words in enumerate(texts):
        mine = runs[cuts[i]:cuts[i + 1]] - np.array([starts[i], 0, 0])
        if len(mine):
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, mine[:, 0] + mine[:, 2], 1)
            np.add.at(gone, mine[:, 0] + mine[:, 1], -1)
            words = [w for w, g in zip(words, np.cumsum(gone)) if not g]
        yield words, mine


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, batch_words: int = BATCH) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: all maximal runs of each text and the text without their repetitions.

    A run is a stretch of at least ``least`` words and of at least twice its smallest period q, in which words q apart are equal
    and which no neighbouring word continues; ``runs`` holds ``start, length, period`` by start, then period.  ``collapsed`` leaves
    out the words that some run holds after its first q ones; kept words are joined by one space.  Words are parted by ASCII
    white space.  Null and empty texts have no words, no runs and an empty ``collapsed``.  One row per input row, equal rows get
    equal results, ids may be null or repeat, other columns are not read.  An empty table gives no rows.  A text is searched
    whole, by one task, with about 8 * log2(words) bytes a word."""
    rows = picked(docs, id=id, text=text).select("id", text_column("text").cast("binary").alias("text"))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids, texts):
            runs, kept, offsets, n_words = [], [], [0], [len(t) for t in texts]
            for words, found in _search(texts, least):
                kept.append(b" ".join(words))
                runs.append(found)
                offsets.append(offsets[-1] + len(found))
            flat = np.concatenate(runs)
            spans = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
            return pa.record_batch([ids, pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
                                    pa.array(kept, pa.binary())], ["id", "n_words", "runs", "collapsed"])

        for batch in batches:
            texts, held, begin = [], 0, 0
            for i, value in enumerate(batch["text"]):
                words = value.as_py().split()
                if texts and held + len(words) > batch_words:
                    yield done(batch["id"].slice(begin, len(texts)), texts)
                    texts, held, begin = [], 0, i
                texts.append(words)
                held += len(words)
            if texts:
                yield done(batch["id"].slice(begin), texts)

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(search, f"id {kind}, n_words long, runs {RUN_DDL}, collapsed binary")
    return found.withColumns({"collapsed": F.col("collapsed").cast("string")}).withColumnRenamed("id", id)
