"""Exact substring deduplication by suffix arrays over shards of the text.

Stretches that can hold a repeat are found and routed by :mod:`anchors`.  Each shard joins its distinct forms into one
string and sorts its suffixes by induced sorting: suffixes are classified, leftmost-smaller substrings are sorted and named, the
string of names is sorted recursively, and the order is induced for all suffixes.  The scans of induced sorting run over
whole buckets with numpy.  From the suffix array come permuted common prefixes (irreducible ones are compared, the others follow
from their left neighbour); a place whose prefix common with a neighbour reaches the length is the start of a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import SPANS, Kind, form_texts, keyed, merged, recurring, spans_batch, spans_of, tidy, with_cuts
from .common import key_runs, stored

#: Bytes of the forms that are sorted together, about.
SHARD = 1 << 20


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts)


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last counts as such."""
    n = len(s)
    rising = np.zeros(n, bool)
    rising[-1] = True
    change = np.flatnonzero(s[1:] != s[:-1])
    rising[change] = s[change] < s[change + 1]
    following = np.searchsorted(change, np.arange(n - 1))  # the next change decides for a run of equal symbols
    inside = following < len(change)
    rising[:-1][inside] = rising[change[following[inside]]]
    rising[:-1][~inside] = False
    return rising


def _put(sa: np.ndarray, s: np.ndarray, chunk: np.ndarray, place: np.ndarray, wanted: np.ndarray, step: int) -> None:
    """Induce from the suffixes of a chunk, in order: those before them of the wanted type go to their buckets."""
    j = chunk - 1
    j = j[j >= 0]
    j = j[wanted[j]]
    if not len(j):
        return
    symbol = s[j]
    order = np.argsort(symbol, kind="stable")
    j, symbol = j[order], symbol[order]
    head = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
    size = np.diff(np.r_[head, len(j)])
    within = np.arange(len(j)) - np.repeat(head, size)
    sa[place[symbol] + step * within] = j
    place[symbol[head]] += step * size


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The suffix array given the leftmost-smaller suffixes in order (or sorted substrings, given them in any order)."""
    sa = np.full(len(s), -1, np.int64)
    end = _ends(counts)
    begin = end - counts
    symbols = np.flatnonzero(counts)
    group = np.argsort(s[lms], kind="stable")
    of_lms = lms[group]
    lms_end = np.cumsum(np.bincount(s[lms], minlength=len(counts)))
    front, large = begin.copy(), ~small
    for c in symbols:
        at = begin[c]
        while at < front[c]:
            upto = front[c]
            _put(sa, s, sa[at:upto], front, large, 1)
            at = upto
        lms_begin = lms_end[c - 1] if c else 0
        if lms_begin < lms_end[c]:
            _put(sa, s, of_lms[lms_begin:lms_end[c]], front, large, 1)
    back = end - 1
    # the last suffix has no successor to be induced from
    sa[back[s[-1]]] = len(s) - 1
    back[s[-1]] -= 1
    for c in symbols[::-1]:
        at = end[c] - 1
        while at > back[c]:
            upto = back[c]
            _put(sa, s, sa[upto + 1:at + 1][::-1], back, small, -1)
            at = upto
        if begin[c] < front[c]:
            _put(sa, s, sa[begin[c]:front[c]][::-1], back, small, -1)
    return sa


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings in text order, equal ones alike, from their sorted places."""
    length = np.zeros(len(s), np.int64)
    length[lms] = np.diff(np.r_[lms, len(s) - 1])
    size = length[ordered]
    same = size[1:] == size[:-1]
    left, right = ordered[:-1], ordered[1:]
    live, offset = np.flatnonzero(same), 0
    while len(live):
        equal = s[left[live] + offset] == s[right[live] + offset]
        same[live[~equal]] = False
        offset += 1
        live = live[equal & (size[live] >= offset)]
    same &= (left != len(s) - 1) & (right != len(s) - 1)
    name = np.zeros(len(s), np.int64)
    name[ordered] = np.r_[0, np.cumsum(~same)]
    return name[lms]


def _doubling(s: np.ndarray) -> np.ndarray:
    """Suffix order of a string over a large alphabet, by sorting pairs of ranks."""
    n, rank, step = len(s), s.astype(np.int64), 1
    while True:
        pair = rank * (n + 1)
        pair[:-step] += rank[step:] + 1
        order = np.argsort(pair)
        ranked = pair[order]
        fresh = np.r_[0, np.cumsum(ranked[1:] != ranked[:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of symbols whose last one is smaller than all others and occurs once.

    The names are sorted by the same steps while they are few, and by rank doubling once they are many: a scan by buckets
    gains nothing from buckets of a suffix or two."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    small = _types(s)
    counts = np.bincount(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        induced = _induce(s, small, lms, counts)
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        names = _names(s, lms, induced[is_lms[induced]])
        most = int(names.max()) + 1
        if most == len(lms):
            order = np.argsort(names)
        else:
            order = suffix_array(names) if most <= 512 else _doubling(names)
        lms = lms[order]
    return _induce(s, small, lms, counts)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, common): the suffix before each place's in order (itself for the first), and their common prefix length."""
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[0]], before[sa[1:]] = sa[0], sa[:-1]
    place = np.arange(n)
    # where the symbols to the left agree, the prefix is the left neighbour's less one
    chained = np.zeros(n, bool)
    left = (before > 0) & (place > 0) & (before != place)
    chained[left] = (s[place[left] - 1] == s[before[left] - 1]) & (before[place[left] - 1] == before[left] - 1)
    open_ = np.flatnonzero(~chained & (before != place))
    data = np.concatenate((s.astype(np.uint8), np.zeros(16, np.uint8)))
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    common = np.zeros(n, np.int64)
    while len(open_):
        a, b = open_ + common[open_], before[open_] + common[open_]
        differ = words[a] ^ words[b]
        equal = differ == 0
        ended = open_[~equal]
        lowest = differ[~equal] & (~differ[~equal] + np.uint64(1))
        common[ended] += np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) >> 3
        open_ = open_[equal]
        common[open_] += 8
    # fill the chains from their heads
    head = np.maximum.accumulate(np.where(~chained, place, 0))
    return before, np.where(chained, common[head] - (place - head), common)


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, the starts of the strings of the length that start anywhere else in the pieces too.

    Bytes are UTF-8, which never uses the value that separates pieces; one is added so that zero can end the string."""
    joined = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    s = np.append(np.where(joined == 255, 255, joined + 1), 0).astype(np.uint8)
    sa = suffix_array(s)
    before, common = permuted_prefixes(s, sa)
    repeated = common >= length
    repeated[before[repeated]] = True
    out, at = [], 0
    for piece in pieces:
        out.append(np.flatnonzero(repeated[at:at + max(0, len(piece) - length + 1)]))
        at += len(piece) + 1
    return out


def _read(text: str):
    data = text.encode("utf-8", "surrogatepass")
    return np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), lambda a, b: data[a:b]


def _shards(batches, length: int) -> Iterator[pa.RecordBatch]:
    """Spans of the repeats of forms that occur once; the forms of one anchor are sorted in one shard."""
    def solve(forms: dict[tuple, tuple[int, bytes]]) -> pa.RecordBatch:
        starts = repeated_starts([p for _, p in forms.values()], length)
        return spans_batch([(*form, spans_of(at, length)) for (form, (count, _)), at in zip(forms.items(), starts) if count == 1 and len(at)])

    held: dict[tuple, tuple[int, bytes]] = {}
    size = 0
    for h, rows in key_runs(batches, "h"):
        for f1, f2, count, piece in zip(*(rows[c].to_pylist() for c in ("f1", "f2", "count", "piece"))):
            if (h, f1, f2) not in held:
                held[h, f1, f2] = count, piece
                size += len(piece)
        if size >= SHARD:
            yield solve(held)
            held, size = {}, 0
    if held:
        yield solve(held)


def repeat_spans(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_id, text, cuts) per row: the byte ranges covered by strings of ``length`` bytes that start anywhere else too."""
    kind = Kind(length, 32 if length >= 64 else max(1, 1 << ((length // 2).bit_length() - 1)), _read)
    rows = keyed(docs, doc_id, text)
    found = recurring(rows, kind)
    spark = docs.sparkSession
    shards = stored(form_texts(found, False).repartition("h").sortWithinPartitions("h")
                    .mapInArrow(lambda batches: _shards(batches, length), SPANS), "spans")
    tidy(spark)
    # divided anchors: a window repeats if its hash of 128 bits occurs again
    windows = stored(form_texts(found, True), "windows")
    again = windows.groupBy("w1", "w2").agg(F.sum("count").alias("times")).where("times > 1").select("w1", "w2")
    divided = (windows.where("count = 1").join(again, ["w1", "w2"], "left_semi")
               .select("h", "f1", "f2", F.array(F.array(F.col("offset"), F.col("offset") + length)).alias("spans")))
    tidy(spark)
    inner = stored(shards.unionAll(divided).select("h", "f1", "f2", F.explode("spans").alias("span"))
                   .select("h", "f1", "f2", F.col("span")[0].alias("a"), F.col("span")[1].alias("b")), "inner")
    # a form that occurs again repeats whole
    whole = stored(found.forms.where("count > 1").select("h", "f1", "f2"), "whole")
    cuts = (found.seen.join(inner, ["h", "f1", "f2"]).select("key", (F.col("start") + F.col("a")).alias("from"), (F.col("start") + F.col("b")).alias("to"))
            .unionAll(found.seen.join(whole, ["h", "f1", "f2"], "left_semi")
                      .select("key", F.col("start").alias("from"), (F.col("start") + F.col("n") - 1 + length).alias("to"))))
    return with_cuts(rows, cuts)


def _kept(data: bytes, cuts: list | None) -> tuple[bytes, int, int]:
    spans = merged(cuts)
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]), sum(b - a for a, b in spans), len(spans)


def repeat_digests(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs``.

    Each byte that a string of ``length`` bytes covers which also starts anywhere else, in any document, is removed; matches
    stay within a document and are judged on the input.  Null texts are empty.  Rows that repeat an id and its text count as
    copies of each other; null ids are passed on; an empty table gives an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, cuts in zip(batch["text"].to_pylist(), batch["cuts"].to_pylist()):
                data = value.encode("utf-8", "surrogatepass")
                kept, removed, spans = _kept(data, cuts)
                out.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeat_spans(docs, length, doc_id, text).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
