"""Routing for exact repeats of a fixed length: which stretches of text can hold one, and to which shard they go.

A window of fixed length owns the place of the least k-gram hash in it, its anchor, and equal windows own equal anchors at equal
distances.  So windows that repeat share an anchor hash, and an anchor hash that occurs once holds no repeat.  The windows that
one anchor owns are consecutive; the stretch they cover is the anchor's form.  Equal forms are aggregated before their text
moves; what is left for one anchor hash is a few distinct forms, which a shard compares.  An anchor with very many distinct
forms (a passage that many documents share, with other text around it) is divided by window hash instead of by anchor.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, runs_of, stored, text_column

U = np.uint64
#: Distinct forms that one shard compares at most; anchors with more are divided by window hash.
HOT_FORMS = 2048
#: Rows of one batch that a task hands back, about; a very long text has a larger one.
OUT_ROWS = 1 << 16


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k (a power of two) units, by doubling."""
    h, base, step = units, 0x9E3779B97F4A7C15, 1
    while step < k:
        h = h[:-step] * U(base) + h[step:]
        base, step = base * base % (1 << 64), step * 2
    return mix(h)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    m, step = values, 1
    while 2 * step <= width:
        m, step = np.minimum(m[:-step], m[step:]), step * 2
    rest = width - step
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def anchors(units: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, number of windows) of each anchor of a text; the leftmost of equal least hashes counts.

    Windows are taken in parts of 2^27 starts, so that a place fits beside the part of the hash that orders them."""
    n = len(units) - length + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = gram_hashes(units, k)
    low, owners = U((1 << 28) - 1), []
    for at in range(0, n, 1 << 27):
        part = grams[at:min(n, at + (1 << 27)) + length - k]
        least = sliding_min((part & ~low) | np.arange(len(part), dtype=U), length - k + 1)
        owners.append((least & low).astype(np.int64) + at)
    owner = np.concatenate(owners)
    cuts = runs_of(owner)
    return grams[owner[cuts[:-1]]], cuts[:-1], np.diff(cuts)


@dataclass(frozen=True)
class Kind:
    """What a text is made of.  ``read`` gives the unit hashes and the bytes of a range of units."""

    length: int
    k: int
    read: Callable[[str], tuple[np.ndarray, Callable[[int, int], bytes]]]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, doc_id, text): rows that repeat an id and a text are one document with one key."""
    rows = picked(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), text_column("text").alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps; it does so only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _hash128(data: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(data)
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def _marks(pieces: Iterator[bytes]) -> np.ndarray:
    """128-bit hash of each piece, as two columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), ">i8").astype(np.int64).reshape(-1, 2)


def _rows_of(found: list[tuple]) -> pa.RecordBatch:
    """One batch of the anchors of several texts: (key, doc_id, hashes, marks, starts, windows) each."""
    keys, ids, hashes, marks, starts, counts = zip(*found)
    text = np.repeat(np.arange(len(found)), [len(h) for h in hashes])
    both = np.concatenate(marks)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()).take(pa.array(text)), pa.array(ids, pa.int64()).take(pa.array(text)),
         pa.array(np.concatenate(hashes).view(np.int64)), pa.array(both[:, 0]), pa.array(both[:, 1]),
         pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(counts).astype(np.int32))],
        names=["key", "doc_id", "h", "f1", "f2", "start", "n"])


def _occurrences(rows: DataFrame, kind: Kind, forms: bool) -> DataFrame:
    """Anchors of all texts: (key, doc_id, h, f1, f2, start, n), or (h, n) counted by batch."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(kind.read(t)[0], kind.length, kind.k)[0] for t in batch["text"].to_pylist()]
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for key, doc_id, text in zip(batch["key"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                units, piece = kind.read(text)
                h, start, n = anchors(units, kind.length, kind.k)
                if not len(h):
                    continue
                marks = _marks(map(piece, start.tolist(), (start + n - 1 + kind.length).tolist()))
                found.append((key, doc_id, h, marks, start, n))
                held += len(h)
                if held >= OUT_ROWS:
                    yield _rows_of(found)
                    found, held = [], 0
            if found:
                yield _rows_of(found)

    if forms:
        return rows.mapInArrow(each, "key long, doc_id long, h long, f1 long, f2 long, start int, n int")
    return rows.select("text").mapInArrow(count, "h long, n long")


@dataclass(frozen=True)
class Repeats:
    """``seen``: occurrences of recurring anchors; ``forms``: distinct forms with count and first occurrence."""

    rows: DataFrame
    kind: Kind
    seen: DataFrame
    forms: DataFrame


def recurring(rows: DataFrame, kind: Kind) -> Repeats:
    """The occurrences of anchors that recur anywhere, and their distinct forms; ``first`` is (doc_id, key, start)."""
    spark = rows.sparkSession
    known = stored(_occurrences(rows, kind, False).groupBy("h").agg(F.sum("n").alias("times")).where("times > 1").select("h"), "recurring")
    tidy(spark)
    seen = stored(_occurrences(rows, kind, True).join(known, "h", "left_semi"), "seen")
    tidy(spark)
    forms = stored(seen.groupBy("h", "f1", "f2").agg(
        F.count(F.lit(1)).alias("count"), F.first("n").alias("n"), F.min(F.struct("doc_id", "key", "start")).alias("first")), "forms")
    many = forms.groupBy("h").agg(F.count(F.lit(1)).alias("n_forms"))
    crowded = stored(many.where(F.col("n_forms") > 1).select("h", (F.col("n_forms") > HOT_FORMS).alias("hot")), "crowded")
    forms = forms.join(crowded, "h", "left")  # hot is null for an anchor with one form
    return Repeats(rows, kind, seen, forms)


def form_texts(found: Repeats, windows: bool) -> DataFrame:
    """Texts of the forms of anchors with several: (h, f1, f2, count, doc_id, key, start, n, piece).

    With ``windows``, for divided anchors, one row per window with its hash (w1, w2) and offset in place of the text."""
    kind = found.kind
    wanted = found.forms.where("hot" if windows else "not hot").select(
        F.col("first.key").alias("key"), F.struct("h", "f1", "f2", "count", F.col("first.start").alias("start"), "n").alias("form"))
    lists = wanted.groupBy("key").agg(F.collect_list("form").alias("forms"))  # at most one form per anchor of the text
    kinds = "h long, f1 long, f2 long, count long, doc_id long, key long, start int, n int"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            out: list[tuple] = []
            for key, doc_id, text, forms in zip(*(batch[c].to_pylist() for c in ("key", "doc_id", "text", "forms"))):
                _, piece = kind.read(text)
                for x in forms:
                    head = (x["h"], x["f1"], x["f2"], x["count"], doc_id, key, x["start"], x["n"])
                    if windows:
                        out += [(*head, i, *_hash128(piece(a, a + kind.length))) for i, a in enumerate(range(x["start"], x["start"] + x["n"]))]
                    else:
                        out.append((*head, piece(x["start"], x["start"] + x["n"] - 1 + kind.length)))
            names = ["h", "f1", "f2", "count", "doc_id", "key", "start", "n", *(["offset", "w1", "w2"] if windows else ["piece"])]
            types = [pa.int64()] * 6 + [pa.int32()] * 2 + ([pa.int32(), pa.int64(), pa.int64()] if windows else [pa.binary()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return found.rows.join(lists, "key").mapInArrow(pieces, kinds + (", offset int, w1 long, w2 long" if windows else ", piece binary"))


def spans_of(starts: np.ndarray, length: int) -> list[list[int]]:
    """Merged [from, to) of the windows at sorted starts."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > length) + 1
    return [[int(p[0]), int(p[-1]) + length] for p in np.split(starts, cuts)]


SPANS = "h long, f1 long, f2 long, spans array<array<int>>"


def spans_batch(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["h", "f1", "f2", "spans"])


def with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (key, doc_id, text) with ``cuts``: an array of (from, to) in units of the text, or null."""
    lists = cuts.groupBy("key").agg(F.collect_set(F.struct("from", "to")).alias("cuts"))  # at most the windows of one text
    return rows.join(lists, "key", "left")


def merged(cuts: list | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((c["from"], c["to"]) for c in cuts or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
