"""Substring deduplication by repeated-phrase automata: of each passage that recurs, the first occurrence stays.

Stretches of words that can hold a passage are found and routed by :mod:`anchors`.  Each shard confirms the passages that
several of its forms hold, compiles them into an Aho-Corasick automaton over word numbers, and streams the forms through it to
locate every occurrence; equal forms of any number of documents are streamed once, with their first occurrence.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .anchors import SPANS, Kind, form_texts, keyed, merged, recurring, spans_batch, spans_of, tidy, with_cuts
from .common import key_runs, stored

#: Words of the forms that share an automaton, about.
SHARD = 1 << 18
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _read(text: str):
    words = text.encode("utf-8", "surrogatepass").split()
    units = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    return units, lambda a, b: b" ".join(words[a:b])


def later_windows(forms: list[tuple[tuple, tuple, int, bytes]], length: int) -> dict[tuple, np.ndarray]:
    """For each form (anchor hash and form hash, first place, number of windows, words): its windows that start earlier elsewhere.

    A place is (doc_id, key, start) of the form's first occurrence; windows of different anchors never agree."""
    number: dict[bytes, int] = {}
    texts = [tuple(number.setdefault(w, len(number) + 1) for w in piece.split(b" ")) for _, _, _, piece in forms]
    times = Counter(itertools.chain.from_iterable((t[i:i + length] for i in range(len(t) - length + 1)) for t in texts))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    confirmed = [w for w, n in times.items() if n > 1]
    del times
    for i, window in enumerate(confirmed):
        automaton.add_word(window, i)
    if not confirmed:
        return {}
    automaton.make_automaton()
    found = [[(end - length + 1, i) for end, i in automaton.iter(t)] for t in texts]
    least: dict[int, tuple] = {}
    place = [(place[0] is not None, place[0] or 0, place[1], place[2]) for _, place, _, _ in forms]
    for (null, doc, key, start), hits in zip(place, found):
        for offset, i in hits:
            here = (null, doc, key, start + offset)
            if i not in least or here < least[i]:
                least[i] = here
    out = {}
    for (form, _, _, _), (null, doc, key, start), hits in zip(forms, place, found):
        later = [offset for offset, i in hits if least[i] < (null, doc, key, start + offset)]
        if later:
            out[form] = np.array(later)
    return out


def _shards(batches, length: int) -> Iterator[pa.RecordBatch]:
    """Spans, in the first occurrence of each form, of the windows that start earlier elsewhere."""
    def solve(forms: dict[tuple, tuple]) -> pa.RecordBatch:
        later = later_windows([(form, *x) for form, x in forms.items()], length)
        return spans_batch([(*form, spans_of(at, length)) for form, at in later.items()])

    held: dict[tuple, tuple] = {}
    size = 0
    for h, rows in key_runs(batches, "h"):
        for f1, f2, doc_id, key, start, n, piece in zip(*(rows[c].to_pylist() for c in ("f1", "f2", "doc_id", "key", "start", "n", "piece"))):
            if (h, f1, f2) not in held:
                held[h, f1, f2] = (doc_id, key, start), n, piece
                size += n + length
        if size >= SHARD:
            yield solve(held)
            held, size = {}, 0
    if held:
        yield solve(held)


def passage_spans(docs: DataFrame, length: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_id, text, cuts) per row: the word ranges covered by windows of ``length`` words that start earlier too."""
    kind = Kind(length, max(1, 1 << max(0, (length // 2).bit_length() - 1)), _read)
    rows = keyed(docs, doc_id, text)
    found = recurring(rows, kind)
    spark = docs.sparkSession
    shards = stored(form_texts(found, False).repartition("h").sortWithinPartitions("h")
                    .mapInArrow(lambda batches: _shards(batches, length), SPANS), "spans")
    tidy(spark)
    # divided anchors: of the windows with one hash of 128 bits, the least place is the first
    windows = stored(form_texts(found, True), "windows")
    here = F.struct("doc_id", "key", (F.col("start") + F.col("offset")).alias("at"))
    least = windows.groupBy("w1", "w2").agg(F.min(here).alias("least"), F.count(F.lit(1)).alias("times")).where("times > 1")
    divided = (windows.join(stored(least, "least_windows"), ["w1", "w2"])
               .where((F.col("least.key") != F.col("key")) | (F.col("least.at") != F.col("start") + F.col("offset")))
               .select("h", "f1", "f2", F.array(F.array(F.col("offset"), F.col("offset") + length)).alias("spans")))
    tidy(spark)
    inner = stored(shards.unionAll(divided).select("h", "f1", "f2", F.explode("spans").alias("span"))
                   .select("h", "f1", "f2", F.col("span")[0].alias("a"), F.col("span")[1].alias("b")), "inner")
    firsts = stored(found.forms.select("h", "f1", "f2", F.col("first.key").alias("first_key"), F.col("first.start").alias("first_start"),
                                       F.col("count")), "firsts")
    # at the first occurrence of a form only its inner spans go; every other occurrence goes whole
    begins = firsts.join(inner, ["h", "f1", "f2"]).select(
        F.col("first_key").alias("key"), (F.col("first_start") + F.col("a")).alias("from"), (F.col("first_start") + F.col("b")).alias("to"))
    others = (found.seen.join(firsts.where("count > 1"), ["h", "f1", "f2"])
              .where("key <> first_key or start <> first_start")
              .select("key", F.col("start").alias("from"), (F.col("start") + F.col("n") - 1 + length).alias("to")))
    return with_cuts(rows, begins.unionAll(others))


def _kept(text: str, cuts: list | None) -> tuple[bytes, int, int]:
    """(kept words joined by a space, words, removed words)."""
    words = text.encode("utf-8", "surrogatepass").split()
    spans = merged(cuts)
    out: list[bytes] = []
    at = 0
    for a, b in spans:
        out += words[at:a]
        at = b
    out += words[at:]
    return b" ".join(out), len(words), len(words) - len(out)


def passage_digests(docs: DataFrame, length: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of ``docs``.

    A word goes if a window of ``length`` words covers it whose words also start earlier: in a document with a smaller id, or
    earlier in the same one.  Null texts have no words.  Null ids come before all others; rows that share an id are ordered by
    a hash of id and text, and rows that repeat an id and its text are one document; an empty table gives an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, cuts in zip(batch["text"].to_pylist(), batch["cuts"].to_pylist()):
                kept, n, removed = _kept(value, cuts)
                out.append((n, removed, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return passage_spans(docs, length, doc_id, text).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_passages(docs: DataFrame, length: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed words cut from the texts; a text that loses nothing stays as it is, with its white space.

    Documents whose words all go are left out, and those without any word stay.  Only a text's own spans of bytes are cut, so
    the kept words keep the white space around them; other columns pass through (a column ``n_chars`` is counted again)."""
    cut = passage_spans(docs, length, doc_id, text).where("cuts is not null").select(
        F.col("key").alias("_key"), F.col("cuts").alias("_cuts")).dropDuplicates(["_key"])
    key = F.xxhash64(docs[doc_id].cast("long"), F.coalesce(docs[text].cast("string"), F.lit("")))
    joined = docs.withColumn("_key", key).join(cut, "_key", "left").drop("_key")
    names = docs.columns

    def strip(value: str, cuts: list) -> str | None:
        data = value.encode("utf-8", "surrogatepass")
        places = [m.span() for m in WORD.finditer(data)]
        out, at, removed = [], 0, 0
        for a, b in merged(cuts):
            out.append(data[at:places[a][0]])
            at = places[b][0] if b < len(places) else len(data)
            removed += b - a
        out.append(data[at:])
        return None if removed == len(places) else b"".join(out).decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch["_cuts"].to_pylist()
            texts = [v if c is None else strip(v, c) for v, c in zip(batch[text].to_pylist(), cuts)]
            stays = [c is None or t is not None for t, c in zip(texts, cuts)]
            columns = {n: batch[n] for n in names}
            columns[text] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if c is None else len(t or "") for n, t, c in zip(batch["n_chars"].to_pylist(), texts, cuts)],
                                              batch["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names).filter(pa.array(stays, pa.bool_()))

    return joined.mapInArrow(run, StructType([f for f in docs.schema.fields]))
