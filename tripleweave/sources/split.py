"""RDF/XML files of any size, read in pieces.

``binaryFile`` holds a file in one row, so a file must fit there and is parsed by one task.  Here a file is read as text
records that end at ``>``, which Spark splits like lines; a record holds at most one tag, so its effect on the depth is known.

No record is stored.  The first reading sums the depth over each block (the piece of a file that one task
reads) and keeps the start of the file up to the root's start tag.  Sums of earlier blocks give the depth at which a block
starts.  In the second reading each block cuts itself into documents: whole children of the root, as many as a batch of records
holds, between a copy of the root's start tag and its end tag.  Only a child that crosses the end of a block is put together
from the fragments that its blocks hand over.

Comments, CDATA sections and attribute values that contain ``>`` or ``<`` would be cut in the wrong place, and children of a root
other than ``rdf:RDF`` share a subject: such files are told apart in the first reading (``block_sums``) and refused with an error
by ``ingest_rdfxml_split``, never misread; :func:`.ingest.ingest` reads them whole.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bound_batches, stored
from .files import Form
from .ingest import BASE_IRI, parse_documents, resolve_base

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BROADCAST = 100_000  # block depths or heads of files sent to every task; larger tables are joined by a shuffle
SUMS_DDL = "file string, block long, delta long, bad boolean, head binary"
PIECES_DDL = "file string, block long, at long, kind string, content binary"
LT, SLASH, BANG, ASK = b"</!?"
TAG = re.compile(rb"<[^<\"']*(?:\"[^\"<]*\"[^<\"']*|'[^'<]*'[^<\"']*)*")
ROOT = r"<([^\s<>!?/]+)[^<>]*>\s*$"


RECORDS = Form(">", sized=True)  # how a scan reads files that are to be split


def records(files: DataFrame) -> DataFrame:
    """``file, block, text`` of a scan in the form ``RECORDS``: the records of files, in order within a block."""
    return files.select(F.col("path").alias("file"), "block", "text")


class _Batch:
    """Records of one block: each one's text, its step in depth, and whether it holds a start or empty tag."""

    def __init__(self, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        self.data, self.starts, self.ends = data, offsets[:-1], offsets[1:]
        n, low, high = len(texts), offsets[0], offsets[-1]
        tags = np.flatnonzero(data[low:high] == LT) + low
        of = np.searchsorted(offsets, tags, "right") - 1
        count = np.bincount(of, minlength=n)
        self.tag_at = np.full(n, -1)
        self.tag_at[of] = tags  # the last one of a record
        has = self.tag_at >= 0
        first = np.where(has & (self.tag_at + 1 < self.ends), data[np.minimum(self.tag_at + 1, max(len(data) - 1, 0))] if len(data) else 0, 0)
        last = data[np.maximum(self.ends - 1, 0)] if len(data) else np.zeros(n, np.uint8)
        closing = has & (first == SLASH)
        self.normal = has & ~closing & (first != BANG) & (first != ASK)
        empty = self.normal & (last == SLASH)
        self.step = np.where(closing, -1, np.where(self.normal & ~empty, 1, 0))
        # what a record boundary may have cut: several '<', quotes that are not plainly paired, comments and CDATA
        quotes = [np.bincount(of_q, minlength=n) for q in b"\"'" for of_q in [np.searchsorted(offsets, np.flatnonzero(data[low:high] == q) + low, "right") - 1]]
        doubtful = (count > 1) | (has & (first == BANG)) | (self.normal & ((quotes[0] % 2 + quotes[1] % 2 > 0) | ((quotes[0] > 0) & (quotes[1] > 0))))
        self.bad = any(self._cut(i, int(count[i])) for i in np.flatnonzero(doubtful))

    def _cut(self, i: int, tags: int) -> bool:
        text = self.text(i)
        if b"<![CDATA[" in text:
            return True
        if b"<!--" in text:
            return tags > 1 or not text.endswith(b"--")
        if re.match(rb"\s*<!DOCTYPE", text):
            return False
        return tags > 1 or (self.normal[i] and not TAG.fullmatch(text[self.tag_at[i] - self.starts[i]:]))

    def text(self, i: int, j: int | None = None) -> bytes:
        """Record i, or records i up to j with the ``>`` that ends each of them."""
        if j is None:
            return self.data[self.starts[i]:self.ends[i]].tobytes()
        if i >= j:
            return b""
        size = self.ends[i:j] - self.starts[i:j]
        at = np.cumsum(size + 1)
        out = np.full(int(at[-1]), ord(">"), np.uint8)
        fill = np.ones(len(out), bool)
        fill[at - 1] = False
        out[fill] = self.data[self.starts[i]:self.ends[j - 1]]
        return out.tobytes()


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Batches cut where the file or the block changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch["block"].to_numpy(zero_copy_only=False)
        file = batch["file"].dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (file[1:] != file[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(block)]):
            yield batch["file"][a].as_py(), int(block[a]), batch.slice(a, b - a)


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, key = [], None
    for file, block, batch in _blocks(batches):
        if (file, block) != key:
            key = (file, block)
            out.append([file, block, 0, False, None])
            head, found = [], block != 0
        rows = _Batch(batch["text"])
        if not found:  # the start of the file, with the start tag of the root
            at = np.flatnonzero(rows.normal)
            head.append(rows.text(0, int(at[0]) + 1 if len(at) else batch.num_rows))
            if len(at):
                found, out[-1][4] = True, b"".join(head)
        out[-1][2] += int(rows.step.sum())
        out[-1][3] |= rows.bad
    columns = list(zip(*out)) or [()] * 5
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in SUMS_DDL.split(", ")])


def block_sums(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First reading of ``file, block, text`` records: (block depths, files), both stored.

    Block depths are ``file, block, before``.  Files are ``file, head, root, whole, splittable``: the bytes up to the root's start tag,
    its name, whether all tags are closed, and whether the file may be cut into pieces."""
    bound_batches(texts.sparkSession)
    sums = texts.mapInArrow(_summed, SUMS_DDL).groupBy("file", "block").agg(
        F.sum("delta").alias("delta"), F.max("bad").alias("bad"), F.max("head").alias("head"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.withColumn("before", F.coalesce(F.sum("delta").over(earlier), F.lit(0).cast("bigint"))), "blocks")
    root = F.regexp_extract(F.make_valid_utf8(F.col("head").cast("string")), ROOT, 1)
    files = sums.groupBy("file").agg(F.max("head").alias("head"), F.sum("delta").alias("left_open"), F.max("bad").alias("bad"))
    files = files.select("file", "head", root.alias("root"), (F.col("left_open") == 0).alias("whole"),
                         (~F.col("bad") & F.coalesce(root.rlike("^([^:]+:)?RDF$"), F.lit(False))).alias("splittable"))
    return sums.select("file", "block", "before"), stored(files, "heads")


class _Cutter:
    """Cuts the records of a block, which come in order, into whole children of the root and fragments of children.

    ``whole`` rows hold children that start and end here, ``rest`` the end of a child of an earlier block and ``open`` the start of
    one that goes on in the next block."""

    def __init__(self, file: str, block: int, before: int):
        self.file, self.block, self.depth = file, block, before
        self.foreign = before > 1
        self.rooted, self.closed = block > 0, False
        self.held: list[bytes] = []
        self.rows: list[tuple] = []
        self.at = 0

    def _flush(self, kind: str) -> None:
        text = b"".join(self.held)
        if text.strip():
            self.rows.append((self.file, self.block, self.at, kind, text))
            self.at += 1
        self.held = []

    def add(self, rows: _Batch) -> None:
        after = self.depth + np.cumsum(rows.step)
        before = after - rows.step
        self.depth = int(after[-1])
        i, n = 0, len(after)
        if not self.rooted:  # up to the root's start tag, which is part of the head
            roots = np.flatnonzero(rows.normal)
            if not len(roots):
                return
            self.rooted, i = True, int(roots[0]) + 1
            self.closed = after[roots[0]] == 0
        if not self.closed:
            ended = np.flatnonzero(after[i:] == 0)
            stop = i + int(ended[0]) if len(ended) else n
            ends = np.flatnonzero((after == 1) & ((before == 2) | (rows.normal & (before == 1))))
            ends = ends[(ends >= i) & (ends < stop)]
            if self.foreign and len(ends):
                self.held.append(rows.text(i, int(ends[0]) + 1))
                self._flush("rest")
                self.foreign, i, ends = False, int(ends[0]) + 1, ends[1:]
            if not self.foreign and len(ends):
                self.held.append(rows.text(i, int(ends[-1]) + 1))
                self._flush("whole")
                i = int(ends[-1]) + 1
            self.held.append(rows.text(i, stop))
            if stop == n:
                return
            self.held.append(rows.text(stop).rpartition(b"<")[0])  # what stands before the root's end tag
            self._flush("whole")
            self.closed, i = True, stop + 1
        if rows.normal[i:].any() or any(rows.text(k).partition(b"<")[0].strip() for k in range(i, n)):
            raise ValueError(f"{self.file}: no well-formed document: content after its root")

    def close(self) -> None:
        self._flush("rest" if self.foreign else "open" if self.depth > 1 else "whole")


def _pieces(kinds: Sequence[str]):
    """Task function: records to pieces of these kinds."""
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            columns = list(zip(*[r for r in rows if r[3] in kinds])) or [()] * 5
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)

        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in PIECES_DDL.split(", ")]
        now, key = None, None
        for file, block, batch in _blocks(batches):
            if (file, block) != key:
                if now:
                    now.close()
                    yield out(now.rows)
                key, now = (file, block), _Cutter(file, block, batch["before"][0].as_py())
            now.add(_Batch(batch["text"]))
            yield out(now.rows)
            now.rows = []
        if now:
            now.close()
            yield out(now.rows)
    return cut


def cut_documents(texts: DataFrame, depths: DataFrame, files: DataFrame) -> DataFrame:
    """Second reading: ``path, part, content`` rows, the splittable ones of ``files`` as documents of their own.

    A child that crosses blocks is put together from its fragments, for which the records are cut once more; all else is cut and
    parsed in one go."""
    bound_batches(texts.sparkSession)
    good = files.where("splittable AND whole")
    known = depths.join(good.select("file"), "file", "left_semi")
    if depths.count() <= BROADCAST:  # the join streams the records past the depths, in their order
        placed = texts.join(F.broadcast(known), ["file", "block"])
    else:
        placed = texts.withColumn("place", F.monotonically_increasing_id()).join(known, ["file", "block"])
        placed = placed.repartition("file", "block").sortWithinPartitions("file", "block", "place")
    placed = placed.select("file", "block", "text", "before")
    whole = placed.mapInArrow(_pieces(["whole"]), PIECES_DDL)
    whole = whole.select("file", F.concat_ws("_", "block", "at").alias("part"), "content")
    cut = placed.mapInArrow(_pieces(["rest", "open"]), PIECES_DDL)
    order = Window.partitionBy("file").orderBy("block", "at")
    cut = cut.withColumn("child", F.sum(F.when(F.col("kind") == "open", 1).otherwise(0)).over(order))
    joined = F.array_sort(F.collect_list(F.struct("block", "at", "content")))
    cut = cut.groupBy("file", "child").agg(F.aggregate(joined, F.lit(b""), lambda text, x: F.concat(text, x["content"])).alias("content"))
    pieces = whole.unionByName(cut.select("file", F.concat(F.lit("c"), "child").alias("part"), "content"))
    heads = good.select("file", "head", F.concat(F.lit("</"), "root", F.lit(">")).cast("binary").alias("tail"))
    heads = F.broadcast(heads) if heads.count() <= BROADCAST else heads
    return pieces.join(heads, "file").select(F.col("file").alias("path"), "part", F.concat("head", "content", "tail").alias("content"))


def parse_pieces(documents: DataFrame, base_iri: str, base_mode: str) -> DataFrame:
    """Triples of :func:`cut_documents`.  That an ``rdf:ID`` is used once is checked within a piece."""
    name = F.element_at(F.split("path", "/"), -1)
    documents = documents.select("path", "content", F.lit("rdfxml").alias("format"), resolve_base(name, base_iri, base_mode).alias("base"),
                                 F.concat(F.lit("p"), "part", F.lit("x")).alias("part"))
    return parse_documents(documents, "failfast", lines=False)


def ingest_rdfxml_split(spark: SparkSession, paths: str | Sequence[str], base_iri: str = BASE_IRI,
                        base_mode: str = "per_file") -> DataFrame:
    """Triples ``s, p, o, g, file`` of RDF/XML files, read in parallel pieces; any error ends the job, and so does a file
    that cannot be split."""
    texts = records(RECORDS.read(spark, [paths] if isinstance(paths, str) else paths, ""))
    depths, files = block_sums(texts)
    why = F.when(~F.col("splittable"), ": markup inside a comment, CDATA section or attribute, or a root that is not rdf:RDF; cannot be split")
    stop = F.raise_error(F.concat("file", why.otherwise(": no well-formed document")))
    refused = files.where("NOT (splittable AND whole)").select(F.col("file").alias("path"), F.lit("").alias("part"), stop.cast("binary").alias("content"))
    return parse_pieces(cut_documents(texts, depths, files).unionByName(refused), base_iri, base_mode)
