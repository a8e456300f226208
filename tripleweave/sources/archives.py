"""Archive expansion: zip and gzip files become their members, inside the tasks that hold them."""

from __future__ import annotations

import gzip
import io
import re
import sys
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from .files import DEFAULT_PATTERNS, FILES_DDL, glob_regex

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed package

EXPANDED_DDL = FILES_DDL + ", error string"
ARROW_SCHEMA = pa.schema([("path", pa.string()), ("filename", pa.string()), ("content", pa.binary()),
                          ("source", pa.string()), ("error", pa.string())])
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
PIECE_BYTES = 4 << 20  # of a text that is handed on in pieces
PIECE = "\u0000"  # no path holds it
READ_ERRORS = (zipfile.BadZipFile, zlib.error, OSError, EOFError, RuntimeError, NotImplementedError, ValueError)


def _inflated_name(name: str) -> str:
    for suffix in (".gz", ".gzip"):
        if name.endswith(suffix):
            return name[: -len(suffix)]
    return name


def _zip_members(path: str, data: bytes, wanted, is_gzip) -> Iterator[tuple[str, str, bytes]]:
    """Wanted members, one in memory at a time; all are read through once first, as one bad member rejects the archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        members = [(i, i.filename.rsplit("/", 1)[-1]) for i in archive.infolist() if not i.filename.endswith("/")]
        members = [(i, name) for i, name in members if wanted(name)]
        for info, _ in members:
            with archive.open(info) as f:
                while f.read(1 << 20):
                    pass
        for info, name in members:
            content, at = archive.read(info), f"{path}:{info.filename}"
            if is_gzip(name):
                try:
                    content, name, at = gzip.decompress(content), _inflated_name(name), at + ":decompressed"
                except READ_ERRORS:
                    pass  # keep the raw member
            yield at, name, content


def _gzip_pieces(data: bytes) -> Iterator[bytes]:
    """Inflated text in pieces of whole lines; all is read through once first, as a bad end rejects the file."""
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        while f.read(1 << 20):
            pass
    held: list[bytes] = []
    size = 0
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        while block := f.read(1 << 20):
            cut = block.rfind(b"\n") + 1
            if cut and size + cut >= PIECE_BYTES:
                yield b"".join([*held, block[:cut]])
                held, size, block = [], 0, block[cut:]
            held.append(block)
            size += len(block)
    yield b"".join(held)


def _expander(archives: Sequence[str], gzips: Sequence[str], wanted: Sequence[str], lines: Sequence[str] = ()):
    """Task function; patterns arrive as regexes.  An archive that cannot be read gives one row with ``error``."""
    def matcher(regexes):
        compiled = [re.compile(r) for r in regexes]
        return lambda name: any(r.match(name) for r in compiled)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_zip, in_gzips, keep = matcher(archives), matcher(gzips), matcher(wanted)
        is_gzip = lambda name: in_gzips(name) or name.endswith((".gz", ".gzip"))
        rows, held = [], 0
        for batch in batches:
            for cells in zip(*[batch.column(i) for i in range(4)]):  # one file at a time out of Arrow's memory
                path, name, content, source = [c.as_py() for c in cells]
                for row in _expand_one(path, name, content, source, is_zip, is_gzip, keep, tuple(lines)):
                    rows.append(row)
                    held += len(row[2] or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield _as_batch(rows)
                        held = 0
        if rows:
            yield _as_batch(rows)
    return expand


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), ARROW_SCHEMA.types)]
    rows.clear()
    return pa.RecordBatch.from_arrays(columns, schema=ARROW_SCHEMA)


def _expand_one(path, name, content, source, is_zip, is_gzip, keep, lines=()) -> Iterator[tuple]:
    """Rows of one file; what cannot be read is one row with an error."""
    if is_zip(name):
        try:
            for at, member, data in _zip_members(path, content, keep, is_gzip):
                yield at, member, data, source, None
        except READ_ERRORS as e:
            yield path, name, None, source, f"zip: {e}"
    elif is_gzip(name):
        try:
            if lines and _inflated_name(name).endswith(lines) and keep(_inflated_name(name)):
                for i, piece in enumerate(_gzip_pieces(content)):
                    yield f"{path}:decompressed{PIECE}{i}" if i else f"{path}:decompressed", _inflated_name(name), piece, source, None
                return
            data = gzip.decompress(content)
        except READ_ERRORS as e:
            yield path, name, None, source, f"gzip: {e}"
            return
        if keep(_inflated_name(name)):
            yield path + ":decompressed", _inflated_name(name), data, source, None
    else:
        yield path, name, content, source, None


def expand_archives(files: DataFrame, archive_patterns: Sequence[str] = ("*.zip",),
                    gzip_patterns: Sequence[str] = ("*.gz", "*.gzip"),
                    patterns: Sequence[str] = DEFAULT_PATTERNS, rebalance: bool = True, lines: Sequence[str] = ()) -> DataFrame:
    """Zip members, inflated gzip files and all other files, with an ``error`` column.

    ``patterns`` choose zip members and inflated names; an empty list takes all.  Gzip is also recognised by
    suffix.  A corrupt archive is one row with ``error`` and no content: see :func:`accepted` and :func:`rejects`.
    ``rebalance`` spreads the members of large archives over the cluster before they are parsed.
    ``lines`` are suffixes of inflated names whose text may come in rows of whole lines: with the same name, the first row with the
    path of the text, the others with a number after it (see :func:`whole_path`), so that no task holds such a text as a whole.
    """
    bound_batches(files.sparkSession)
    regexes = lambda globs: [r for r in map(glob_regex, globs) if r]
    wanted = regexes(patterns) if patterns else ["(?s)^.*$"]
    rows = files.select("path", "filename", "content", "source").mapInArrow(
        _expander(regexes(archive_patterns), regexes(gzip_patterns), wanted, tuple(lines)), EXPANDED_DDL)
    return rows.repartition("path") if rebalance else rows


def whole_path(path: Column) -> Column:
    """The path of a text, of any of its pieces."""
    return F.substring_index(path, PIECE, 1)


def is_first(path: Column) -> Column:
    """Whether a row is a whole file or the first piece of one."""
    return ~path.contains(PIECE)


def accepted(expanded: DataFrame) -> DataFrame:
    return expanded.where(F.col("error").isNull()).drop("error")


def rejects(expanded: DataFrame) -> DataFrame:
    return expanded.where(F.col("error").isNotNull()).select("path", "filename", "source", "error")
