"""Files as a DataFrame ``path, filename, content, source``: scans, name patterns, unions and filters.

Any storage Hadoop can reach works, by URI.  Spark lists on the driver and reads on the executors; names that
start with ``_`` or ``.`` are invisible to Spark's file index, so asking for one explicitly only warns.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_DDL = "path string, filename string, content binary, source string"
DEFAULT_PATTERNS = ("*.xml", "*.rdf")
LOOKUPS = 32  # explicit names looked up at a time


# --- name patterns ------------------------------------------------------------------------------------

def glob_regex(pattern: str) -> str | None:
    """Anchored regex of a glob (``*``, ``?``, ``[..]``, ``[!..]``; no alternation); None if it is malformed."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            run = len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            if run > 2 or (run == 2 and pattern != "**"):
                return None
            out.append(".*")
            i += run
        elif c == "?":
            out.append(".")
            i += 1
        elif c == "[":
            start = i + 2 if pattern[i + 1:i + 2] == "!" else i + 1
            end = pattern.find("]", start + 1)
            if end < 0:
                return None
            body = re.sub(r"([\\\[\]^&~|])", r"\\\1", pattern[start:end])
            out.append(f"[{'^' if start == i + 2 else ''}{body}]")
            i = end + 1
        else:
            out.append(re.escape(c))
            i += 1
    return "(?s)^" + "".join(out) + "$"


def any_glob(col: Column, patterns: Sequence[str]) -> Column:
    """Whether any well-formed pattern matches; malformed ones are ignored."""
    regexes = [r for r in map(glob_regex, patterns) if r]
    return reduce(lambda a, b: a | b, [col.rlike(r) for r in regexes], F.lit(False))


def match_glob(col: Column, patterns: Sequence[str] = DEFAULT_PATTERNS) -> Column:
    """Any-of match on a file name; an empty list matches everything."""
    return any_glob(col, patterns) if patterns else F.lit(True)


def _listing_filter(patterns: Sequence[str]) -> str | None:
    """One Hadoop glob for simple patterns, so that other files are dropped while listing, before any read."""
    if patterns and all(re.fullmatch(r"[\w.*?-]+", p) and "**" not in p for p in patterns):
        return "{" + ",".join(patterns) + "}" if len(patterns) > 1 else patterns[0]
    return None


# --- scans --------------------------------------------------------------------------------------------

def _plain(uri: Column) -> Column:
    """A path or name as Spark's file metadata gives it, without its escapes; cheap for one without any, as records repeat it."""
    return F.when(uri.contains("%"), F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))).otherwise(uri)


@dataclass(frozen=True)
class Form:
    """What a scan reads of each file: its content, or its records (``text``, with the ``block`` that holds them).

    ``record_end`` separates records, '' stands for any line end.  A filter on ``path``, ``filename`` or ``size`` alone drops files
    from the listing, before any of them is opened."""

    record_end: str | None = None
    sized: bool = False

    @property
    def kinds(self) -> dict[str, str]:
        held = {"content": "binary"} if self.record_end is None else {"text": "binary", "block": "long"}
        return {"path": "string", "filename": "string", **held, **({"size": "long"} if self.sized else {}), "source": "string"}

    def read(self, spark: SparkSession, paths: Sequence[str], source: str, **options: str) -> DataFrame:
        """Paths are literal: glob characters in them stand for themselves."""
        reader = spark.read.format("binaryFile" if self.record_end is None else "text").options(**options)
        if self.record_end:
            reader = reader.option("lineSep", self.record_end)
        df = reader.load([literal_path(p) for p in paths])
        cells = {"path": _plain(F.col("_metadata.file_path")), "filename": _plain(F.col("_metadata.file_name")),
                 "size": F.col("_metadata.file_size"), "source": F.lit(source)}
        if self.record_end is not None:
            cells |= {"text": F.col("value").cast("binary"), "block": F.col("_metadata.file_block_start")}
        return df.select(*[cells.get(c, F.col(c)).alias(c) for c in self.kinds])

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], ", ".join(f"{c} {kind}" for c, kind in self.kinds.items()))


WHOLE, SIZED, LINES = Form(), Form(sized=True), Form("", sized=True)
RECURSIVE = {"recursiveFileLookup": "true"}


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def literal_path(path: str) -> str:
    """A path for Spark's readers whose glob characters are not expanded."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _status(spark: SparkSession, path: str):
    """Status of a path, None if there is nothing."""
    fs, p = _fs(spark, path)
    try:
        return fs.getFileStatus(p)
    except Py4JJavaError as e:
        if "FileNotFoundException" in str(e.java_exception):
            return None
        raise


def _readable(spark: SparkSession, files: Sequence[str]) -> list[str]:
    """Explicit paths that exist, are files and are visible to Spark; the others are warned about.  One call per path, many
    at a time: a store answers each in milliseconds, but a list of them in turn would add up."""
    with ThreadPoolExecutor(LOOKUPS) as pool:
        found = list(pool.map(lambda f: _status(spark, f), files))
    keep = []
    for f, status in zip(files, found):
        if status is None:
            warnings.warn(f"explicit file does not exist: {f}")
        elif not status.isFile():
            warnings.warn(f"not a file: {f}")
        elif f.rstrip("/").rsplit("/", 1)[-1].startswith(("_", ".")):
            warnings.warn(f"Spark does not read hidden files: {f}")
        else:
            keep.append(f)
    return keep


def _explicit(spark: SparkSession, files: Sequence[str], source: str, form: Form) -> DataFrame | None:
    keep = _readable(spark, files)
    return form.read(spark, keep, source, **RECURSIVE) if keep else None


def _directory(spark: SparkSession, path: str, patterns: Sequence[str], recursive: bool, source: str, form: Form) -> DataFrame:
    options = dict(RECURSIVE)
    listing = _listing_filter(patterns)
    if listing:
        options["pathGlobFilter"] = listing
    df = form.read(spark, [path], source, **options).where(match_glob(F.col("filename"), patterns))
    if not recursive:  # a filter on the listing, so that folders named like partitions (k=v) are folders like others
        fs, p = _fs(spark, path)
        df = df.where(F.regexp_replace("path", "/[^/]*$", "") == fs.makeQualified(p).toString())
    return df


def scan_files(spark: SparkSession, path: str | None = None, files: Sequence[str] = (),
               patterns: Sequence[str] = DEFAULT_PATTERNS, recursive: bool = True, source: str | None = None,
               form: Form = WHOLE) -> DataFrame:
    """Files of a directory whose name matches a pattern, plus explicitly listed ones (not matched, not de-duplicated).

    ``path`` may be one file, which is taken whatever its name.  A missing ``path`` is an error, a missing
    explicit file is skipped with a warning.
    """
    if source is None:
        source = f"local:{path}" if path else f"local:[{len(files)} files]" if files else "local:empty"
    parts = [_explicit(spark, files, source, form)] if files else []
    if path:
        status = _status(spark, path)
        if status is None:
            raise FileNotFoundError(f"path does not exist: {path}")
        parts.append(form.read(spark, [path], source, **RECURSIVE) if status.isFile()
                     else _directory(spark, path, patterns, recursive, source, form))
    elif not files:
        warnings.warn("no path or files given")
    return reduce(DataFrame.unionByName, [x for x in parts if x is not None] or [form.empty(spark)])


def scan_store(spark: SparkSession, root: str, prefix: str = "", files: Sequence[str] = (),
               patterns: Sequence[str] = DEFAULT_PATTERNS, source: str | None = None, form: Form = WHOLE) -> DataFrame:
    """Objects below ``root/prefix`` (always recursive) plus explicit keys, each object once.

    Keys that cannot be read are skipped; with explicit keys and no prefix nothing is listed.  ``path`` is the key.
    """
    root = root.rstrip("/")
    if source is None:
        source = f"{root}/[{len(files)} files]" if files else f"{root}/{prefix}"
    parts = [_explicit(spark, [f"{root}/{k}" for k in files], source, form)] if files else []
    if prefix or not files:
        base = f"{root}/{prefix.strip('/')}".rstrip("/")
        if _status(spark, base) is not None:
            parts.append(_directory(spark, base, patterns, True, source, form))
    df = reduce(DataFrame.unionByName, [x for x in parts if x is not None] or [form.empty(spark)])
    qualified = _fs(spark, root)[0].makeQualified(_fs(spark, root)[1]).toString().rstrip("/") + "/"
    key = F.when(F.col("path").startswith(qualified), F.substring(F.col("path"), len(qualified) + 1, 1 << 20)).otherwise(F.col("path"))
    df = df.withColumn("path", key)
    if not (files and prefix):
        return df
    # a key named explicitly and found by listing: drop the listed one
    listed = parts[-1].withColumn("path", key).where(~F.col("path").isin(list(files)))
    return listed if parts[0] is None else parts[0].withColumn("path", key).unionByName(listed)


def _configure(spark: SparkSession, **settings) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in settings.items():
        if value is not None:
            conf.set(key, str(value))


def store_root(kind: str, **options) -> str:
    """URI that the paths of a source are relative to; '' for local files, whose paths are whole URIs."""
    if kind == "s3":
        return f"s3a://{options['bucket']}"
    if kind == "azure":
        host = options.get("endpoint") or f"{options['account']}.dfs.core.windows.net"
        return f"abfss://{options['container']}@" + re.sub(r"^https?://", "", host).rstrip("/")
    return f"gs://{options['bucket']}" if kind == "gcs" else ""


def scan_s3(spark: SparkSession, bucket: str, prefix: str = "", region: str | None = None, endpoint: str | None = None,
            files: Sequence[str] = (), patterns: Sequence[str] = DEFAULT_PATTERNS, form: Form = WHOLE) -> DataFrame:
    """S3 bucket through ``s3a://``; credentials come from the environment or the Hadoop configuration."""
    own = f"fs.s3a.bucket.{bucket}."
    _configure(spark, **{own + "endpoint.region": region, own + "endpoint": endpoint,
                         own + "path.style.access": "true" if endpoint else None})
    name = f"s3://{bucket}/[{len(files)} files]" if files else f"s3://{bucket}/{prefix}"
    return scan_store(spark, store_root("s3", bucket=bucket), prefix, files, patterns, name, form)


def scan_azure(spark: SparkSession, account: str, container: str, prefix: str = "", endpoint: str | None = None,
               skip_signature: bool = False, files: Sequence[str] = (),
               patterns: Sequence[str] = DEFAULT_PATTERNS, form: Form = WHOLE) -> DataFrame:
    """Azure container through ``abfss://``; ``skip_signature`` reads it anonymously."""
    root = store_root("azure", account=account, container=container, endpoint=endpoint)
    if skip_signature:
        _configure(spark, **{f"fs.azure.account.auth.type.{root.split('@', 1)[1]}": "Anonymous"})
    name = f"azure://{container}/" + (f"[{len(files)} files]" if files else prefix)
    return scan_store(spark, root, prefix, files, patterns, name, form)


def scan_gcs(spark: SparkSession, bucket: str, prefix: str = "", service_account_key: str | None = None,
             endpoint: str | None = None, files: Sequence[str] = (),
             patterns: Sequence[str] = DEFAULT_PATTERNS, form: Form = WHOLE) -> DataFrame:
    """GCS bucket through ``gs://``; the key is the JSON of a service account.  ``endpoint`` is accepted and has no effect."""
    if service_account_key:
        key = json.loads(service_account_key)
        _configure(spark, **{"fs.gs.auth.service.account.email": key.get("client_email"),
                             "fs.gs.auth.service.account.private.key.id": key.get("private_key_id"),
                             "fs.gs.auth.service.account.private.key": key.get("private_key")})
    name = f"gs://{bucket}/[{len(files)} files]" if files else f"gs://{bucket}/{prefix}"
    return scan_store(spark, store_root("gcs", bucket=bucket), prefix, files, patterns, name, form)


# --- combining and filtering --------------------------------------------------------------------------

def union_sources(spark: SparkSession, *loaders: Callable[[], DataFrame], form: Form = WHOLE) -> DataFrame:
    """All sources together; one that fails is warned about and contributes nothing."""
    parts = []
    for load in loaders:
        try:
            parts.append(load())
        except Exception as e:  # any storage error: the other sources still count
            warnings.warn(f"source failed: {e}")
    return reduce(DataFrame.unionByName, parts) if parts else form.empty(spark)


def filter_files(files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Keep names that match an include pattern (or there is no valid one) and no exclude pattern."""
    name = F.col("filename")
    wanted = any_glob(name, include) if any(map(glob_regex, include)) else F.lit(True)
    return files.where(wanted & ~any_glob(name, exclude))
