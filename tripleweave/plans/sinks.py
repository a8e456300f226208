"""Result sinks.  A result is written by all tasks into a folder of part files; in name order they make up the document.

Rows keep the order of a sorted result.  Only what is one row by definition, an ASK result as JSON and the run metadata, is one file.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import in_order


def result_name(prefix: str | None, at: datetime, ext: str) -> str:
    return f"{prefix or 'results'}_{at.strftime('%Y%m%d_%H%M%S')}.{ext}"


def _cells(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]


def _text(spark: SparkSession, *lines: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)


def _write_parts(lines: DataFrame, target: str) -> str:
    lines.write.text(target)
    return target


def _write_row(line: DataFrame, target: str) -> str:
    """One file for a result of one row."""
    line.coalesce(1).write.text(target + ".parts")
    spark = line.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(jpath(target + ".parts")) if s.getPath().getName().startswith("part-"))
    fs.rename(part, jpath(target))
    fs.delete(jpath(target + ".parts"), True)
    return target


def csv_cell(c: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line feed; quotes are doubled."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[,"\n]'), quoted).otherwise(c)


def csv_lines(df: DataFrame, escape: bool = True) -> DataFrame:
    """``value``: one CSV line per row, without the header."""
    return df.select(F.concat_ws(",", *[csv_cell(c) if escape else c for c in _cells(df)]).alias("value"))


def tsv_lines(df: DataFrame) -> DataFrame:
    """``value``: tab-joined cells, not escaped."""
    return df.select(F.concat_ws("\t", *_cells(df)).alias("value"))


def json_lines(df: DataFrame) -> DataFrame:
    """``value``: one JSON object of strings per row; unbound cells are empty strings."""
    cells = [c.alias(n) for c, n in zip(_cells(df), df.columns)]
    return df.select(F.to_json(F.struct(*cells)).alias("value"))


def _target(folder: str, prefix: str | None, at: datetime | None, ext: str) -> str:
    return f"{folder.rstrip('/')}/{result_name(prefix, at or datetime.now(timezone.utc), ext)}"


def _table(header: str, rows: DataFrame, target: str) -> str:
    return _write_parts(_text(rows.sparkSession, header).union(rows), target)


def sink_csv(df: DataFrame, folder: str, prefix: str | None = "results", compat: bool = False, at: datetime | None = None) -> str:
    """Header and rows; the first part file is the header.  ``compat`` leaves the cells of a graph result unescaped."""
    graph = df.columns == ["subject", "predicate", "object"]
    rows = csv_lines(df, escape=not (compat and graph))
    return _table(",".join(df.columns), rows, _target(folder, prefix, at, "csv"))


def sink_tsv(df: DataFrame, folder: str, prefix: str | None = "results", at: datetime | None = None) -> str:
    return _table("\t".join(df.columns), tsv_lines(df), _target(folder, prefix, at, "tsv"))


def sink_json(df: DataFrame, folder: str, prefix: str | None = "results", document: bool = False, at: datetime | None = None) -> str:
    """JSON Lines, or with ``document`` parts of one document with type, rows and count.

    A document's rows are checkpointed once, so that their count and the row without a comma before it are those written.
    An ASK result is always one file."""
    target, spark = _target(folder, prefix, at, "json"), df.sparkSession
    if dict(df.dtypes) == {"result": "boolean"}:
        opening = '{\n  "type": "boolean",\n  "result": '
        return _write_row(df.select(F.concat(F.lit(opening), F.col("result").cast("string"), F.lit("\n}")).alias("value")), target)
    if not document:
        return _write_parts(json_lines(df), target)
    rows = in_order(json_lines(df).withColumn("at", F.monotonically_increasing_id()))
    n, first = rows.agg(F.count(F.lit(1)), F.min("at")).first()
    value = F.when(F.col("at") == F.lit(first), F.col("value")).otherwise(F.concat(F.lit(","), F.col("value")))
    graph = df.columns == ["subject", "predicate", "object"]
    opening = ["{", '  "type": "graph",', '  "triples": ['] if graph else [
        "{", '  "type": "solutions",', f'  "variables": {json.dumps(df.columns, ensure_ascii=False)},', '  "results": [']
    closing = _text(spark, "  ],", f'  "count": {n}', "}")
    return _write_parts(_text(spark, *opening).union(rows.select(value.alias("value"))).union(closing), target)


META_DDL = ("pipeline_name string, timestamp timestamp, files_loaded bigint, triples_loaded bigint, "
            "load_time_ms bigint, query_time_ms bigint, result_count bigint")


def metadata_lines(meta: DataFrame) -> DataFrame:
    """``key: value`` lines of the one-row run metadata, in a fixed order."""
    secs = lambda c: F.format_string("%.3f", F.col(c) / 1000.0)
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ssXXX")
    entries: Sequence[tuple[str, Column]] = [
        ("pipeline_name", F.col("pipeline_name")), ("timestamp", stamp), ("files_loaded", F.col("files_loaded")),
        ("triples_loaded", F.col("triples_loaded")), ("load_time_ms", F.col("load_time_ms")),
        ("load_time_secs", secs("load_time_ms")), ("query_time_ms", F.col("query_time_ms")),
        ("query_time_secs", secs("query_time_ms")), ("result_count", F.col("result_count"))]
    line = F.array_join(F.array(*[F.concat(F.lit(k + ": "), v.cast("string")) for k, v in entries]), "\n")
    return meta.select(line.alias("value"))


def sink_metadata(meta: DataFrame, folder: str, prefix: str | None = "results", at: datetime | None = None) -> str:
    target = _target(folder, prefix, at, "metadata")
    return _write_row(metadata_lines(meta), target)
