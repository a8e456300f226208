"""Helpers of the text operators: typed columns, key runs in sorted partitions, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches, stored

__all__ = ["Links", "components", "key_runs", "picked", "runs_of", "stored", "table", "text_column"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that further columns cannot clash."""
    bound_batches(df.sparkSession)
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def text_column(name: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def runs_of(keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal neighbours, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


def key_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """(key, rows) for each run of equal values of a long column; the input is sorted by it within the partition.

    Only the rows of one key are held back from batch to batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy(zero_copy_only=False)
        cuts = runs_of(keys)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and keys[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


class Links:
    """Union-find over the positions of one task's rows, joined by whole arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            low, high = np.minimum(ra[apart], rb[apart]), np.maximum(ra[apart], rb[apart])
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (a > b): every neighbour is tied to the least one.

    The least neighbour of each node is a partial aggregate, so hubs are combined before the shuffle; it is stored,
    so that the join back has plain shuffles on both sides and adaptive execution can split a hub's rows."""
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        ends = ends.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = stored(ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    tied = ends.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; the component is its least node.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges are stars.  Each round is written to
    the shared scratch folder; only counts and one checksum come to the driver.  Null ends and self-links are ignored."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = stored(links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
                   .where(x.isNotNull() & y.isNotNull() & (x != y)).distinct(), "edges")
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if not now[0] or now == seen:
            break
        seen = now
        edges = stored(_star(stored(_star(edges, True), "large"), False), "small")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
