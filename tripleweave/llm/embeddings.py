"""Near-duplicates of embeddings: sign hashing by random hyperplanes in several tables, exact cosines, components.

Equal vectors of a label collapse into one class with a count.  A class falls into one bucket per table: the signs of its
products with that table's random directions.  Buckets are divided into blocks of bounded size, and every pair of blocks of a
bucket is one unit of work, compared by exact cosines in double precision.  A pair that meets in several tables is counted in
the first one only, so link counts need no list of pairs; links leave a unit as a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Links, components, key_runs, picked, stored

#: Classes of one block at most, about.
BLOCK = 256


def hashing(threshold: float, recall: float, rows: int, dim: int, seed: int) -> tuple[np.ndarray, int]:
    """Random directions (tables, bits, dim) and the number of tables.

    Bits grow with the logarithm of the largest label's rows, so that buckets of unrelated vectors keep their size; tables
    follow from the wanted recall of a pair right at the threshold."""
    bits = max(6, min(30, math.ceil(math.log2(max(rows, 1) / 32 + 1)) + 4))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))
    return np.random.default_rng(seed).standard_normal((tables, bits, dim)), tables


def _signatures(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    tables, bits, _ = planes.shape
    # one product per bit: the sums do not depend on which rows share a batch, so equal vectors have equal signs
    out = np.zeros((len(vectors), tables), np.int64)
    for t in range(tables):
        for b in range(bits):
            out[:, t] |= (np.einsum("ij,j->i", vectors, planes[t, b]) > 0).astype(np.int64) << b
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _compare(batches, threshold: float) -> Iterator[pa.RecordBatch]:
    """For each unit: (a, b, n) with n the linked vectors that the pair's other blocks add, and b a spanning link or null."""
    for _, rows in key_runs(batches, "unit"):
        part, node, size = (rows[c].to_numpy() for c in ("part", "node", "copies"))
        number = int(rows["number"][0].as_py())
        vectors, marks = _matrix(rows["vector"]).astype(np.float64), _matrix(rows["marks"])
        vectors /= np.abs(vectors).max(axis=1, keepdims=True)  # squares of very large or small parts would be lost
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        first, second = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
        own = not len(second) and bool(rows["own"][0].as_py())
        if own:
            second = first
        if not len(first) or not len(second):
            continue
        cosine = (vectors[first] @ vectors[second].T) / (norms[first][:, None] * norms[second][None, :])
        a, b = np.nonzero(cosine >= threshold)
        if own:
            a, b = a[a < b], b[a < b]
        a, b = first[a], second[b]
        new = ~(marks[a, :number] == marks[b, :number]).any(axis=1)
        links, found = Links(len(node)), np.zeros(len(node), np.int64)
        links.add(a, b)
        np.add.at(found, a[new], size[b[new]])
        np.add.at(found, b[new], size[a[new]])
        told = np.flatnonzero((found > 0) | (links.root != np.arange(len(node))))
        if len(told):
            root = links.root[told]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[told]), pa.array(node[root], mask=root == told), pa.array(found[told])], names=["a", "b", "n"])


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                 threshold: float = 0.93, recall: float = 0.97, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row.

    Vectors are compared within equal labels only.  A null label, a null, empty or zero vector, and one with null or
    non-finite parts link with nothing; vectors of different lengths do not link.  Copies and repeated rows link with each
    other.  A null vec_id counts as a link of the others, has a null component unless its copies have ids, and is not
    kept.  Directions are random but seeded: pairs at the threshold are found with the given recall, nearer ones more often."""
    spark = rows.sparkSession
    base = picked(rows, vec_id=vec_id, vector=embedding, label=label).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"), "label")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("label").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    base = stored(base.withColumn("vector", F.when(sound, F.col("vector"))), "vectors")
    classes = stored(base.where("vector is not null").groupBy("label", "vector")
                     .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
                     .withColumn("node", F.coalesce("least", F.xxhash64("label", "vector"))), "classes")
    sizes = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    shapes = [r[0] for r in classes.select(F.size("vector").alias("d")).distinct().orderBy("d").collect()]
    edges = None
    for dim in shapes:  # one in practice
        found = _links_of(classes.where(F.size("vector") == dim), dim, sizes, threshold, recall, block, seed)
        edges = found if edges is None else edges.unionAll(found)
    if edges is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    edges = stored(edges, "near")
    joined = components(edges.where("b is not null"))
    counts = edges.groupBy("a").agg(F.sum("n").alias("n"))
    facts = stored(classes.select("node", "label", "vector", "copies", "least").join(counts, F.col("a") == F.col("node"), "left")
                   .join(joined, "node", "left")
                   .select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                           F.coalesce("component", "least").alias("component_id")), "facts")
    out = base.join(facts, ["label", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _links_of(classes: DataFrame, dim: int, rows: int, threshold: float, recall: float, block: int, seed: int) -> DataFrame:
    planes, tables = hashing(threshold, recall, rows, dim, seed)

    def sign(batches):
        for batch in batches:
            vectors = _matrix(batch["vector"]).astype(np.float64)
            length = np.abs(vectors).max(axis=1, keepdims=True)  # signs do not depend on the length
            marks = _signatures(vectors / length, planes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(marks), pa.list_(pa.int64()))], names=[*batch.schema.names, "marks"])

    signed = stored(classes.select("node", "label", "vector", "copies").mapInArrow(
        sign, f"node long, label {dict(classes.dtypes)['label']}, vector array<double>, copies long, marks array<long>"), "signed")
    bucketed = signed.select("*", F.posexplode("marks").alias("number", "mark"))
    blocks = stored(bucketed.groupBy("label", "number", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                    .select("label", "number", "mark", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "blocks")
    # the rows of a bucket go to the pairs of blocks that hold their own block
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = (bucketed.join(blocks, ["label", "number", "mark"]).withColumn("mine", mine)
              .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    units = placed.select(
        "node", "vector", "marks", "copies", "number", F.xxhash64("label", "number", "mark", low, high).alias("unit"),
        (F.col("mine") > F.col("other")).cast("int").alias("part"), (F.col("mine") == F.col("other")).alias("own"))
    return (units.repartition("unit").sortWithinPartitions("unit")
            .mapInArrow(lambda batches: _compare(batches, threshold), "a long, b long, n long"))
