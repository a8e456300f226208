"""SimHash fingerprints and near-duplicates by tiled exact comparison.

Equal fingerprints collapse first.  Distinct ones are laid out in tiles by the numbers of set bits in their four quarters:
two fingerprints within a radius r have quarter counts that differ by r in sum at most, so a tile is only compared with the
tiles at that distance, each pair of tiles once, and all others are skipped.  Large tiles are divided by hash into blocks of
bounded size, and every pair of blocks is one unit of work: numpy exclusive-or and bit counts over all its pairs.  A unit
returns a spanning forest of its links, never all pairs; connected components then join the forests.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Links, components, key_runs, picked, stored

#: Fingerprints of one block at most, about; the work of a unit is bounded by its square.
BLOCK = 1024
#: Shingles hashed at a time.
STEP = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash over word shingles, repeats included: a bit is set if over half of the hashes set it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    whole, n = b" ".join(words), len(words) - width + 1
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        hashes = np.array([digest(whole[a:b], seed) for a, b in zip(starts[at:min(at + STEP, n)], ends[at + width - 1:])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42,
                      **further: str) -> DataFrame:
    """(doc_id, fp) and ``further`` columns: the fingerprint as a signed long; null and blank texts have zero."""
    rows = picked(docs, doc_id=doc_id, text=text, **further)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t, width, seed) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(marks), *[batch[n] for n in further]],
                                             names=["doc_id", "fp", *further])

    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *further)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *[f"{n} {kinds[n]}" for n in further]]))


def _forward(radius: int) -> list[int]:
    """Steps between the tiles to compare, each pair once, as differences of the tile number."""
    steps = itertools.product(range(-radius, radius + 1), repeat=4)
    near = [s for s in steps if sum(map(abs, s)) <= radius and s > (0, 0, 0, 0)]
    return [((a * 32 + b) * 32 + c) * 32 + d for a, b, c, d in near]


def _compare(batches, radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of the units in a sorted partition: rows of side 0 against each other and against side 1."""
    for _, rows in key_runs(batches, "unit"):
        prints, side = rows["fp"].to_numpy().view(np.uint64), rows["side"].to_numpy()
        home, guests = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(home) or len(home) + len(guests) < 2:
            continue
        links, step = Links(len(prints)), max(1, (1 << 20) // max(1, len(home)))
        for others in ([home, guests] if rows["own"][0].as_py() else [guests]):
            for at in range(0, len(others), step):
                block = others[at:at + step]
                a, b = np.nonzero(np.bitwise_count(prints[home][:, None] ^ prints[block][None, :]) <= radius)
                links.add(home[a], block[b])
        tied = np.flatnonzero(links.root != np.arange(len(prints)))
        if len(tied):
            node = rows["node"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[links.root[tied]])], names=["a", "b"])


def fingerprint_links(distinct: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect exactly the nodes whose fingerprints are connected by steps of ``radius`` bits or fewer.

    ``distinct`` has (node long, fp long), each fingerprint once.  The table of tile sizes has 17^4 rows at most."""
    spark = distinct.sparkSession
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)) for i in (3, 2, 1, 0)]
    number = ((quarter[0] * 32 + quarter[1]) * 32 + quarter[2]) * 32 + quarter[3]
    placed = distinct.select("node", "fp", number.cast("int").alias("tile"))
    tiles = stored(placed.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "tiles")
    # a row is at home in its own block and a guest in the blocks of the tiles ahead and of the later blocks of its tile
    spread = (placed.join(F.broadcast(tiles.withColumnRenamed("blocks", "own_blocks")), "tile")
              .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("own_blocks")).cast("int")))
    home = spread.select("node", "fp", F.col("tile").alias("at"), F.col("mine").alias("in_block"), F.lit(0).alias("side"))
    later = spread.where("mine > 0").select(
        "node", "fp", F.col("tile").alias("at"), F.explode(F.sequence(F.lit(0), F.col("mine") - 1)).alias("in_block"),
        F.lit(1).alias("side"))
    ahead = (spread.select("node", "fp", F.explode(F.transform(F.lit(_forward(radius)), lambda s: F.col("tile") + s)).alias("at"))
             .join(F.broadcast(tiles.withColumnRenamed("tile", "at")), "at")
             .select("node", "fp", "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("in_block"), F.lit(1).alias("side")))
    # guests of a block are divided too, so that no unit grows with the data
    guests = later.unionAll(ahead)
    shares = stored(guests.groupBy("at", "in_block").agg(F.ceil(F.count(F.lit(1)) / (16 * block)).cast("int").alias("shares")), "shares")
    homes = (home.join(shares, ["at", "in_block"], "left")
             .select("node", "fp", "at", "in_block", "side", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share")))
    guests = guests.join(shares, ["at", "in_block"]).select(
        "node", "fp", "at", "in_block", "side", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("shares")).cast("int").alias("share"))
    units = homes.unionAll(guests).select(
        "node", "fp", "side", (F.col("share") == 0).alias("own"),
        F.xxhash64("at", "in_block", "share").alias("unit"))
    return (units.repartition("unit").sortWithinPartitions("unit")
            .mapInArrow(lambda batches: _compare(batches, radius), "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3,
                    seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``.

    component_id is the smallest doc_id reachable over fingerprints that differ in at most ``radius`` bits.  Null, empty
    and blank texts have fingerprint zero and are linked like any other; equal texts and repeated rows share a component;
    rows with a null doc_id link others like any row and get their group's component, null if the group has no id at all; an
    empty table gives an empty one."""
    prints = stored(with_fingerprints(docs, doc_id, text, width, seed), "fingerprints")
    # nodes are the fingerprints themselves, so that rows without an id link groups too
    groups = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    joined = components(fingerprint_links(groups.select(F.col("fp").alias("node"), "fp"), radius))
    groups = groups.join(joined, groups["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = groups.join(least, "component").select("fp", "component_id")
    return prints.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row of ``docs`` of each group of linked fingerprints: the one with the smallest id, rows without an id last.

    A row is known by a hash of its id and text, so ids may be null or repeated; of rows that share the least id of their group
    one with the least hash stays, and exactly one of rows that repeat id and text."""
    mark = F.md5(F.concat(F.coalesce(F.concat(F.lit("i"), docs[doc_id].cast("long").cast("string")), F.lit("n")), F.lit(":"),
                          F.coalesce(docs[text].cast("string"), F.lit(""))))
    rows = docs.withColumn("_key", mark)
    prints = stored(with_fingerprints(rows, doc_id, text, width, key="_key"), "fingerprints")
    # nodes are the fingerprints themselves, so that rows without an id link groups too
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key"))
    groups = stored(prints.groupBy("fp").agg(first.alias("first")), "groups")
    joined = components(fingerprint_links(groups.select(F.col("fp").alias("node"), "fp"), radius))
    heads = (groups.join(joined, groups["fp"] == joined["node"], "left").groupBy(F.coalesce("component", "fp").alias("component"))
             .agg(F.min("first").alias("first")).select(F.col("first.key").alias("key")))
    repeated = prints.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = stored(heads.join(repeated, "key", "left").select(F.col("key").alias("_head"), F.col("n").isNotNull().alias("many")), "heads")
    once, many = [rows.join(heads.where(c).select("_head"), F.col("_key") == F.col("_head"), "left_semi") for c in ("not many", "many")]
    return once.unionAll(many.dropDuplicates(["_key"])).select(*docs.columns)
