"""Order MinHash fingerprints (Marçais et al. 2019), as column expressions only.

The k-mers of a text are hashed and numbered by occurrence, and the number enters the hash.  The hash space is divided into
``slots`` equal ranges (one permutation in place of one per slot); in each, the ``width`` least occurrence-numbered k-mers are
selected, put back into text order and hashed as a tuple.  Two texts share a tuple if they share the least k-mers in the same
order, so the likeness falls with the edit distance and not only with the shared content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, text_column


def kmer_hashes(text: Column, k: int) -> Column:
    """Hash of each run of k words; of all words where there are fewer; none for blank texts."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    whole = F.transform(words, lambda w: F.xxhash64(w))

    def fold(hashes: Column) -> Column:
        run = F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
        return F.when(F.size(hashes) >= k, run).when(F.size(hashes) > 0, F.array(F.xxhash64(F.lit(k), hashes))).otherwise(
            F.array().cast("array<long>"))

    return _once(whole, fold)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a one-element array carries it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def signature(hashes: Column, slots: int = 32, width: int = 2) -> Column:
    """Array of one tuple hash per slot, null for slots without k-mers."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def numbered(s: Column) -> Column:
        # positions at which a k-mer equals the one before it in hash order: occurrence numbers above zero
        repeats = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda j: F.get(s, j)["h"] == F.get(s, j - 1)["h"])
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (F.get(s, j)["h"] != F.get(s, F.greatest(j - 1, F.lit(0)))["h"]))

        def rest(begin: Column) -> Column:
            spans = F.transform(begin, lambda j, r: F.struct(j.alias("from"), (F.coalesce(F.get(begin, r + 1), F.size(s)) - j).alias("n")))
            again = F.filter(spans, lambda x: x["n"] > 1)
            return F.flatten(F.transform(again, lambda x: F.transform(
                F.sequence(F.lit(1), x["n"] - 1),
                lambda o: F.struct(F.xxhash64(F.get(s, x["from"])["h"], o).alias("h"), F.get(s, x["from"] + o)["p"].alias("p")))))

        many = _once(starts, lambda begin: F.sort_array(F.concat(F.transform(begin, lambda j: F.get(s, j)), rest(begin))))
        return F.when(F.size(s) < 2, s).when(F.size(repeats) == 0, s).otherwise(many)

    slot_bits = (slots - 1).bit_length()

    def slot(x: Column) -> Column:
        return F.shiftrightunsigned(x["h"], 64 - slot_bits).cast("int")

    def least(s: Column) -> Column:
        kept = F.filter(s, lambda x, j: (j < width) | (slot(F.get(s, F.greatest(j - width, F.lit(0)))) != slot(x)))
        return _once(kept, lambda m: F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda q: _once(
            F.array_sort(F.transform(F.filter(m, lambda x: slot(x) == q), lambda x: F.struct(x["p"].alias("p"), x["h"].alias("h")))),
            lambda t: F.when(F.size(t) > 0, F.xxhash64(t["h"])))))

    return _once(_once(pairs, numbered), least)


def packed(tuples: Column) -> Column:
    """The signature as text: four hex digits a slot, dashes for a slot without k-mers."""
    return F.array_join(F.transform(tuples, lambda t: F.when(t.isNull(), "----").otherwise(
        F.lower(F.lpad(F.hex(t.bitwiseAND(0xFFFF)), 4, "0")))), "")


def likeness(a: Column, b: Column, slots: int = 32) -> Column:
    """Share of equal slots among those that either text fills; 1 for two texts without k-mers."""
    def both(i: int) -> tuple[Column, Column]:
        return F.substring(a, 4 * i + 1, 4), F.substring(b, 4 * i + 1, 4)

    same, filled = F.lit(0), F.lit(0)
    for i in range(slots):
        x, y = both(i)
        used = (x != "----") | (y != "----")
        filled = filled + used.cast("int")
        same = same + (used & (x == y)).cast("int")
    return F.when(filled == 0, 1.0).otherwise(same / filled)


def order_minhash(text: Column, k: int = 3, slots: int = 32, width: int = 2) -> Column:
    """The fingerprint of a text column; null counts as empty."""
    return packed(signature(kmer_hashes(F.coalesce(text, F.lit("")), k), slots, width))


def with_next(docs: DataFrame, order: str, columns: list[str], parts: int) -> DataFrame:
    """``docs`` with ``next_<column>`` of the row with the next larger ``order``; the last row is followed by the first.

    Rows are dealt out by ranges of the order whose bounds are values that occur; the first row of each range is copied to
    the range before it, so one shuffle is enough and no partition holds everything."""
    points = [i / parts for i in range(1, max(2, parts))]
    bounds = docs.agg(F.min(order), F.percentile_approx(order, points, 10000)).first()
    cuts = sorted({bounds[0], *(bounds[1] or [])} - {None})
    if not cuts:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    last = len(cuts) - 1
    cut = F.array(*[F.lit(int(c)).cast("long") for c in cuts])
    part = F.size(F.filter(cut, lambda c: c <= F.col(order))) - 1
    placed = docs.withColumn("_part", F.greatest(part, F.lit(0)))
    at_cut = F.array_contains(cut, F.col(order))
    before = F.when(F.col("_part") == 0, F.lit(last)).otherwise(F.col("_part") - 1)
    tie = F.xxhash64(*columns)
    ghosts = F.when(at_cut, F.array(F.struct(F.col("_part").alias("at"), F.lit(False).alias("ghost")), F.struct(before.alias("at"), F.lit(True).alias("ghost")))
                    ).otherwise(F.array(F.struct(F.col("_part").alias("at"), F.lit(False).alias("ghost"))))
    dealt = placed.withColumn("_put", F.explode(ghosts)).withColumn("_tie", tie)
    end = Window.partitionBy("_at").orderBy(F.col("_ghost"), F.col(order), "_tie")
    dealt = dealt.select(*docs.columns, "_tie", F.col("_put.at").alias("_at"), F.col("_put.ghost").alias("_ghost"))
    return (dealt.select("*", *[F.lead(c).over(end).alias(f"next_{c}") for c in columns]).where("not _ghost")
            .drop("_tie", "_at", "_ghost"))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, slots: int = 32,
                        width: int = 2) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next document by
    ascending doc_id; the last is followed by the first.  Null texts are empty.  Rows that repeat a doc_id follow each other
    by a hash of their text; rows with a null doc_id come first, in the same order, and are followed by the least id."""
    rows = picked(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), text_column("text").alias("text"))
    rows = rows.withColumn("fp", order_minhash(F.col("text"), k, slots, width))
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # null ids sort before all others
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = rows.withColumn("place", F.coalesce("doc_id", lowest))
    follows = with_next(rows, "place", ["text", "fp"], parts)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    follows = follows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    follows = follows.withColumn("edited_fp", order_minhash(F.col("edited"), k, slots, width))
    return follows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"),
        F.col("edited_fp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp"), slots).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp"), slots).alias("near_next"))
