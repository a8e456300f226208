"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents are counted into cells of (source, language, topic).  Only categories that the targets name are kept apart and all
others are one, so the number of cells is bounded by the parameters, whatever the corpus holds.  Raking multiplies the cells'
token weights by target over current share, one margin after the other, until nothing changes.  A document is then kept with
probability min(1, c * weight / tokens of its cell), with c such that the wanted part of all tokens is expected to stay.
Everything is DataFrame expressions; the cells alone sit in one partition.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, stored

OTHER = "other"
#: Ordered topics with the pattern that marks them; the first that matches holds.  A parameter.
TOPICS: tuple[tuple[str, str], ...] = (
    ("legal", "(Licensed under|is licensed under|Released under the|All rights reserved)"),
    ("contact", "[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]{2,}"),
    ("list", "([%#*$&]{3}|[0-9]{3}.[0-9]{3})"),
)
GENERAL = "general"
NAMES = ("source", "lang", "topic")


def topic_of(text: Column, targets: Mapping[str, float], topics: Sequence[tuple[str, str]] = TOPICS) -> Column:
    """The first topic whose pattern matches, by the name that the targets know it by.

    Names are settled while the plan is built: a test of the finished column would run all patterns a second time."""
    def known(name: str) -> Column:
        return F.lit(name if name in targets else OTHER)

    out = known(GENERAL)
    for name, pattern in reversed(topics):
        out = F.when(text.rlike(pattern), known(name)).otherwise(out)
    return out


def named(column: Column, targets: Mapping[str, float]) -> Column:
    """The category if the targets name it, else ``other``; null is ``other`` too."""
    return F.when(column.isin([k for k in targets if k != OTHER]), column).otherwise(F.lit(OTHER))


def _margin(cells: DataFrame, name: str, targets: Mapping[str, float], names: Sequence[str]) -> DataFrame:
    """Adds the wanted share of each row's category among the present ones.

    Without a target for ``other``, its wanted share is its natural one, and the named categories share the rest."""
    whole = Window.partitionBy(F.lit(0))
    share = F.lit(0.0)
    for key, value in targets.items():
        share = F.when(F.col(name) == key, F.lit(float(value))).otherwise(share)
    rest = F.lit(OTHER not in targets) & (F.col(name) == OTHER)
    # of each present category once
    first = F.row_number().over(Window.partitionBy(name).orderBy(*names)) == 1
    cells = cells.withColumn("share", share).withColumn("once", F.when(first, F.col("share"))).withColumns({
        "sum": F.sum("once").over(whole),
        "natural": F.sum(F.when(rest, F.col("tokens")).otherwise(F.lit(0))).over(whole) / F.sum("tokens").over(whole)})
    want = (F.when(rest, F.when(F.col("sum") > 0, F.col("natural")).otherwise(1.0))
            .when(F.col("sum") > 0, F.col("share") * (1.0 - F.col("natural")) / F.col("sum")).otherwise(0.0))
    return cells.withColumn(f"want_{name}", want).drop("share", "once", "sum", "natural")


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], tolerance: float = 1e-10, rounds: int = 20,
         at_most: int = 1000) -> DataFrame:
    """``cells`` (the target names, tokens) with ``weight``: shares of all tokens that fit the margins.

    Targets of categories without tokens are shared out among the present ones; categories without a target (all are one,
    ``other``) keep their natural share of the margin.  If all that is present has target 0, all weights are 0.  Each step is a window over the bounded
    table of cells; every ``rounds`` rounds it is stored and the largest change tested.  Margins that contradict each other are
    never all met: that is warned about, and the last margin holds."""
    cells = cells.where("tokens > 0").coalesce(1)
    for name, wanted in targets.items():
        cells = _margin(cells, name, wanted, list(targets))
    whole = Window.partitionBy(F.lit(0))
    cells = cells.withColumn("weight", F.col("tokens") / F.sum("tokens").over(whole))
    for _ in range(0, at_most, rounds):
        cells = cells.withColumn("before", F.col("weight"))
        for _ in range(rounds):
            for name in targets:
                now = F.sum("weight").over(Window.partitionBy(name))
                cells = cells.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"want_{name}") / now).otherwise(0.0))
        cells = stored(cells, "cells").coalesce(1)
        misses = [F.abs(F.sum("weight").over(Window.partitionBy(name)) - F.col(f"want_{name}")) for name in targets]
        change, miss = cells.select(F.abs(F.col("weight") - F.col("before")).alias("change"), F.greatest(F.lit(0.0), *misses).alias("miss")).agg(
            F.max("change"), F.max("miss")).first()
        if change is None or change <= tolerance:
            break
    if miss and miss > 1e-6:
        warnings.warn(f"no weights found that meet all margins; one share is off by {miss}")
    total = F.sum("weight").over(whole)
    return cells.select(*targets, "tokens", F.when(total > 0, F.col("weight") / total).otherwise(0.0).alias("weight"))


def calibrated(cells: DataFrame, names: Sequence[str], keep: float) -> DataFrame:
    """Adds ``probability`` by cell: min(1, c * ratio), ratio = weight * all tokens / tokens.

    With the cells by falling ratio, c is that of the shortest prefix of certain cells after which no ratio exceeds 1/c."""
    whole = Window.partitionBy(F.lit(0))
    ahead = whole.orderBy(F.desc("ratio"), *names).rowsBetween(Window.unboundedPreceding, -1)
    behind = whole.orderBy(F.desc("ratio"), *names).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cells = (cells.withColumn("all", F.sum("tokens").over(whole))
             .withColumn("ratio", F.col("weight") * F.col("all") / F.col("tokens"))
             .withColumn("sure", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)))
             .withColumn("rest", F.sum(F.col("tokens") * F.col("ratio")).over(behind))
             .withColumn("scale", F.when(F.col("rest") > 0, (F.col("all") * keep - F.col("sure")) / F.col("rest"))))
    scale = F.max(F.when(F.col("scale") * F.col("ratio") <= 1, F.col("scale"))).over(whole)
    return cells.withColumn("probability", F.when(F.col("ratio") <= 0, 0.0).otherwise(
        F.least(F.lit(1.0), F.coalesce(scale, F.lit(float("inf"))) * F.col("ratio"))))


def _marks(targets: Mapping[str, Mapping[str, float]], seed: int, topics: Sequence[tuple[str, str]], doc_id: Column, text: Column,
           source: Column, lang: Column) -> dict[str, Column]:
    """Categories, words and the fraction that decides, by row."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    turn = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.md5(text)), F.lit(f":{seed}"))), 1, 8), 16, 10)
    return {"source": named(source, targets["source"]), "lang": named(lang, targets["lang"]),
            "topic": topic_of(text, targets["topic"], topics),
            "n_tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), "turn": turn.cast("double") / 4294967296.0}


def _cells(marked: DataFrame, targets: Mapping[str, Mapping[str, float]], keep: float) -> DataFrame:
    """(source, lang, topic, ratio, probability): at most one row for each combination of named categories."""
    counted = stored(marked.groupBy(*NAMES).agg(F.sum("n_tokens").alias("tokens")), "counts")
    return calibrated(rake(counted, {n: targets[n] for n in NAMES}), NAMES, keep).select(*NAMES, "ratio", "probability")


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], keep: float = 0.8, seed: int = 17,
        topics: Sequence[tuple[str, str]] = TOPICS, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        lang: str = "lang") -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, selected) per row of ``docs``.

    ``targets`` maps source, lang and topic to shares by category; ``weight`` is the calibrated weight of one token (1 means
    its natural share).  A document is selected if a hash of its id (of its text for a null id) and the seed, as a fraction,
    is below its probability, so repeated rows share a fate.  Null sources and languages count as ``other``, which
    keeps its natural share if the targets do not name it, null texts as empty; a text without words has no weight, probability 1, and is selected.  An empty table gives an empty one."""
    rows = picked(docs, doc_id=doc_id, text=text, source=source, lang=lang)
    marks = _marks(targets, seed, topics, *[F.col(c) for c in ("doc_id", "text", "source", "lang")])
    marked = stored(rows.select("doc_id", *[v.alias(k) for k, v in marks.items()]), "marked")
    return marked.join(F.broadcast(_cells(marked, targets, keep)), list(NAMES), "left").select(
        "doc_id", *NAMES, "n_tokens", F.when(F.col("n_tokens") > 0, F.col("ratio")).otherwise(0.0).alias("weight"),
        F.when(F.col("n_tokens") > 0, F.col("probability")).otherwise(1.0).alias("probability"),
        F.when(F.col("n_tokens") > 0, F.col("turn") < F.col("probability")).otherwise(True).alias("selected"))


def keep_mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], keep: float = 0.8, seed: int = 17,
               doc_id: str = "doc_id", every_row: bool = False) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` selects, with all their columns; rows that repeat an id each have their own fate.

    Rows without an id are left out, or with ``every_row``, as in the pipeline, decided like all others."""
    docs = docs if every_row else docs.where(F.col(doc_id).isNotNull())
    marks = _marks(targets, seed, TOPICS, docs[doc_id], docs["text"], docs["source"], docs["lang"])
    marked = stored(docs.withColumn("_mix", F.struct(*[v.alias(k) for k, v in marks.items()])), "marked")
    chosen = _cells(marked.select("_mix.*"), targets, keep).select(F.struct(*NAMES).alias("_cell"), F.col("probability").alias("_chance"))
    cell = F.struct(*[F.col(f"_mix.{n}").alias(n) for n in NAMES])
    selected = (F.col("_mix.n_tokens") == 0) | (F.col("_mix.turn") < F.col("_chance"))
    return marked.join(F.broadcast(chosen), cell == F.col("_cell"), "left").where(selected).select(*docs.columns)
