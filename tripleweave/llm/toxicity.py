"""Toxicity: a sparse linear classifier whose score must not change when identity terms are swapped.

Features are the distinct words of a text and the character 4- and 5-grams of each, hashed.  The model is a logistic
regression fitted by FTRL-proximal steps (McMahan et al. 2013), whose L1 term leaves most weights at zero.  For each sentence
of a labelled text that names a group, the terms are swapped for others of the same kind, and the squared change of the score
is part of the loss (counterfactual logit pairing, Garg et al. 2019): a term that merely occurs more often in toxic texts
gets no weight of its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import picked

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")

#: Terms that may stand for each other: group names of one kind, number and language.  A parameter of :func:`fit`.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("black", "white", "asian", "african", "european", "hispanic", "latino", "indigenous", "arab"),
    ("immigrants", "refugees", "foreigners", "natives"), ("immigrant", "refugee", "foreigner", "native"),
    ("mexican", "chinese", "american", "german", "french", "spanish", "turkish", "polish", "russian", "indian"),
    ("disabled", "blind", "deaf", "autistic"), ("old", "young", "elderly"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("muslime", "christen", "juden", "atheisten"),
    ("schwarze", "weiße"), ("ausländer", "flüchtlinge", "einwanderer"), ("schwule", "lesben"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("musulmans", "chrétiens", "juifs", "athées"),
    ("noirs", "blancs", "arabes"), ("immigrés", "réfugiés", "étrangers"), ("gays", "lesbiennes"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("chicas", "chicos"), ("musulmanes", "cristianos", "judíos", "ateos"),
    ("negros", "blancos"), ("inmigrantes", "refugiados", "extranjeros"),
)


def features(word: str, size: int) -> list[int]:
    marked = f"^{word}$"
    grams = {marked[i:i + n] for n in (4, 5) for i in range(len(marked) - n + 1)}
    return [zlib.crc32(b"w" + word.encode()) % size, *(zlib.crc32(b"g" + g.encode()) % size for g in grams)]


def _counts(words, size: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.fromiter((f for w in words for f in features(w, size)), np.int64)
    found, n = np.unique(ids, return_counts=True)
    return found, n.astype(np.float64)


def _swaps(text: str, partners: Mapping[str, Sequence[str]], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each sentence with identity terms and each rank of partner: features of the sentence less those of the swapped one."""
    out = []
    for sentence in SENTENCE.findall(text):
        words = set(WORD.findall(sentence))
        named = words & partners.keys()
        if not named:
            continue
        for turn in range(max(len(partners[w]) for w in named)):
            swapped = {partners[w][turn % len(partners[w])] if w in named else w for w in words}
            ids, values = zip(_counts(words - swapped, size), _counts(swapped - words, size))
            every = np.concatenate(ids)
            found, at = np.unique(every, return_inverse=True)
            change = np.bincount(at, np.concatenate((values[0], -values[1])), len(found))
            if change.any():
                out.append((found[change != 0], change[change != 0]))
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, one per hashed feature
    bias: float

    def word_scores(self) -> "WordScores":
        return WordScores(self.weights)

    def score(self, text: str | None, scores: "WordScores | None" = None) -> float:
        scores = self.word_scores() if scores is None else scores
        # an exact order of summing: equal texts have equal scores whatever was seen before
        total = self.bias + sum(scores[w] for w in sorted(set(WORD.findall((text or "").lower())), key=str) if scores[w])
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


class WordScores(dict):
    """The weight of a word's features, kept for up to 150,000 words."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= 150_000:
            self.clear()
        self[word] = value = float(self.weights[features(word, len(self.weights))].sum(dtype=np.float64)) if len(word) <= 100 else float(
            self.weights[zlib.crc32(b"w" + word.encode()) % len(self.weights)])
        return value


def train(examples: Sequence[tuple[np.ndarray, np.ndarray, int, list]], size: int, prior: float, fairness: float, rounds: int = 10,
          alpha: float = 1.0, l1: float = 0.008, l2: float = 1.0) -> Model:
    """FTRL-proximal over (features, values, label, swaps); ``prior`` is the share of label 1 among all labelled rows.

    ``l1`` is given for each example."""
    l1 = max(0.5, l1 * len(examples))
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    share = np.mean([e[2] for e in examples])
    bias = np.log(share / (1 - share))

    def step(ids: np.ndarray, gradient: np.ndarray) -> None:
        square = gradient * gradient
        z[ids] += gradient - (np.sqrt(n[ids] + square) - np.sqrt(n[ids])) / alpha * w[ids]
        n[ids] += square
        at = z[ids]
        w[ids] = np.where(np.abs(at) <= l1, 0.0, -(at - np.sign(at) * l1) / ((1.0 + np.sqrt(n[ids])) / alpha + l2))

    for turn in range(rounds):
        for i in np.random.default_rng(turn).permutation(len(examples)):
            ids, values, label, swaps = examples[i]
            p = 1 / (1 + np.exp(-np.clip(bias + w[ids] @ values, -40, 40)))
            step(ids, (p - label) * values)
            if fairness:
                for changed, change in swaps:
                    gap = w[changed] @ change
                    if gap:
                        step(changed, 2 * fairness * gap * change)
    bias += np.log(prior / (1 - prior)) - np.log(share / (1 - share))  # the sample is balanced, the corpus is not
    return Model(w.astype(np.float32), float(bias))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text leaves remainder 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        sample: int = 4000, fairness: float = 1.0, size: int = 1 << 18, identity: Sequence[Sequence[str]] = IDENTITY_TERMS) -> Model:
    """Fit on labelled rows that are not held out, at most ``sample`` of each label, picked by a hash of the id.

    The sample's vectors (some 12 kB for a document here) are what the driver holds; all other counts cover every labelled row.

    Rows with a null id, text or label are left out; a doubly labelled document counts as toxic if any label says so.
    Without both labels the model is the smoothed share of label 1 alone."""
    known = (picked(labels, key=doc_id, label=label).where("key is not null and label is not null")
             .groupBy("key").agg((F.max("label") > 0).cast("int").alias("label")).where(~held_out("key")))
    rows = picked(docs, key=doc_id, text=text).where("key is not null and text is not null").join(known, "key")
    marked = rows.select("key", "label", F.xxhash64("key", F.lit(11)).alias("turn"))
    totals = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    ones, every = totals.get(1, 0), sum(totals.values())
    prior = (ones + 0.5) / (every + 1)
    if not ones or ones == every:
        return Model(np.zeros(size, np.float32), float(np.log(prior / (1 - prior))))
    chosen = None
    for value in (0, 1):
        part = marked.where(F.col("label") == value).orderBy("turn", "key").limit(sample).select("key", "label")
        chosen = part if chosen is None else chosen.unionAll(part)
    partners = {w: tuple(o for o in group if o != w) for group in identity for w in group}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value, mark in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), batch["label"].to_pylist()):
                lower = value.lower()
                ids, counts = _counts({w for w in WORD.findall(lower) if len(w) <= 100}, size)
                swaps = _swaps(lower, partners, size)
                parts = [(0, ids, counts), *((i + 1, a, b) for i, (a, b) in enumerate(swaps))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(parts), pa.int64()), pa.array([mark] * len(parts), pa.int32()),
                     pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.list_(pa.int32())),
                     pa.array([np.clip(p[2], -30000, 30000).astype(np.int16) for p in parts], pa.list_(pa.int16()))], names=["key", "label", "part", "ids", "n"])

    found = (docs.select(docs[doc_id].alias("key"), docs[text].alias("text")).join(chosen, "key")
             .select(F.col("key").cast("long").alias("key"), "text", "label")
             .mapInArrow(vectors, "key long, label int, part int, ids array<int>, n array<short>").toArrow())
    # views of the batches, nothing is copied; a row's swaps follow it
    rows: list[tuple[int, list]] = []
    for batch in found.to_batches():
        ids, counts = (batch[c].flatten().to_numpy() for c in ("ids", "n"))
        cuts = batch["ids"].offsets.to_numpy()
        cuts = cuts - cuts[0]
        for key, mark, part, a, b in zip(*(batch[c].to_pylist() for c in ("key", "label", "part")), cuts[:-1].tolist(), cuts[1:].tolist()):
            if part == 0:
                rows.append((key, [ids[a:b], counts[a:b], mark, []]))
            else:
                rows[-1][1][3].append((ids[a:b], counts[a:b]))
    rows.sort(key=lambda r: r[0])
    examples = [tuple(r) for _, r in rows]
    return train(examples, size, prior, fairness)


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row: a narrow pass over whole texts.

    Null and empty texts get the score of a text without words; null ids are passed on and never held out; repeated rows
    stay; an empty table gives an empty one."""
    rows = picked(docs, doc_id=doc_id, text=text).withColumn("held_out", held_out())
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of hashed features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        scores = own.word_scores()
        for batch in batches:
            found = np.array([own.score(t, scores) for t in batch["text"].to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(
        run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns and repeated rows stay.  A narrow pass."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        scores = own.word_scores()
        for batch in batches:
            yield batch.filter(pa.array([own.score(t, scores) < threshold for t in batch[text].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
