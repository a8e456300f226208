"""Quality rules by divergence: is a document's mix of characters and of common words that of its language?

Base rules count words, symbols, repeated lines and repeated phrases.  What passes them makes up the reference of its
language: a histogram of character classes and one of the ``common`` most frequent words, summed over all documents.  Each
document is then compared with the reference of its language by the Jensen-Shannon distance (base 2, 0 to 1).  A histogram of few
words strays by chance, so the limits have a guard by length: ``limit + guard / sqrt(words)``, and texts below
``least_words`` and languages whose reference has fewer than ``reference_words`` words are not compared at all.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, stored, text_column

# The contract's symbols, what is cut off both ends of a word, and Unicode's general categories by class.
SYMBOLS = "#*$%&|<>"
EDGES = ".,;:!?\"'()[]"
WHITE = " \t\n\r\x0b\x0c"
CLASSES = [("lower", ("Ll",)), ("upper", ("Lu", "Lt")), ("letter", ("Lm", "Lo", "Mn", "Mc", "Me")), ("number", ("Nd", "Nl", "No")),
           ("punctuation", ("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po")), ("symbol", ("Sm", "Sc", "Sk", "So")), ("white", ()), ("other", ())]
WHITE_CLASS, OTHER_CLASS = 6, 7
HELD = 256  # references a task holds at once: those of languages with 1/HELD of all words are sent to all tasks, others come with the rows
BINS = 1 << 19  # raw words whose bins a task remembers

REFERENCE = ["total", "words", "counts", "chars"]
BASE_DDL = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


@dataclass(frozen=True)
class Rules:
    """Limits of the method.  Every language with ``reference_words`` words has a reference, unless a caller asks by ``languages`` to
    leave out those with less than 1/``languages`` of all words."""

    least_words: int = 50
    common: int = 100
    languages: int = sys.maxsize
    reference_words: int = 2000
    word_limit: float = 0.28
    word_guard: float = 1.4
    char_limit: float = 0.16
    char_guard: float = 0.7


@cache
def class_table() -> np.ndarray:
    """Class number of every code point."""
    of = {c: i for i, (_, members) in enumerate(CLASSES) for c in members}
    table = np.fromiter((of.get(unicodedata.category(chr(i)), OTHER_CLASS) for i in range(0x110000)), np.uint8, 0x110000)
    table[[ord(c) for c in WHITE]] = WHITE_CLASS
    return table


def char_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(class_table()[points], minlength=len(CLASSES))


def repeated_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that the text holds twice or more."""
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(a) or len(a) < 4:
        return 0
    pairs = a[:-1] * len(ids) + a[1:]
    if len(ids) > 1 << 20:  # keep three numbers within 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(a), bool)
    for i in range(3):
        covered[i:len(a) - 2 + i] |= again
    return int(covered.sum())


def base_rules(text: str, least_words: int) -> tuple[list[bytes], np.ndarray, tuple]:
    """Words, character classes, and (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    raw = text.encode("utf-8", "surrogatepass")
    words, chars = raw.split(), char_counts(text)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    n = len(words)
    return words, chars, (n, int(chars.sum() - chars[WHITE_CLASS]), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
                          repeats, n < least_words or 100 * repeats > 50 * n)


def plain(word: bytes) -> bytes:
    """A word as it is counted: A-Z in lower case, without punctuation at its ends."""
    return word.lower().strip(EDGES.encode())


def language_counts(docs: DataFrame, rules: Rules) -> DataFrame:
    """``lang, word, n`` over all documents that pass the base rules; classes are words that start with a line feed.

    Counts are summed by batch, then by task, then by (language, word), so a frequent word or language costs a row a task."""
    least = rules.least_words

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str | None, Counter] = defaultdict(Counter)
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                words, chars, base = base_rules(text.as_py(), least)
                if not base[-1]:
                    seen[lang].update(words)
                    seen[lang].update({b"\n%d" % i: int(n) for i, n in enumerate(chars) if n})
            for lang, raw in seen.items():
                tidy: Counter = Counter()
                for word, n in raw.items():
                    tidy[word if word.startswith(b"\n") else plain(word)] += n
                del tidy[b""]
                yield pa.record_batch([pa.array([lang] * len(tidy), pa.string()), pa.array(tidy.keys(), pa.binary()),
                                       pa.array(tidy.values(), pa.int64())], ["lang", "word", "n"])

    rows = docs.select("lang", "text").mapInArrow(count, "lang string, word binary, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Reference:
    chars: np.ndarray
    words: dict[bytes, int]  # bin of each common word
    counts: np.ndarray       # of the common words, then of all others


def reference(total: int, words: list[bytes], counts: list[int], chars: list[dict]) -> Reference:
    classes = np.zeros(len(CLASSES))
    for r in chars:
        classes[int(bytes(r["word"])[1:])] = r["n"]
    return Reference(classes, {bytes(w): i for i, w in enumerate(words)}, np.array([*counts, total - sum(counts)], float))


def references(docs: DataFrame, rules: Rules) -> tuple[dict[str | None, Reference], DataFrame | None]:
    """The references of languages with at least 1/``HELD`` of all words, on the driver, and a table of all others, if there are any:
    ``lang, total, words, counts, chars``, a row a language with ``rules.common`` words at most.

    Words of equal frequency are taken in the order of their bytes."""
    counts = stored(language_counts(docs, rules), "word-counts")
    word = ~F.startswith("word", F.lit(b"\n"))
    totals = counts.where(word).groupBy("lang").agg(F.sum("n").alias("total"))
    every = totals.agg(F.sum("total")).first()[0] or 0
    totals = totals.where(F.col("total") >= max(rules.reference_words, -(-every // rules.languages)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    ranked = counts.where(word).withColumn("rank", rank).where(F.col("rank") <= rules.common)
    top = ranked.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    chars = counts.where(~word).groupBy("lang").agg(F.collect_list(F.struct("word", "n")).alias("chars"))
    for part in (top, chars):
        part = part.withColumnRenamed("lang", "_lang")
        totals = totals.join(part, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    known = stored(totals.select("lang", "total", F.col("top.word").alias("words"), F.col("top.n").alias("counts"), "chars"), "references")
    large = F.col("total") * HELD >= every
    held = {r["lang"]: reference(r["total"], r["words"], r["counts"], r["chars"]) for r in known.where(large).collect()}
    others = known.where(~large)
    return held, None if others.isEmpty() else others


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 1 if one is empty and the other not, 0 if both are."""
    if not p.any() or not q.any():
        return float(p.any() != q.any())
    p, q = p / p.sum(), q / q.sum()
    middle = (p + q) / 2

    def part(x: np.ndarray) -> float:
        some = x > 0
        return float((x[some] * np.log2(x[some] / middle[some])).sum())

    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def judge_documents(docs: DataFrame, rules: Rules = Rules(), id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance``.

    One row per input row, whatever its id; other columns are not read, so their names cannot clash.  A null text is an empty
    one (no words, so it fails); rows without a language are a language of their own.  The distances are null where nothing was
    compared: for texts that fail the base rules and for languages without a reference, whose ``kept`` is ``not base_failed``.
    Equal rows get equal results.  An empty table gives no rows."""
    rows = picked(docs, id=id, text=text, lang=lang)
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), text_column("text").alias("text"))
    held, others = references(rows, rules)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(held)
        bins: dict[str | None, dict[bytes, int]] = defaultdict(dict)  # raw word -> bin, forgotten when they have grown

        def compare(lang, words, chars, base):
            ref = known.get(lang)
            if base[-1] or ref is None:
                return not base[-1], None, None
            if sum(map(len, bins.values())) > BINS:
                bins.clear()
            size, of = len(ref.counts) + 1, bins[lang]
            for w in set(words):
                if w not in of:
                    tidy = plain(w)
                    of[w] = ref.words.get(tidy, size - 2) if tidy else size - 1
            hist = np.bincount([of[w] for w in words], minlength=size)[:-1]
            d_chars, d_words = distance(chars, ref.chars), distance(hist, ref.counts)
            guard = 1 / math.sqrt(base[0])
            far = d_chars > rules.char_limit + rules.char_guard * guard or d_words > rules.word_limit + rules.word_guard * guard
            return not far, d_chars, d_words

        for batch in batches:
            out = []
            brought = [batch[c] for c in REFERENCE] if "total" in batch.schema.names else []
            for i, (lang, value) in enumerate(zip(batch["lang"].to_pylist(), batch["text"])):
                words, chars, base = base_rules(value.as_py(), rules.least_words)
                if brought and not base[-1] and lang not in known and brought[0][i].is_valid:
                    if len(known) >= HELD:
                        known.clear()
                        bins.clear()
                    known[lang] = reference(*[c[i].as_py() for c in brought])
                out.append((*base, *compare(lang, words, chars, base)))
            columns = list(zip(*out)) or [()] * 9
            yield pa.record_batch([batch["id"], *[pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2)]],
                                  names)

    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
    judged = lambda rows: rows.mapInArrow(judge, BASE_DDL + ", kept boolean, char_distance double, word_distance double")
    if others is None:
        return judged(rows).withColumnRenamed("id", id)
    # rows of the other languages meet their reference by a join, but for texts that are too short for the least words
    at_hand = F.coalesce(F.col("lang").isin([x for x in held if x is not None]), F.lit(False)) | (F.lit(None in held) & F.col("lang").isNull())
    at_hand = at_hand | (F.length("text") < 2 * rules.least_words - 1)
    others = others.withColumnRenamed("lang", "_lang")
    met = rows.where(~at_hand).join(others, F.col("lang").eqNullSafe(F.col("_lang")), "left").select("id", "lang", "text", *REFERENCE)
    return judged(rows.where(at_hand)).unionAll(judged(met)).withColumnRenamed("id", id)
