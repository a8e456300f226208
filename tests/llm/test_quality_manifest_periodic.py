"""Quality rules, manifest and periodic runs against brute force, on small fixtures with nulls, ties, repeated rows and long texts."""

import collections
import dataclasses
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleweave.llm import manifest, periodic, quality
from tripleweave.llm.queries import periodic_digests, with_planted_periods

RANDOM = random.Random(11)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, pos long"
STOP = {"en": "the of and to a in is that it for was on".split(), "de": "der die und in den von zu das mit sich".split()}
WORD = r"[^\x20\x09-\x0D]+"


def frame(spark, rows):
    """Documents with two further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)


def prose(lang, n):
    made = lambda: "".join(RANDOM.choice(["er", "en", "st", "ing", "ch", "ti"]) for _ in range(RANDOM.randrange(1, 4)))
    return " ".join(RANDOM.choice(STOP[lang]) if RANDOM.random() < .4 else made() + RANDOM.choice(["", "", ",", "."]) for _ in range(n))


# --- quality rules -------------------------------------------------------------------------------------------------

def base_of(text):
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    grams = list(zip(words, words[1:], words[2:]))
    twice = collections.Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if twice[g] > 1 for d in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def tidy(text):
    return [w for w in (x.translate({c: c + 32 for c in range(65, 91)}).strip(quality.EDGES) for x in re.findall(WORD, text)) if w]


def classes(text):
    out = [0.0] * len(quality.CLASSES)
    for c in text:
        out[quality.class_table()[ord(c)]] += 1
    return out


def apart(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    half = lambda a: sum(x * math.log2(2 * x / (y + z)) for x, y, z in zip(a, p, q) if x)
    return math.sqrt(max(0, (half(p) + half(q)) / 2))


def judged(rows, rules):
    """The verdict of every row, language by language."""
    out, held = [], collections.defaultdict(list)
    for i, text, lang in rows:
        if not base_of(text or "")[-1]:
            held[lang].append(text)
    words = {lang: collections.Counter(w for t in texts for w in tidy(t)) for lang, texts in held.items()}
    every = sum(sum(c.values()) for c in words.values())
    for i, text, lang in rows:
        text = text or ""
        base = base_of(text)
        kept = not base[-1]
        total = sum(words.get(lang, {}).values())
        if kept and total >= rules.reference_words and total * rules.languages >= every:
            top = sorted(words[lang].items(), key=lambda x: (-x[1], x[0].encode()))[:rules.common]
            mine = collections.Counter(tidy(text))
            hist = [mine[w] for w, _ in top]
            of = [n for _, n in top]
            d_words = apart(hist + [sum(mine.values()) - sum(hist)], of + [total - sum(of)])
            d_chars = apart(classes(text), [sum(x) for x in zip(*map(classes, held[lang]))])
            kept = (d_words <= rules.word_limit + rules.word_guard / math.sqrt(base[0])
                    and d_chars <= rules.char_limit + rules.char_guard / math.sqrt(base[0]))
        out.append((i, *base, kept))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    rows = [(i, prose(lang, 60 + 37 * (i % 9)), lang) for i, lang in zip(range(80), itertools.cycle(["en", "en", "de"]))]
    shout = prose("en", 120).upper()
    marked = " ".join(w + "###" for w in prose("de", 200).split())
    listed = " | ".join(w for w in prose("en", 400).split() if w not in STOP["en"])
    line = prose("en", 12)
    rows += [(100, shout, "en"), (101, marked, "de"), (102, listed, "en"), (103, None, "en"), (104, "", "de"), (105, " \n\t ", "en"),
             (106, "\n".join([line] * 12), "en"), (107, prose("en", 20000), "en"), (108, prose("en", 90), None), (None, prose("de", 80), "de"),
             (None, prose("de", 80), "de"), (109, "a " * 70, "en"), (110, prose("de", 300), "en"), (111, "日本 é🎉 " * 20 + prose("en", 60), "en"),
             (112, prose("en", 60) + "  x y\u0085z", "xx"), (1, rows[1][1], "en"), (1, rows[1][1], "en")]
    return rows


@pytest.mark.parametrize("rules", [quality.Rules(), quality.Rules(common=8, reference_words=100, languages=4)])
def test_quality(spark, texts, rows, rules):
    docs = frame(spark, [(i, t, lang, "s", len(t or "")) for i, t, lang in texts])
    got = quality.judge_documents(docs, rules)
    assert rows(got.drop("char_distance", "word_distance")) == judged(texts, rules)
    if rules == quality.Rules():
        verdict = {r["doc_id"]: r["kept"] for r in got.collect()}
        assert not any(verdict[i] for i in (100, 101, 102, 103, 104, 105, 106, 109)) and verdict[107]
        assert all(verdict[i] for i, t, _ in texts[:80] if len(t.split()) > 200)
    assert quality.judge_documents(docs.where("false")).count() == 0


@pytest.mark.parametrize("held", [256, 3])
def test_quality_of_many_languages(spark, rows, monkeypatch, held):
    """Languages with less than 1/256 of all words had no reference, so their texts were judged by the base rules alone."""
    monkeypatch.setattr(quality, "HELD", held)
    monkeypatch.setattr(quality, "BINS", 500)
    names = [f"x{k:03d}" if k else None for k in range(290)]
    texts = [(i, prose(("en", "de")[i % 2], 60 + i % 30), names[i // 2]) for i in range(580)]
    texts += [(1000 + i, prose("en", 300), "main") for i in range(8)]
    texts += [(2000, prose("en", 150).upper(), "x007"), (2001, prose("en", 200).upper(), None), (2002, "a " * 70, "x008"), (2003, None, "x009"),
              (2004, "", "none"), (None, prose("de", 70), "x010"), (None, prose("de", 70), "x010"), (3, texts[3][1], names[1]), (2005, prose("de", 70), "few")]
    rules = quality.Rules(common=8, reference_words=100, word_guard=0.4, char_guard=0.4)
    got = quality.judge_documents(frame(spark, [(i, t, lang, "s", len(t or "")) for i, t, lang in texts]), rules)
    assert rows(got.drop("char_distance", "word_distance")) == judged(texts, dataclasses.replace(rules, languages=1 << 40))
    alone = {r["doc_id"] for r in got.where("char_distance IS NULL").collect()}
    assert alone == {2002, 2003, 2004, 2005}  # those that fail the base rules, and a language of less than 100 words
    assert {r["doc_id"] for r in got.where("NOT base_failed AND NOT kept").collect()} >= {2000, 2001}
    known, others = quality.references(frame(spark, [(i, t or "", lang, "s", 0) for i, t, lang in texts]), rules)
    brought = {r["lang"] for r in others.select("lang").collect()}
    assert "x289" in brought and (None in brought) == (held == 3) and len(known) <= held and len(known) + len(brought) == 291


def test_repeated_words_of_many():
    words = [b"%d" % (i % 1_100_000) for i in range(2_200_000)]
    assert quality.repeated_words(words) == len(words)
    assert quality.repeated_words(words[:1_100_005]) == 10


# --- manifest ------------------------------------------------------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    i, text, lang, source, n = row
    values = (i, source, lang, None if n is None else n + more, text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_of(hashes, fanout):
    """Root, and (left, right) digests of every leaf's levels."""
    steps, place = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for leaf, p in enumerate(place):
            run = hashes[p - p % fanout:p - p % fanout + fanout]
            steps[leaf].append(("".join(run[:p % fanout]), "".join(run[p % fanout + 1:])))
        hashes = [h(*hashes[i:i + fanout]) for i in range(0, len(hashes), fanout)]
        place = [p // fanout for p in place]
    return hashes[0], steps


def manifest_of(rows, fanout=2):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in order}
    root, above = tree_of([trees[g][0] for g in order], fanout)
    out = []
    for g, more in zip(order, above):
        for (_, _, leaf, row), steps in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            at = leaf_of(row, 1) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 else leaf
            for left, right in steps + more:
                at = h(left, at, right)
            out.append((row[0], leaf, trees[g][0], root, h(*[x for s in steps + more for x in s]), at, at == root))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leaves():
    rows = [(i * 3, f"text {i} é", lang, f"src{i % 4}", i) for i, lang in zip(range(137), itertools.cycle(["en", "en", "de", None, "z", "Z"]))]
    rows += [(5000, "x", "only", "s", 1), (None, None, None, None, None), (None, "t", "en", "s", 3), (6, "again", "en", "s", None), (14, "", "en", "", 0),
             (7, "same", "de", "s", 4), (7, "same", "de", "s", 4), (-5, "low", "de", "s", 2 ** 63 - 1), (11, "long " * 50000, "é", "s", -3),
             (5, "max", "en", "s", 2 ** 63 - 1), (15, "x", "", "s", 1)]
    return rows


@pytest.mark.parametrize("fanout, levels", [(2, 10), (2, 2), (3, 1), (2, 7)])
def test_manifest(spark, leaves, rows, fanout, levels):
    got = rows(manifest.verified_proofs(manifest.document_manifest(frame(spark, leaves), fanout, levels)))
    assert got == manifest_of(leaves, fanout)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_little(spark, leaves, rows):
    docs = frame(spark, leaves)
    assert manifest.verified_proofs(manifest.document_manifest(docs.where("false"))).count() == 0
    assert rows(manifest.verified_proofs(manifest.document_manifest(docs.where("doc_id = 5000")))) == manifest_of([r for r in leaves if r[0] == 5000])
    with pytest.raises(ValueError, match="pos"):
        manifest.manifest(docs.withColumn("leaf", F.lit("a")), "lang", ["doc_id"])


# --- periodic runs -------------------------------------------------------------------------------------------------

def runs_of(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        same = [a == b for a, b in zip(words, words[q:])]
        at = 0
        for value, part in itertools.groupby(same):
            n = len(list(part))
            if value and n + q >= max(least, 2 * q):
                found.setdefault((at, n + q), q)  # the smallest period comes first
            at += n
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(i, text):
    words = re.findall(WORD, text or "")
    if i is not None and words and zlib.crc32(str(i).encode()) % 10 == 0:
        n, g = len(words), zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
    return words


def digests_of(i, text):
    words = planted(i, text)
    runs = sorted(runs_of(words), key=lambda r: (r[0], r[2]))
    gone = {j for s, n, q in runs for j in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(w for j, w in enumerate(words) if j not in gone)))


def some_words():
    kind, few = RANDOM.randrange(6), RANDOM.choice([1, 2, 3, 5, 50])
    any_of = lambda n: [RANDOM.randrange(few) for _ in range(n)]
    if kind == 0:
        return any_of(RANDOM.randrange(300))
    if kind == 1:
        return any_of(20) + any_of(RANDOM.randrange(1, 90)) * RANDOM.randrange(1, 7) + any_of(20)
    if kind == 2:
        return ([0] * RANDOM.randrange(1, 100) + [1]) * RANDOM.randrange(1, 6) + [0] * RANDOM.randrange(1, 90)
    if kind == 3:
        return ([0, 1] * RANDOM.randrange(1, 60) + [0] * RANDOM.randrange(2)) * RANDOM.randrange(1, 5)
    a, b = [0], [0, 1]
    for _ in range(10):
        a, b = (b, b + a) if kind == 4 else (a + [1 - x for x in a], b)
    return (b if kind == 4 else a)[:300]


def test_periodic_digests(spark, rows):
    texts = [" ".join(f"w{x}" for x in some_words()) for _ in range(300)]
    texts += [None, "", " \n\t", "one", "a " * 5000, "a b\tc\nd " * 4, " ".join(f"w{RANDOM.randrange(30)}" for _ in range(2000)),
              "é 日本 x " * 9, ("x " * 40 + "y ") * 12]
    made = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "a b " * 9, "en", "s", 0), (3, "q " * 30, "en", "s", 0), (3, "q " * 30, "en", "s", 0)]
    docs = frame(spark, made)
    got = periodic_digests(with_planted_periods(docs))
    want = sorted((digests_of(r[0], r[1]) for r in made), key=repr)
    order = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert rows(got.select(*order)) == want
    assert sum(planted(r[0], r[1]) != re.findall(WORD, r[1] or "") for r in made) > 5
    assert periodic.periodic_runs(docs.where("false")).count() == 0


@pytest.mark.parametrize("batch", [1, 500, 10 ** 6])
def test_runs_of_batches(spark, batch):
    texts = [" ".join(map(str, some_words())) for _ in range(60)]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    for r in periodic.periodic_runs(docs, batch_words=batch).collect():
        words = texts[r["doc_id"]].split()
        assert sorted((x["start"], x["length"], x["period"]) for x in r["runs"]) == runs_of(words)
        assert r["n_words"] == len(words)


def test_runs_of_a_long_text():
    """A period of thousands of words, and a million words in which every k-mer of every scale recurs."""
    unit = [RANDOM.randrange(1000) for _ in range(30_000)]
    ids = np.array([-1 + 2000] + unit * 3 + unit[:77] + [3000])
    assert periodic.find_runs(ids, len(ids)).tolist() == [[1, 90_077, 30_000]]
    ids = np.r_[np.zeros(1_000_000, np.int64), 1]
    assert periodic.find_runs(ids, len(ids)).tolist() == [[0, 1_000_000, 1]]
