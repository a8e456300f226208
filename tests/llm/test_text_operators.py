"""The text operators against brute force, round trips and planted cases, on small fixtures with nulls, ties and long texts."""

import base64
import collections
import hashlib
import html
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tripleweave.llm import bpe, embeddings, fingerprints, html_text, licenses, mixing, passages, simhash, suffix, toxicity
from tripleweave.llm.common import components
from tripleweave.llm.queries_sql import MIXING_SQL, TARGETS

RANDOM = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def words(n, vocabulary=VOCABULARY):
    return " ".join(RANDOM.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, a shared passage, self-repeats, short, empty, null and long texts."""
    shared, base = words(60), words(300)
    near = base.split()
    near[40] = "CHANGED"
    out = [words(120), base, base, " ".join(near), words(80) + " " + shared + " " + words(30), shared, words(10) + "\n" + shared,
           shared + "\t" + shared, "", None, "one", "  \n ", "a " * 500, "ab" * 900, words(20000), base + " " + words(50), "é日本🎉 " * 150, "x y z"]
    out += [words(40) + " " + shared + " " + words(40) for _ in range(12)]
    return list(enumerate(out, 10))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), i) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long").repartition(3)


@pytest.fixture
def empty(docs):
    return docs.where("false")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- substring deduplication ---------------------------------------------------------------------------------------

def first_windows(texts, length):
    seen, out = {}, {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for at in range(len(w) - length + 1):
            window = tuple(w[at:at + length])
            if window in seen:
                gone[at:at + length] = [True] * length
            seen.setdefault(window, (i, at))
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2048, 3])
def test_passages(docs, texts, empty, monkeypatch, hot):
    monkeypatch.setattr("tripleweave.llm.anchors.HOT_FORMS", hot)
    got = {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in by_id(passages.passage_digests(docs)).items()}
    assert got == first_windows(texts, 20)
    assert passages.passage_digests(empty).count() == 0


def test_passages_on_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in table.collect())
    got = {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in by_id(passages.passage_digests(table)).items()}
    assert got == first_windows(rows, 20)


def test_drop_passages(docs, texts):
    left = by_id(passages.drop_passages(docs))
    want = first_windows(texts, 20)
    for i, t in texts:
        n, removed, digest = want[i]
        if n and n == removed:
            assert i not in left
        elif not removed:
            assert left[i]["text"] == t
        else:
            assert hashlib.sha256(" ".join(left[i]["text"].split(" ")).encode()).hexdigest() == digest or len(left[i]["text"].split()) == n - removed
    assert set(left) == {i for i, _ in texts if not want[i][0] or want[i][0] != want[i][1]}


def repeated_bytes(texts, length):
    times = collections.Counter()
    data = {i: (t or "").encode() for i, t in texts}
    for d in data.values():
        times.update(d[a:a + length] for a in range(len(d) - length + 1))
    out = {}
    for i, d in data.items():
        gone = np.zeros(len(d) + 1, bool)
        for a in range(len(d) - length + 1):
            if times[d[a:a + length]] > 1:
                gone[a:a + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out[i] = (len(d), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot,length", [(2048, 400), (3, 100)])
def test_substrings(docs, texts, empty, monkeypatch, hot, length):
    monkeypatch.setattr("tripleweave.llm.anchors.HOT_FORMS", hot)
    some = [(i, t) for i, t in texts if not t or len(t) < 20000]
    got = by_id(suffix.repeat_digests(docs.where("text is null or length(text) < 20000"), length))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == repeated_bytes(some, length)
    assert suffix.repeat_digests(empty, length).count() == 0


def test_substrings_repeated_rows_and_null_ids(spark):
    rows = [(1, "a" * 10 + "xyz"), (1, "a" * 10 + "xyz"), (None, "q" * 30), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix.repeat_digests(df, 12).collect())
    assert got == [(0, 30, 30), (1, 13, 13), (1, 13, 13), (3, 0, 0)]


def test_suffix_array_and_prefixes():
    for _ in range(400):
        n, k = RANDOM.randint(1, 70), RANDOM.randint(1, 5)
        s = np.array([RANDOM.randint(1, k) for _ in range(n)] + [0], np.uint8)
        sa = suffix.suffix_array(s)
        assert sa.tolist() == sorted(range(n + 1), key=lambda i: s[i:].tobytes())
        _, common = suffix.permuted_prefixes(s, sa)
        for a, b in zip(sa[1:], sa[:-1]):
            length = next(i for i in range(n + 1) if s[a + i] != s[b + i])
            assert common[a] == length


# --- SimHash -------------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs, texts, empty):
    prints = {i: plain_fingerprint(t) for i, t in texts}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = least_reachable(prints, pairs)
    got = by_id(simhash.near_duplicates(docs))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    kept = by_id(simhash.drop_near_duplicates(docs))
    assert set(kept) == set(want.values()) and kept[10].asDict().keys() == set(docs.columns)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_through_rows_without_an_id(spark, monkeypatch):
    """Prints 7, 63 and 511 are three bits apart each; the middle row has no id.  A group without any id has no component."""
    prints = spark.createDataFrame([(5, 7), (None, 63), (9, 511), (None, 1 << 40), (4, 7)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "with_fingerprints", lambda *_, **__: prints)
    got = simhash.near_duplicates(prints).collect()
    assert sorted((r["fingerprint"][-3:], r["component_id"]) for r in got if r["fingerprint"][5] == "0") == [
        ("007", 4), ("007", 4), ("03f", 4), ("1ff", 4)]
    assert [r["component_id"] for r in got if r["fingerprint"][5] != "0"] == [None]


def test_simhash_keeps_one_row_of_each_group(spark):
    a, b, c = "alpha beta gamma delta", "one two three four five", "red green blue"
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (None, c, "x"), (None, c, "x"), (None, a, "x"), (7, "only here", "x"), (7, "only here", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted([(3, a), (5, b), (None, c), (7, "only here")], key=repr)


@pytest.mark.parametrize("block", [4, 1024])
def test_fingerprint_links(spark, block):
    near = [RANDOM.getrandbits(64) for _ in range(30)]
    prints = {p ^ sum(1 << RANDOM.randrange(64) for _ in range(RANDOM.randint(0, 4))) for p in near for _ in range(8)}
    prints = {i: p & (1 << 64) - 1 for i, p in enumerate(sorted(prints))}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    df = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in prints.items()], "node long, fp long")
    got = {r["node"]: r["component"] for r in components(simhash.fingerprint_links(df, 3, block)).collect()}
    want = least_reachable(prints, pairs)
    assert {i: got.get(i, i) for i in prints} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (400, 400), (None, 5)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


# --- embeddings ----------------------------------------------------------------------------------------------------

def test_embeddings(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(15):
            rows.append(((centre + rng.standard_normal(16) * 0.12 * (c % 3)).tolist(), c % 2))
    rows += [(rows[0][0], 0)] * 4 + [([0.0] * 16, 0), (None, 0), ([float("nan")] * 16, 1), ([None] + [1.0] * 15, 1), (rows[0][0], None), ([], 1)]
    rows = [(i, v, label) for i, (v, label) in enumerate(rows, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    fit = [(i, np.array(v), b) for i, v, b in rows if b is not None and v and None not in v and not np.isnan(v).any() and any(v)]
    pairs = [(i, j) for i, x, a in fit for j, y, b in fit if i < j and a == b and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93]
    found = {r["vec_id"]: r for r in embeddings.near_vectors(df, block=8).collect()}
    want, links = least_reachable([r[0] for r in rows], pairs), collections.Counter(i for p in pairs for i in p)
    assert sum(r["n_links"] for r in found.values()) >= 0.97 * sum(links.values())
    assert all(found[i]["n_links"] <= links[i] for i in found)
    assert {i: r["component_id"] for i, r in found.items()} == want
    assert {i for i, r in found.items() if r["kept"]} == set(want.values())
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_embeddings_of_any_magnitude(spark):
    rows = [(1, [1e-200, 0.0]), (2, [1.0, 1.0]), (3, [1e200, 1e200]), (4, [2e200, 2e200]), (5, [3e-310, 3e-310]), (6, [1e308, -1e308])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df, recall=0.9999).collect()}
    assert got == {1: (0, 1), 2: (3, 2), 3: (3, 2), 4: (3, 2), 5: (3, 2), 6: (0, 6)}


def test_embeddings_recall_of_planted_pairs(spark):
    """10,000 vectors of two labels with a partner at cosine 0.935 each: as many pairs are found as the index promises."""
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((2, 5000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    near = 0.935 * x + math.sqrt(1 - 0.935 ** 2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(2 * i + side, v.tolist(), i % 2) for i in range(5000) for side, v in ((0, x[i]), (1, near[i]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: r["component_id"] for r in embeddings.near_vectors(df).collect()}
    assert sum(found[2 * i] == found[2 * i + 1] for i in range(5000)) >= 0.96 * 5000


# --- byte-level BPE ------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def ranks(spark):
    return bpe.read_ranks(spark, tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe(docs, texts, empty, ranks, monkeypatch):
    plain = tiktoken.Encoding("plain", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.token_digests(docs, ranks, tokenizers.PATTERN))
    for i, t in texts:
        ids = plain.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.token_digests(empty, ranks, tokenizers.PATTERN).count() == 0
    back = by_id(bpe.decode_documents(bpe.encode_documents(docs, ranks, tokenizers.PATTERN), ranks))
    assert all(back[i]["decoded"] == (t or "") for i, t in texts)
    own = bpe.Codec(ranks, tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "SLICE", 40)
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "LOOKAHEAD", 300)
    tokens = list(ranks)
    for k in range(1500):
        t = ("".join(RANDOM.choice("aab then  \n\t'sé日🎉12==-.,") for _ in range(RANDOM.randint(0, 90))) if k % 2 else
             b"".join(RANDOM.choice(tokens) for _ in range(6)).decode("utf-8", "ignore"))
        assert own.encode(t) == plain.encode_ordinary(t)
    for t in ("a" * 3000, " " * 3000, "=" * 2000, "ab" * 2000, "\n" * 700 + "x", "é" * 900):
        assert own.encode(t) == plain.encode_ordinary(t)


def test_utf8_stream():
    data = "aé日🎉z".encode() * 3
    for size in range(1, 6):
        stream = bpe.Utf8Stream()
        assert "".join([*(stream.feed(data[i:i + size]) for i in range(0, len(data), size)), stream.end()]).encode() == data


# --- order MinHash -------------------------------------------------------------------------------------------------

def test_order_minhash(spark, docs, texts, empty):
    got = by_id(fingerprints.edited_fingerprints(docs))
    order = sorted(texts)
    for at, (i, t) in enumerate(order):
        t, after = t or "", order[(at + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[11]["fingerprint"] == got[12]["fingerprint"] and got[11]["near_next"] == 1.0
    assert 0.5 < got[12]["near_next"] < 1
    assert fingerprints.edited_fingerprints(empty).count() == 0
    pair = spark.createDataFrame([("a b c d e f g h i j k l m n o p q r s t " * 2,), ("k l m n o p q r s t a b c d e f g h i j " * 2,)], "t string")
    a, b = (r[0] for r in pair.select(fingerprints.order_minhash(F.col("t"))).collect())
    assert a != b  # the same k-mers in another order


def test_order_minhash_selection(spark):
    text = "a b a b a b c d a b a b"
    row = spark.createDataFrame([(text,)], "t string").select(
        fingerprints.kmer_hashes(F.col("t"), 2).alias("k"), fingerprints.signature(fingerprints.kmer_hashes(F.col("t"), 2), 4, 2).alias("s")).first()
    names = spark.range(1)
    seen, numbered = collections.Counter(), []
    for place, h in enumerate(row["k"]):
        o = seen[h]
        seen[h] += 1
        numbered.append((h if not o else names.select(F.xxhash64(F.lit(h).cast("long"), F.lit(o))).first()[0], place))
    for slot in range(4):
        chosen = sorted(x for x in numbered if (x[0] & (1 << 64) - 1) >> 62 == slot)[:2]
        inorder = [h for h, _ in sorted(chosen, key=lambda x: x[1])]
        want = names.select(F.xxhash64(F.array(*[F.lit(h).cast("long") for h in inorder]))).first()[0] if inorder else None
        assert row["s"][slot] == want


def test_null_ids_and_ties_of_next(spark):
    df = spark.createDataFrame([(None, "n o"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(df).count() == 4


# --- pages ---------------------------------------------------------------------------------------------------------

def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
      <header class="site-header">Site</header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div>
      <div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>First   <b>bold</b>
      text&nbsp;here, long enough to be content of the page.<div class="ad">Inner advert</div><p>Be.<p hidden>gone</p>
      <ul><li>one<li>two</ul><form>Search<input></form></article><aside>Side</aside>
      <section id="comments"><p>A reader comment that is rather long and would look like content otherwise.</p></section>
      <footer>&copy; foot</footer></body></html>"""
    plain = "<div><div class='menu'><a href=1>a</a><a href=2>b</a></div><div>" + "<p>A long paragraph of running text without any tags in it.</p>" * 5 + "</div></div>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<nav>only menu</nav>"), (5, "x", plain), (5, "x", plain), (6, "y", "<p>cut &am")]
    got = sorted((tuple(r) for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=repr)
    text = "Head & line\nFirst bold text here, long enough to be content of the page.\nBe.\none\ntwo"
    long = "\n".join(["A long paragraph of running text without any tags in it."] * 5)
    want = [(1, "u", text, len(text)), (2, None, "", 0), (3, "v", "", 0), (None, "w", "", 0), (5, "x", long, len(long)), (5, "x", long, len(long)),
            (6, "y", "cut &am", 7)]
    assert got == sorted(want, key=repr)


LONG = "Running text that goes on for quite a while without any tags in it. " * 5
LINKS = "<div><a href='1'>One link</a> <a href='2'>Another link</a></div>"


@pytest.mark.parametrize("page, want", [
    # without an article: headings, short ends, cells and short sections beside content stay, lists of links go
    (f"<body><h1>Head</h1><div><p>{LONG}</div><p>End.</p>{LINKS}</body>", ["Head", LONG.strip(), "End."]),
    (f"<div>{''.join(f'<section><h2>{h}</h2><p>{t}</p></section>' for h, t in (('A', LONG), ('B', 'Short.'), ('C', LONG)))}</div>",
     ["A", LONG.strip(), "B", "Short.", "C", LONG.strip()]),
    (f"<div><p>{LONG}</p><table><tr><td>x<td>1<tr><td>y<td>2</table></div>", [LONG.strip(), "x", "1", "y", "2"]),
    # inside an article the ratios judge its containers too
    (f"<article><h1>Head</h1><p>{LONG}</p>{LINKS}<div><p>Be.</p></div><div class='teaser'>More</div></article>", ["Head", LONG.strip(), "Be."]),
    # an article without content does not stand for the page, one that is a comment is none
    (f"<article>{'<i class=x></i>' * 9}{'<p></p>' * 9}</article><div><p>{LONG}</p></div>", [LONG.strip()]),
    (f"<article class='comment'><p>{LONG}</p></article><main><p>Body of the page.</p></main>", ["Body of the page."]),
    (f"<a name='top'><div><p>{LONG}</p><div>Short.</div></div>", [LONG.strip(), "Short."]),
])
def test_html_regions(page, want):
    assert html_text.main_text(page).split("\n") == want


def test_html_on_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r, (raw,) in zip(html_text.extract_main_text(pages).orderBy("page_id").collect(), pages.orderBy("page_id").select("html").collect()):
        inside = re.search(r"<article>(.*?)</article>", raw, re.S)[1].replace("<b>", "").replace("</b>", "").replace("<br>", " ")
        blocks = (" ".join(html.unescape(b).split()) for b in re.split(r"</?p>|</?h1>", inside))
        assert r["text"] == "\n".join(b for b in blocks if b)


# --- toxicity ------------------------------------------------------------------------------------------------------

def toxic_rows(n, group_bias):
    rows = []
    for i in range(n):
        toxic = int(RANDOM.random() < 0.3)
        text = words(25)
        if toxic:
            text += " you horrid " + RANDOM.choice(["fool", "creep"]) + "."
        if RANDOM.random() < (group_bias if toxic else 0.05):
            text += " Those muslims " + words(3) + "."
        rows.append((i, text, toxic))
    return rows


def test_toxicity_is_fair(spark):
    rows = toxic_rows(900, 0.8)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    fair, biased = (toxicity.fit(docs, labels, fairness=f) for f in (20.0, 0.0))
    scored = by_id(toxicity.score_documents(docs, fair))
    hidden = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {i for i, r in scored.items() if r["held_out"]} == hidden
    assert np.mean([scored[i]["predicted"] == t for i, _, t in rows if i in hidden]) > 0.97
    neutral = [words(25) + f" Those {g} " + words(3) + "." for g in ("muslims",) for _ in range(50)]
    assert sum(fair.score(t) >= 0.5 for t in neutral) <= 1
    gap = [abs(math.log(m.score(t) / (1 - m.score(t))) - math.log(m.score(t.replace("muslims", "jews")) / (1 - m.score(t.replace("muslims", "jews")))))
           for m in (fair, biased) for t in neutral[:1]]
    assert gap[0] < 0.5 * gap[1]


def test_toxicity_without_rows(spark, docs, empty):
    labels = spark.createDataFrame([(10, 1), (None, 0), (11, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = by_id(toxicity.score_documents(docs, model))
    assert len({r["score"] for r in got.values()}) == 1
    assert toxicity.fit(empty, labels.where("false")).bias == 0
    assert toxicity.score_documents(empty, model).count() == 0


# --- mixing and licenses -------------------------------------------------------------------------------------------

def test_mixing(spark, empty):
    rows = [(i, words(1 + i % 40), RANDOM.choice(["en", "de", None]), RANDOM.choice(["src0", "src0", "a", None])) for i in range(600)]
    rows += [(None, "x y z", "en", "a"), (7000, None, "en", "a"), (7001, "", "fr", "b"), (3, words(4), "de", "src0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"src0": 0.3, "other": 0.7}, "lang": {"en": 0.5, "de": 0.3, "other": 0.1, "it": 0.1}, "topic": {"general": 1.0}}
    got = mixing.mix(df, targets, keep=0.4).collect()
    assert len(got) == len(rows)
    tokens = sum(r["n_tokens"] for r in got)
    for name, want in (("source", {"src0": 0.3, "other": 0.7}), ("lang", {"en": 0.5 / 0.9, "de": 0.3 / 0.9, "other": 0.1 / 0.9})):
        for k, share in want.items():
            assert abs(sum(r["n_tokens"] * r["weight"] for r in got if r[name] == k) / tokens - share) < 1e-6
    assert abs(sum(r["n_tokens"] * r["probability"] for r in got) / tokens - 0.4) < 1e-6
    kept = mixing.keep_mixed(df, targets, 0.4).collect()  # shares are those of the rows with an id
    with_id = mixing.mix(df.where("doc_id is not null"), targets, keep=0.4).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in with_id if r["selected"])
    assert mixing.mix(empty, TARGETS).count() == 0


def test_mixing_of_languages_without_a_target(spark):
    rows = [(i, words(20), ("en", "de", "es", "fr", "it", None)[i % 6], f"src{i % 3}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {**TARGETS, "topic": {"general": 1.0}}
    got = mixing.mix(df, targets).collect()
    shares = {k: sum(r["n_tokens"] * r["weight"] for r in got if r["lang"] == k) / 12000 for k in ("en", "de", "other")}
    assert all(abs(shares[k] - v) < 1e-6 for k, v in (("en", 0.55 * 2 / 3), ("de", 0.15 * 2 / 3), ("other", 1 / 3)))
    assert abs(sum(r["probability"] for r in got) / 600 - 0.8) < 1e-6
    assert 0 < sum(r["selected"] for r in got if r["lang"] == "other")
    unnamed = df.where("lang is null or lang = 'it'")
    assert sum(r["selected"] for r in mixing.mix(unnamed, targets).collect()) > 100
    assert {r["probability"] for r in mixing.mix(unnamed, {**targets, "lang": {"en": 1.0, "other": 0.0}}).collect()} == {0.0}


def test_mixing_sql_of_languages_without_a_target(spark, tmp_path):
    rows = [(i, words(20 + i % 7), ("en", "de", "es", "fr", "it", None)[i % 6], f"src{i % 3}") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in mixing.mix(docs, TARGETS).collect()}
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = con.sql(MIXING_SQL)
        want = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert len(want) == len(got) == 300
    for r in want:
        mine = got[r["doc_id"]]
        assert all(mine[c] == r[c] for c in ("source", "lang", "topic", "n_tokens", "selected"))
        assert all(math.isclose(mine[c], r[c], rel_tol=1e-9) for c in ("weight", "probability"))


def test_margins_that_contradict_each_other(spark):
    cells = spark.createDataFrame([("a", "en", 50), ("b", "de", 50)], "source string, lang string, tokens long")
    with pytest.warns(UserWarning, match="meet all margins"):
        got = mixing.rake(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.9, "de": 0.1}}, rounds=2).collect()
    assert {r["lang"]: round(r["weight"], 9) for r in got} == {"en": 0.9, "de": 0.1}


def test_mixed_rows_without_an_id(spark):
    rows = [(None if i % 2 else 1, words(20), "en", "src0") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"src0": 1.0}, "lang": {"en": 1.0}, "topic": {"general": 1.0}}
    got = [r["doc_id"] for r in mixing.keep_mixed(df, targets, 0.5, every_row=True).collect()]
    want = [r["doc_id"] for r in mixing.mix(df, targets, 0.5).collect() if r["selected"]]
    assert 20 < got.count(None) < 80 and sorted(got, key=repr) == sorted(want, key=repr)


def test_licenses(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/x/1.txt", words(40)), (3, "a/x/y/2.txt", words(40) + "\nAll rights reserved."),
            (4, "b/1.txt", words(30)), (5, "a/x/COPYING.md", words(50) + "\nLicensed under the Apache License, Version 2.0.\n" + words(5)),
            (6, None, "Licensed under CC BY-NC 4.0."), (7, "a/x/z/3", None), (8, "c/4", "my license is none of these things at all"), (None, "a/5", "x")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["origin"], r["license_path"]) for r in licenses.scan_licenses(df).collect()}
    assert got == {1: ("MIT", "own", "a/LICENSE"), 2: ("Apache-2.0", "inherited", "a/x/COPYING.md"), 3: ("proprietary", "own", "a/x/y/2.txt"),
                   4: (None, "none", None), 5: ("Apache-2.0", "own", "a/x/COPYING.md"), 6: ("CC-BY-NC-4.0", "own", None),
                   7: ("Apache-2.0", "inherited", "a/x/COPYING.md"), 8: (None, "none", None), None: ("MIT", "inherited", "a/LICENSE")}
    assert licenses.scan_licenses(df.where("false")).count() == 0


def test_license_headers_and_notices_in_longer_lines(spark):
    found = {"Copyright (c) 2021 Jane Doe. All rights reserved.": "proprietary", "// SPDX-License-Identifier: MIT": "MIT",
             "/* SPDX-License-Identifier: BSD-2-Clause */": "BSD-2-Clause", "MIT License": "MIT", "# Licensed under the MIT License.": "MIT",
             "The MIT License (MIT)": "MIT", "# Licensed under the Apache\n# License, Version 2.0.\nx = 1": "Apache-2.0",
             words(30) + " Released under the MIT License. " + words(30): "MIT",
             "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + words(50): "GPL-3.0",
             "the license of my car and a public domain": None}
    texts = list(found) + [words(50) for _ in range(20)]
    df = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(df).collect()}
    assert [got[i] for i in range(len(found))] == list(found.values()) and not any(got[i] for i in range(len(found), len(texts)))


# --- pipeline ------------------------------------------------------------------------------------------------------

def test_pipeline(spark, ranks, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {i: t for i, t in before.items() if model.score(t) < 0.7}
    prints = {i: plain_fingerprint(t) for i, t in kept.items()}
    groups = least_reachable(kept, [(a, b) for a in kept for b in kept if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    kept = {i: kept[i] for i in set(groups.values())}
    want = first_windows(sorted(kept.items()), 20)
    stages = dict(corpus_pipeline.STAGES)
    out = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, folder)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(left) == {i for i, (n, gone, _) in want.items() if not n or n != gone}
    assert all(len(left[i].split()) == want[i][0] - want[i][1] for i in left)
    chosen = {r["doc_id"] for r in mixing.mix(out, TARGETS).where("selected").collect()}
    final = by_id(stages["bpe"](spark, stages["mixing"](spark, out, folder), folder))
    assert set(final) == chosen
    plain = tiktoken.Encoding("plain", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r["token_ids"] == plain.encode_ordinary(left[i]) and r["decoded_sha256"] == hashlib.sha256(left[i].encode()).hexdigest()
               for i, r in final.items())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == chosen


def test_ranks_match_the_library(ranks):
    lines = open(tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read().split()
    assert ranks == {base64.b64decode(a): int(b) for a, b in zip(lines[::2], lines[1::2])}
