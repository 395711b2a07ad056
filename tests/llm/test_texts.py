"""The operators that map over texts: coding, language, quality, toxicity, pages, decontamination."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from sparkloom.llm import blocks, bpe, decontaminate, html, langid, quality, toxicity

from .conftest import SCHEMA, WORDS, awkward, prose

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reference_coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_and_names():
    rows = ["ab  cd", None, "", " ab\n", "é z"]
    raw = [r.encode() if r else b"" for r in rows]
    (_, data, off), = blocks.texts(pa.array(rows))
    start, end, first = blocks.words(data, off)
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end)] == ["ab", "cd", "ab", "é", "z"]
    assert first.tolist() == [0, 2, 2, 2, 3, 5]
    names = blocks.word_names(data, start, end)
    assert names[0] == names[2] and len(set(names.tolist())) == 4
    assert off.tolist() == np.cumsum([0] + [len(x) for x in raw]).tolist()


def test_texts_of_slices_and_long_rows():
    rows = ["a" * (3 << 20), None, "b", "c" * (1 << 20), "d" * (1 << 20), ""]
    for column in (pa.array(rows), pa.array(["z", *rows]).slice(1)):
        got = []
        for _, raw, off in blocks.texts(column):
            got += [bytes(raw[a:b]).decode() for a, b in zip(off[:-1], off[1:])]
        assert got == [r or "" for r in rows]


# --- byte-level BPE


def test_bpe_is_tiktokens(spark, crowded):
    enc = reference_coder()
    got = bpe.encode_decode(crowded, RANKS, public_tokenizers.PATTERN).collect()
    want = sorted((t or "") for _, t, *_ in awkward())
    assert sorted(bytes(r["decoded"]).decode() for r in got) == want
    for r in got:
        text = bytes(r["decoded"]).decode()
        ids = enc.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_cuts_long_texts_only_where_it_is_safe():
    enc = reference_coder()
    r = random.Random(3)
    parts = ["word", " ", "  ", "\n", "'s", "don't", "123", "é", "日本", "\t", "!?", " ", " \n ", "x" * 50, " ", "\x1c", "\x85"]
    for seed in range(60):
        text = "".join(r.choice(parts) for _ in range(200))
        ids = [i for p in bpe.pieces(text, 16) for i in enc.encode_ordinary(p)]
        assert "".join(bpe.pieces(text, 16)) == text
        assert ids == enc.encode_ordinary(text), seed


def test_bpe_of_long_white_space():
    enc = reference_coder()
    for blank in (" " * 90_000, "\n" * 90_000, " \n\t\u3000" * 30_000, "\xa0" * 80_000):
        for text in (blank, "a" + blank, blank + "b", f"a b{blank}c d{blank}\n!", f"x{blank} \n", blank + "\n7", "é" + blank + "\x1f"):
            assert bpe.encode(enc, text) == enc.encode_ordinary(text)
    text = "a" + " " * 5_000_000 + "b" + "\n" * 2_000_000
    assert enc.decode_bytes(bpe.encode(enc, text)) == text.encode()


# --- language


def languages(n=60):
    rows = []
    for i in range(n):
        r = random.Random(i)
        lang = ("aa", "bb", "cc")[i % 3]
        letters = {"aa": "abcde", "bb": "fghij", "cc": "ébcfg"}[lang]
        rows.append((i, " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(60)), lang, "s", 1))
    return rows


def phrases(text: bytes, sample: bytes) -> int:
    """Greedy longest matches, by search."""
    at, n = 0, 1
    start = 0
    while at < len(text):
        if text[start : at + 1] in sample:
            at += 1
        elif at == start:  # a byte that the sample lacks
            at += 1
            start = at
            n += 1
        else:
            start = at
            n += 1
            if text[at : at + 1] not in sample:
                at += 1
                start = at
    return n


def test_automaton_parses_as_search_does():
    sample = {"x": [b"the cat sat on the mat"], "y": [b"der hund und der"]}
    m = langid.Model(sample)
    r = random.Random(4)
    long = [bytes(r.choice(b"thecatsonmhundr  ") for _ in range(n)) for n in (1023, 1024, 1025, 5000, 20_000)]
    for text in (b"the cat", b"the dog on the hat", b"und der cat qq", b"z", b"tttt", b"the cat sat on the mat" * 400, b"at" * 6000, b"t" * 9001, *long):
        raw = np.frombuffer(text, np.uint8)
        got = m.parse(raw, np.array([0, len(raw)]))[0] / np.array(m.weights)
        assert got.tolist() == [phrases(text, sample[k][0]) for k in ("x", "y")], text


def test_language_of_held_out_texts(spark):
    docs = spark.createDataFrame(languages(), SCHEMA)
    held = blocks.fold(F.col("doc_id"), 5) == 0
    model = langid.fit(docs, ~held)
    got = {r["doc_id"]: r for r in langid.predict(docs, model, keep=["lang"]).collect()}
    assert len(got) == 60 and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got.values())
    for i in range(60):
        assert docs.where(F.col("doc_id") == i).select(held).first()[0] == (zlib.crc32(str(i).encode()) % 5 == 0)
        break


def test_language_of_awkward_rows(spark, docs, crowded, empty, monkeypatch):
    model = langid.fit(docs, F.lit(True))
    rows = langid.predict(crowded, model, keep=["text"]).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert letters or r["score"] == 0
    monkeypatch.setattr(langid, "SLICE_LANGS", 1)  # a pass for each language
    sliced = langid.fit(docs, F.lit(True))
    assert len(sliced) > len(model) == 1
    key = lambda r: (str(r["text"]), r["lang_pred"], r["score"])
    assert sorted(map(key, langid.predict(crowded, sliced, keep=["text"]).collect())) == sorted(map(key, rows))
    none = langid.fit(empty, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0
    kept = langid.accepted(crowded, model)
    assert kept.columns == crowded.columns and all(any(c.isalpha() for c in r["text"]) for r in kept.collect())
    assert langid.accepted(docs, none).count() == 0


def test_filter_keeps_short_and_mixed_texts_and_drops_noise(spark):
    rows = languages()
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(docs, F.lit(True))
    short, mixed = rows[0][1][:12], rows[0][1] + " " + rows[1][1]
    more = spark.createDataFrame([(1, short, None, "s", 1), (2, mixed, None, "s", 1), (3, "xwqz vkpt zxqw " * 9, None, "s", 1), (4, "12 34", None, "s", 1), (5, None, None, "s", 1)], SCHEMA)
    assert {r["doc_id"] for r in langid.accepted(more, model).collect()} == {1, 2}
    assert langid.accepted(docs, model).count() == 60


# --- quality and toxicity


def labelled(n=240):
    docs, labels = [], []
    for i in range(n):
        r = random.Random(i)
        words = [r.choice(WORDS) for _ in range(60)]
        good, toxic = i % 4 != 0, i % 5 == 0
        if not good:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for k in r.sample(range(60), 3):
                words[k] = r.choice(["gruk", "blarp"])
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def marked(spark):
    docs, labels = labelled()
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def test_quality_of_held_out_texts(marked):
    docs, labels, truth = marked
    held = blocks.fold(F.col("doc_id"), 5) == 0
    got = quality.predict(docs, quality.fit(docs, labels, "quality", ~held)).collect()
    assert len(got) == 240 and all((r["score"] >= quality.THRESHOLD) == bool(truth[r["doc_id"]][0]) for r in got)


def test_quality_learns_from_all_labelled_rows(spark, monkeypatch):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(1, 12))).upper()[: r.randint(1, 60)] if i % 3 else f"{r.choice(WORDS)} {i}", "en", "s", 1) for i in range(13_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0 or i % 7 == 0)) for i in range(13_000)], "doc_id long, quality int")
    model = quality.fit(docs, labels, "quality", F.lit(True))
    raw = [t.encode() for _, t, *_ in rows]
    x = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    y = np.array([int(i % 3 == 0 or i % 7 == 0) for i in range(13_000)])
    for c, found in zip(x.T, model.cuts):
        assert np.allclose(np.unique(np.quantile(c, np.linspace(0, 1, quality.BINS + 1)[1:-1])), found, rtol=1e-12)
    s = model.raw(model.pattern(x))
    assert np.isclose(model.cut, np.quantile(s, (y == 0).mean())) and np.isclose(4 / model.scale, np.median(s[y == 1]) - np.median(s[y == 0]))
    assert np.allclose(model.bins(model.pattern(x)) @ np.concatenate([np.diff(v) for v in model.values]), s)
    # every row has an opponent, also where a bucket has one label only
    monkeypatch.setattr(quality, "BUCKET_ROWS", 3)
    binned = spark.createDataFrame([(i, int(i > 19), 100 + i) for i in range(30)], "h long, y int, z long")
    pairs = quality._paired(binned, 30, (120, 100)).collect()
    assert {p["good"] for p in pairs} == set(range(120, 130)) and {p["bad"] for p in pairs} == set(range(100, 120))
    both = quality.fit_predict(docs.limit(300), labels, "quality", F.col("doc_id") % 2 == 0).collect()
    apart = quality.predict(docs.limit(300), quality.fit(docs.limit(300), labels, "quality", F.col("doc_id") % 2 == 0)).collect()
    assert sorted(both) == sorted(apart)


def test_toxicity_of_held_out_texts(marked):
    docs, labels, truth = marked
    held = blocks.fold(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, labels, "toxic", ~held)
    got = toxicity.predict(docs, model).collect()
    right = sum((r["score"] >= toxicity.THRESHOLD) == bool(truth[r["doc_id"]][1]) for r in got)
    assert right >= 230 and 0 < len(model.at) < 1 << toxicity.BITS


def test_toxicity_learns_all_features_of_long_texts(spark):
    def hashed(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return int(toxicity.grams(raw, np.array([0, len(raw)]))[1][0])

    marker = max((f"gruk{i}" for i in range(500)), key=hashed)  # behind nearly all others
    r = random.Random(9)
    rows = [(i, " ".join([f"w{r.randrange(5000)}" for _ in range(2500)] + [marker] * (i % 2)), "en", "s", 1) for i in range(80)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, SCHEMA), labels, "toxic", F.lit(True))
    at = np.flatnonzero(model.at == hashed(marker))
    assert len(at) == 1 and model.weight[at[0]] > 0


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_of_awkward_rows(spark, docs, crowded, empty, marked, module, label):
    _, labels, _ = marked
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 0), (1, None, None), (1, 1, 1), (1, 0, 1), (3, 0, 1), (7, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    for table in (labels, none, odd):
        model = module.fit(docs, table, label, F.lit(True))
        rows = module.predict(crowded, model).collect()
        assert len(rows) == len(awkward()) and all(0 <= r["score"] <= 1 for r in rows)
        assert module.predict(empty, model).count() == 0
        assert len({r["score"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert module.fit(empty, labels, label, F.lit(True)) is not None


# --- pages

PAGE = """<!DOCTYPE html><html><head><title>Title</title><script>var t="</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About this</a></li></ul></nav><!-- ad --><div class="ad">Buy a lot of these things now and save very much money today</div>
<div class="cookie-notice"><p>We use cookies and you must agree to all of them before you read on here.</p></div>
<article><h1>A &amp; B</h1><p>First  paragraph
of <b>bold</b>ness &lt;tag&gt; &#233; &eacute;.</p><p>Short.</p><form><p>Your e-mail address please</p></form><p>Second paragraph, which is long enough to be text.<br>After a break.</p></article>
<aside><p>Related things that are not part of the article at all, however long they may be.</p></aside>
<div id="comments"><p>I am a reader and this is my comment, which is rather long for a comment.</p></div>
<footer>&copy; Someone</footer></body></html>"""


def test_page():
    assert html.main_text(PAGE) == "A & B First paragraph of boldness <tag> é é. Short. Second paragraph, which is long enough to be text. After a break."


def test_page_without_an_article_tag():
    text = "A long enough paragraph of text that surely belongs to the article on this page."
    page = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><div><h1>Head</h1><p>{text}</p><p>{text}</p></div><div class='footer'>All rights</div></body>"
    assert html.main_text(page) == f"Head {text} {text}"


STORY = "<h1>Head</h1><p>A long enough paragraph of text that surely belongs to the article.</p><p>And one more of them, for good measure.</p>"


@pytest.mark.parametrize("page", [f'<body><div class="share-price-story">{STORY}</div></body>', f'<body><div class="nav">Home</div><div class="content has-sidebar">{STORY}</div></body>', f'<body><main><div class="comments-free">{STORY}</div></main></body>'])
def test_names_do_not_empty_a_page(page):
    assert html.main_text(page) == "Head A long enough paragraph of text that surely belongs to the article. And one more of them, for good measure."


def test_comments_vanish_and_lists_of_links_in_main_too():
    assert html.main_text("<p>a<!-- x -->b and <b>c</b>d</p>") == "ab and cd"
    links = "<ul>" + "<li><a href=x>Another story</a></li>" * 5 + "</ul>"
    assert html.main_text(f"<main>{links}{STORY}{links}</main>").startswith("Head A long") and "Another" not in html.main_text(f"<main>{links}{STORY}{links}</main>")


def test_runs_of_the_distribution():
    r = random.Random(2)
    for _ in range(300):
        n = [r.choice([0, 0, 0, 5, 30, 200]) for _ in range(r.randint(0, 25))]
        sums = [sum(n[i : i + html.WINDOW]) for i in range(len(n))]
        want = []
        for i, x in enumerate(n):  # the run around a line, by walking both ways
            a = b = i
            while a > 0 and sums[a - 1]:
                a -= 1
            while b < len(n) and sums[b]:
                b += 1
            want.append(x > 0 and max(sums[a:b]) >= min(html.SURGE_CHARS, max(sums)))
        assert html.kept(n) == want


def test_a_long_page():
    page = "<body><div>" + "<p>Some words that make a paragraph of text &amp; more.</p>" * 100_000 + "</div></body>"
    assert html.main_text(page) == " ".join(["Some words that make a paragraph of text & more."] * 100_000)


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<script>never closed", "<!-- never closed", "<<<>>>", "&#xZZ; &bogus; &#1114112;", "plain text only", "<p>" * 3000])
def test_odd_pages(page):
    assert isinstance(html.main_text(page), str)


def test_pages_table(spark):
    t = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "y"), (1, "u", "", "z")], "page_id long, url string, html string, text string")
    rows = html.extract(t).collect()
    assert len(rows) == 3 and sorted(r["n_chars"] for r in rows)[:2] == [0, 0]
    assert html.extract(t.limit(0)).count() == 0


# --- decontamination


def bm25(items: list[str], passage: list[str]) -> list[float]:
    """Scores of all items for a passage's words, divided by each item's for itself, by the definition of BM25."""
    words = [t.lower().split() for t in items]
    n, mean = len(words), sum(map(len, words)) / len(words)
    df = {}
    for w in words:
        for x in set(w):
            df[x] = df.get(x, 0) + 1

    def score(w: list[str], query: set[str]) -> float:
        k = decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(w) / mean)
        return sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * (decontaminate.K1 + 1) / (w.count(x) + k) for x in query & set(w))

    return [score(w, set(passage)) / score(w, set(w)) for w in words]


@pytest.mark.parametrize("slices", [1, 3])
def test_retrieval_is_bm25(slices):
    items = [prose(i, 10 + i % 25) for i in range(70)]
    units = [u for i, t in enumerate(items) for u in decontaminate.units(i, t)]
    stats = decontaminate.Stats.of(units)
    indexes = [decontaminate.Index(units[k::slices], stats) for k in range(slices)]
    found = 0
    for seed in range(40):
        r = random.Random(seed)
        words = prose(1000 + seed, 90).split()
        part = items[seed].split()[: r.randint(5, 30)]
        text = " ".join(words[:40] + part + words[40:])
        raw = blocks.lower(np.frombuffer(text.encode(), np.uint8))
        off = np.array([0, len(raw)])
        start, end, first = blocks.words(raw, off, decontaminate._GAP)
        name = blocks.word_names(raw, start, end)
        got = {(at, index.units[i].item): s for index in indexes for _, at, i, s in index.retrieve(name, np.zeros(len(name), int), first)}
        want = {}
        for c in range(-(-len(name) // stats.stride) + 1):
            at = max(0, (c - 1) * stats.stride)
            scores = bm25(items, text.split()[at : (c + 1) * stats.stride])
            want |= {(at, i): s for i, s in enumerate(scores) if s >= decontaminate.RETRIEVE}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
        found += len(got)
    assert found


def test_slices_of_items_and_long_items(spark, monkeypatch):
    items = [(i, f"Question {prose(i, 20)}\n{prose(500 + i, 4)}") for i in range(30)] + [(99, prose(700, 3000) + "\n" + prose(701, 6))]
    docs = spark.createDataFrame([(i, prose(2000 + i, 60) + " " + t + " " + prose(3000 + i, 60)) for i, t in items] + [(500, prose(9, 4000))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    assert {(a, b) for a, b, *_ in one} == {(i, i) for i, _ in items}
    monkeypatch.setattr(decontaminate, "SLICE_ITEMS", 16)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == one
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [500]


def test_planted_items_are_found_and_clean_texts_are_not(spark):
    items = [(i, f"Question {prose(i, 20)}\n{prose(500 + i, 4)}") for i in range(30)]
    rows = []
    for i in range(30):
        rows.append((i, prose(2000 + i, 100) + "\n" + items[i][1] + "\n" + prose(3000 + i, 100)))
        rows.append((100 + i, prose(4000 + i, 220)))
        rows.append((200 + i, prose(5000 + i, 50) + " " + items[i][1].split("\n")[0]))  # no answer
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert {(i, i) for i in range(30)} <= got and all(a < 100 or 200 <= a for a, _ in got)
    assert len([a for a, _ in got if a >= 200]) <= 2
    clean = decontaminate.clean(docs, bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {a for a, _ in got}


def test_decontamination_of_awkward_rows(spark, docs, crowded, empty):
    bench = spark.createDataFrame([(1, None), (None, ""), (2, "!!!"), (3, prose(2, 60)), (3, prose(2, 60)), (4, "one two")], "item_id long, text string")
    found = decontaminate.contaminated(crowded, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} >= {(7, 3), (8, 3)}
    assert decontaminate.clean(crowded, bench).columns == crowded.columns
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.clean(empty, bench).count() == 0
    nothing = bench.limit(0)
    assert decontaminate.contaminated(docs, nothing).count() == 0 and decontaminate.clean(docs, nothing).count() == len(awkward())
