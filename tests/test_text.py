import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom import text as T
from sparkloom.config import QueryRequest
from sparkloom.functions import columns as X
from sparkloom.operators import chunk, embed, fusion, knowledge
from sparkloom.plans import planner


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_tokenize():
    assert T.tokenize("Émile's R2-D2, über 3.5M!") == ["émile", "s", "r2", "d2", "über", "3", "5m"]


@pytest.mark.parametrize("surface,key", [("Acme Corp", "acme"), ("ACME, Inc.", "acme"), ("Group Nine Holdings", "group nine"), ("Inc", "inc"), ("O'Neil & Co", "o neil"), ("--", "")])
def test_canonical_key(spark, surface, key):
    assert T.canonical_key(surface) == key
    assert column(spark, [surface], X.canonical_key) == [key]


def test_jaro_winkler():
    assert T.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert T.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert T.jaro_winkler("", "") == 1 and T.jaro_winkler("a", "") == 0


NUMBERS = [("$10 million", 1e7), ("10,000", 10.0), ("3.5B", 3.5e9), ("15%", 15.0), ("about 12k users", 12e3), ("no number", None), ("$1.2M.", 1.2e6), ("(7)", 7.0), ("10 2024", 10.0), ("5 mln", 5e6), ("", None), ("1e3", 1e3), ("m5", None)]


def test_first_number(spark):
    assert [T.first_number(s) for s, _ in NUMBERS] == [v for _, v in NUMBERS]
    assert column(spark, [s for s, _ in NUMBERS], X.first_number) == [v for _, v in NUMBERS]


TEXTS = ["a\r\nb\rc", "a  \n\n\n\n\nb\t \n", "\n\n\n\nx", "", "tab\tkept\x07gone\x7f", "no end"]


def test_normalize(spark):
    want = ["a\nb\nc\n", "a\n\n\nb\n\n", "\n\nx\n", "\n", "tab\tkeptgone\n", "no end\n"]
    assert [T.normalize(t) for t in TEXTS] == want
    assert column(spark, TEXTS, X.normalize) == want


def test_sentences():
    assert [s for _, s in T.sentences("One. Two! three? Four")] == ["One.", "Two! three?", "Four"]
    assert [s for _, s in T.sentences("It was $3.5M. Done.")] == ["It was $3.", "5M.", "Done."]
    assert T.sentences("Ä. B")[1][0] == 3


def test_negative(spark):
    values = ["It is not so", "He isn't", "another one", "plain", "never say it", "it never ends"]
    assert [T.negative(v) for v in values] == column(spark, values, X.negative) == [True, True, True, False, False, True]


def test_dates():
    assert T.dates("On 2024-03-05, in March 2021 and Q3 2020, 1999 or 2024-13; 1850") == [(2024, 3, 5, True), (2021, 3, 1, False), (2020, 7, 1, False), (1999, 1, 1, False), (2024, 1, 1, False)]


def test_stems():
    words = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat rational:ration digitizer:digit operator:oper hopefulness:hope triplicate:triplic formalize:formal electrical:electr revival:reviv adoption:adopt irritant:irrit probate:probat rate:rate controll:control roll:roll"
    for pair in words.split():
        word, stem = pair.split(":")
        assert T.stem(word) == stem, word
    assert T.index_term("résumés") == T.stem("resumes")


INTENTS = [("Summarize this", "summary"), ("compare a and b", "comparative"), ("what happened in 2021?", "temporal"), ('find "this phrase"', "exact"), ("error in parse_config", "exact"), ("NASA budget", "exact"), ("Who is it", "entity"), ("What is the Moon", "entity"), ("how do birds fly", "semantic"), ("", "semantic"), ("the file a.txt", "exact"), ("Documentation of things", "exact"), ("whenever it rains", "temporal")]


def test_intents(spark):
    assert [planner.classify_intent(q) for q, _ in INTENTS] == [k for _, k in INTENTS]
    assert column(spark, [q for q, _ in INTENTS], X.intent) == [k for _, k in INTENTS]


def test_plan():
    p = planner.plan(QueryRequest("what changed between 2019 and 2021"))
    assert (p.intent, p.mode, p.w_vector, p.w_fts) == ("temporal", "hybrid", 0.35, 0.65)
    assert (p.temporal.low, p.temporal.high) == (2019, 2021)
    assert planner.plan(QueryRequest("anything in 2019", mode="dense")).intent == "semantic"
    assert planner.plan(QueryRequest('"exactly"')).mode == "lexical"
    latest = planner.detect_temporal("the most recent figures")
    assert [latest.score(t, 2026) for t in ("in 2025", "in 2021", "in 2000", "none")] == [1.0, 0.6, 0.3, 0.0]


def test_context():
    hits = [{"document_id": i % 2, "document": f"d{i % 2}", "section": None if i else "S", "text": "x" * 900} for i in range(6)]
    out = planner.assemble_context(hits, 3000, 1)
    assert out.startswith("[1] d0 :: S\n" + "x" * 700 + "\n\n[2] d1 :: -\n") and out.endswith("CITATIONS: [1] d0 :: S | [2] d1 :: -\n")
    assert planner.assemble_context(hits, 100) == ""


def test_headings_and_chunks():
    assert chunk.heading_like("REVENUE AND GROWTH") and chunk.heading_like("Main results:") and not chunk.heading_like("A sentence. Then") and not chunk.heading_like("lower case line")
    text = "# One\n\nFirst paragraph.\n\n## Two\n\nSecond paragraph\nof two lines.\n"
    got = chunk.chunk_document(text, "markdown")
    assert [(c.section, c.text) for c in got] == [("Two", "## One\n\nFirst paragraph.\n\n## Two\n\nSecond paragraph\nof two lines.")]
    long = " ".join(f"Sentence number {i} is here." for i in range(300))
    parts = chunk.chunk_document(long, "text")
    assert len(parts) > 3 and all(200 <= len(c.text) <= 2300 for c in parts[:-1]) and [c.authority for c in parts[:4]] == [1.2, 1.2, 1.2, 1.0]
    assert " ".join(c.text for c in parts).split() == long.split()


def test_code_chunks():
    code = "# lost\nimport os\n\ndef one():\n    return 1\n\nclass Two:\n    pass\n"
    got = chunk.chunk_document(code, "code")
    assert "lost" not in "".join(c.text for c in got) and {c.kind for c in got} == {"code", "code_unit"} or {c.kind for c in got} == {"code_unit"}
    assert chunk.chunk_document("x = 1\n", "code")[0].text == "x = 1"


def test_entities():
    text = "Write to a.b@c.org about Omega Corp partnered with Tau Ltd on 2024-01-02, $3.5M (12%), see https://x.org/y. John Smith agreed."
    got = [(s, k) for s, k, *_ in knowledge.entities(text)]
    for want in [("a.b@c.org", "email"), ("Omega Corp", "organization"), ("Tau Ltd", "organization"), ("2024-01-02", "date"), ("$3.5M", "money"), ("12%", "percent"), ("John Smith", "person")]:
        assert want in got
    for s, _, a, b, _ in knowledge.entities("Ünï " + text):
        assert ("Ünï " + text).encode()[a:b].decode() == s
    assert not [1 for s, k, *_ in knowledge.entities("The Summary of March Madness") if k == "person"]


def test_claims():
    c = knowledge.claims("Acme Corp revenue was $10M in 2023. Acme launched Rocket Nine since 2020. The sky is blue today. Acme Corp revenue was not known.")
    assert [(x[0], x[1], x[2]) for x in c] == [("Acme Corp", "revenue", "$10M"), ("Acme", "launched", "Rocket Nine since 2020"), ("The sky", "is", "blue today"), ("Acme Corp revenue", "is", "not known")]
    assert [x[6] for x in c] == [False, False, False, True] and c[0][8] == "2023" and c[1][8] == "2020"
    assert c[0][7] == 0.6 and c[3][7] == 0.3


def test_hashing_of_many_texts_is_that_of_each():
    e = embed.HashingEmbedder(128)
    texts = ["Apples and pears", "", "a", "?!", "one two one two one", "zażółć gęślą jaźń 日本語 é", "x" * 4000 + " y", *(" ".join(random.Random(k).choices(["river", "fish", "stock", "price", "of", "a"], k=40)) for k in range(30))]
    got = e.embed_all(texts)
    assert got.shape == (len(texts), 128)
    for g, t in zip(got, texts):
        assert g == pytest.approx(e.embed(t))
    assert e.embed_all([]).shape == (0, 128) and e.embed_all(["", "!"]).any() == False  # noqa: E712


def test_hashing_embedder():
    e = embed.HashingEmbedder(16)
    v = e.embed("Apples and pears")
    assert len(v) == 64 and math.isclose(v @ v, 1.0) and not e.embed("").any()
    assert v @ e.embed("apples and pears!") == pytest.approx(1) and v @ e.embed("apple and pear trees") > v @ e.embed("quantum field theory")


def test_mmr():
    import numpy as np

    vectors = {0: np.array([1.0, 0]), 1: np.array([1.0, 0.01]), 2: np.array([0, 1.0])}
    assert fusion.mmr([0, 1, 2], [1.0, 0.99, 0.8], vectors, 2) == [0, 2]
    assert fusion.mmr([0, 1, 2], [1.0, 0.99, 0.8], vectors, 2, 1.0) == [0, 1]
    assert fusion.mmr([0, 1], [1.0, 0.5], {}, 5) == [0, 1]
    assert [fusion.depth(k) for k in (1, 8, 100)] == [24, 48, 200]


def test_porter_never_grows():
    r = random.Random(1)
    for _ in range(500):
        w = "".join(r.choice("abcdeinoprstylzg") for _ in range(r.randint(1, 14)))
        assert len(T.stem(w)) <= len(w) + 1
