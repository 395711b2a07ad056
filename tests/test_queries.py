"""Every query of the catalogue against its SQL, on the smallest tables."""

import importlib
import os
import random
import sys
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from sparkloom import queries as catalogue
from sparkloom.config import Config
from sparkloom.operators import embed, knowledge, lexical


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def lines(df: pd.DataFrame, columns: list[str]) -> list[str]:
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted("|".join(show(v) for v in r) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, db, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name not in catalogue.SQL:
        assert len(got)
        return
    want = db.sql(catalogue.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert lines(got, columns) == lines(want, columns)


@pytest.mark.parametrize("name", ["ann_full_probe", "cosine_topk"])
def test_more_queries_than_a_block(spark, sf, db, monkeypatch, name):
    monkeypatch.setattr(catalogue, "BLOCK", 3)
    want = db.sql(catalogue.SQL[name]).df()
    assert want["query_id"].nunique() > 3
    columns = sorted(want.columns)
    assert lines(catalogue.QUERIES[name](spark, sf).toPandas(), columns) == lines(want, columns)


def agrees(spark, tmp_path, tables: dict[str, pd.DataFrame], names: list[str]) -> None:
    """Queries against their SQL on tables of a test's own."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.to_parquet(tmp_path / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name in names:
        want = con.sql(catalogue.SQL[name]).df()
        assert len(want)
        assert lines(catalogue.QUERIES[name](spark, str(tmp_path)).toPandas(), sorted(want.columns)) == lines(want, sorted(want.columns)), name


def test_file_types_count_files_without_text(spark, tmp_path):
    texts = ["", " \n", None, "\x01\x02\x03", "x", "\x02y", "", "\x00\x01", "text", "\t"]
    docs = pd.DataFrame({"doc_id": pd.array([*range(-9, 11)], "Int64"), "text": texts * 2, "lang": "en", "source": "s"})
    agrees(spark, tmp_path, {"documents": docs}, ["file_types"])


def test_keywords_are_found_where_the_texts_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "PART", 9)
    r = random.Random(8)
    words = "Ähre ähre apple Apple pears plum fig figs the and 2024 x9y cherry date elder grape kiwi lemon mango nut olive peach é日 日本語 a1".split()
    rows = [(i, " ".join(r.choices(words, k=r.randrange(60)))) for i in range(40)] + [(50, None), (51, ""), (52, "the and 12"), (3, "olive olive plum"), (3, "kiwi"), (None, "grape grape nut"), (None, "nut")]
    docs = pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"), "text": [t for _, t in rows], "lang": "en", "source": "s"})
    agrees(spark, tmp_path, {"documents": docs}, ["term_df"])
    agrees(spark, tmp_path, {"documents": docs.dropna(subset=["doc_id"])}, ["keywords", "term_df"])
    # only keywords travel, at most 12 a document: no exchange stands before the map's result
    once = docs.drop_duplicates("doc_id").dropna(subset=["doc_id"])
    once.to_parquet(tmp_path / "documents.parquet")
    got = knowledge.keyword_rows(catalogue._docs(spark, str(tmp_path)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() and plan.index("MapInArrow") < plan.index("Aggregate")


def test_lsa_projection_is_the_whole_model(spark, tmp_path):
    r = random.Random(4)
    texts = [" ".join(r.choices([f"w{k}" for k in range(3000)], k=80)) for _ in range(200)]
    texts += [f"rare{k} rare{k + 1}" for k in range(20)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = np.array([x["vector"] for x in catalogue.lsa_projection(spark, str(tmp_path)).orderBy("id").collect()])
    df = Counter(w for t in texts for w in set(t.split()))
    terms = sorted((w for w in df if df[w] >= 2), key=lambda w: (-df[w], w))
    assert 2048 < len(terms) <= Config().lsa_max_vocab and Config().lsa_dim == 128
    tf = np.zeros((len(terms), len(texts)))
    at = {w: i for i, w in enumerate(terms)}
    for j, t in enumerate(texts):
        for w, c in Counter(t.split()).items():
            if w in at:
                tf[at[w], j] = c
    a = np.log1p(tf) * np.log(1 + len(texts) / np.array([df[w] for w in terms]))[:, None]
    y = a @ embed._gaussian_rows(np.arange(len(texts)), 136)
    for _ in range(4):
        y = a @ (a.T @ (y / np.abs(y).max()))
    q = np.linalg.qr(y[:, np.argsort(-(y**2).sum(0), kind="stable")[:128]])[0]
    want = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0).T @ q
    size = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.divide(want, size, out=np.zeros_like(want), where=size > 0)
    assert got.shape == want.shape == (220, 128) and np.abs(got[200:]).any(1).all()
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-3)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("sparkloom.llm.") or n in ("sparkloom.llm", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, name)

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name in ("sparkloom.llm", "corpus_pipeline"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    import sparkloom

    monkeypatch.delattr(sparkloom, "llm", raising=False)
    alone = importlib.reload(entry)
    assert set(alone.queries()) == set(catalogue.QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)
