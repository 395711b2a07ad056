import pytest

from sparkloom import cli
from sparkloom import config as C
from sparkloom.config import Config, Filters, QueryRequest
from sparkloom.library import Library
from sparkloom.llm_providers import CommandProvider, FakeProvider

DOCS = {
    "a.md": "# Metrics\n\nAcme Corp revenue was $10M in 2023. Acme Corp worked with Beta Systems on pumps.\n\n## Leave\n\nStaff take thirty days of leave every year.\n",
    "b.md": "# Report\n\nAcme Corp revenue was $14M in 2023. Acme Corp opened an office. Contact Beta Systems there.\n",
    "c.md": "# Garden\n\nTomatoes grow well beside basil in warm soil during June 2019.\n",
    "d.txt": "Glaciers shrink as summers warm; the river below runs higher.\n",
}


@pytest.fixture(scope="module")
def lib(spark):
    x = Library(spark, cfg=Config(lsa_dim=4, semantic_min_chunks=3), clock=lambda: 1_700_000_000.0)
    failed = x.ingest(spark.createDataFrame([(n, bytearray(t.encode())) for n, t in DOCS.items()] + [("e.pdf", bytearray(b"%PDF")), ("copy.md", bytearray(DOCS["a.md"].encode()))], "path string, content binary"))
    assert [(r["path"], r["error"]) for r in failed.collect()] == [("e.pdf", "Unsupported")]
    yield x
    x.close()


def ids(lib):
    return {r["filename"]: r["id"] for r in lib.documents().collect()}


def test_ingest(lib):
    assert sorted(ids(lib)) == ["a.md", "b.md", "c.md", "d.txt"] and lib.integrity_check() == []
    again = lib.ingest_bytes("other.md", DOCS["a.md"].encode())
    assert again["id"] == ids(lib)["a.md"]
    with pytest.raises(C.EmptyInput):
        lib.ingest_bytes("x.txt", b"")
    with pytest.raises(C.DocumentNotFound):
        lib.document(999)


@pytest.mark.parametrize("mode", ["auto", "lexical", "dense", "hybrid"])
def test_search(lib, mode):
    out = lib.query(QueryRequest("tomatoes basil soil", top_k=2, mode=mode, include_provenance=True))
    assert out["hits"][0]["document"] == "c.md" and out["hits"][0]["rank"] == 1 and out["hits"][0]["matched_by"]
    assert "c.md" in out["context"] and out["provenance"]


def test_entities_conflicts_graph(lib):
    assert lib.entity_by_name("ACME Inc") == "acme"
    found = [(r["kind"], round(r["delta"], 3)) for r in lib.conflicts().collect()]
    assert found == [("same-period-disagreement", round(4 / 14, 3))]
    near, docs = lib.neighborhood("acme")
    assert "beta systems" in {r["other"] for r in near.collect()} and docs.count() == 2
    assert lib.traverse("acme", 1).count() >= 1 and lib.degrees().count() >= 2
    assert lib.claims_about("Acme Corp").count() == 2
    out = lib.query(QueryRequest("Acme Corp", mode="entity", include_graph=True))
    assert {h["document"] for h in out["hits"]} == {"a.md", "b.md"} and "acme" in out["entities"]
    assert lib.provenance_of("claim", str(lib.claims_about("acme").first()["claim_id"])).count() == 1


def test_filters(lib):
    i = ids(lib)
    only = lib.query(QueryRequest("revenue", filters=Filters(document_ids=(i["b.md"],))))
    assert {h["document"] for h in only["hits"]} == {"b.md"}
    assert not lib.query(QueryRequest("revenue", mode="lexical", filters=Filters(doc_types=("text",))))["hits"]
    assert {h["document"] for h in lib.query(QueryRequest("acme revenue", filters=Filters(must_contain="$14M")))["hits"]} == {"b.md"}
    assert {h["document"] for h in lib.query(QueryRequest("office pumps", mode="dense", filters=Filters(entities=("Acme Corp",))))["hits"]} <= {"a.md", "b.md"}
    assert not lib.query(QueryRequest("revenue", filters=Filters(as_of="2000-01-01T00:00:00.000Z")))["hits"]
    with pytest.raises(C.EmptyQuery):
        lib.query("  ")
    assert lib.query("'; DROP TABLE documents; --")["plan"].intent


def test_temporal(lib):
    hits = lib.query(QueryRequest("what grew in 2019", mode="auto"))["hits"]
    assert {h["document"] for h in hits} == {"c.md"}


def test_summary_and_ask(lib):
    i = ids(lib)["c.md"]
    assert lib.ask("zzzz qqqq") == "The library holds nothing about this."
    with pytest.raises(C.ModelUnavailable):
        lib.ask("tomatoes and basil")
    lib.set_llm(FakeProvider())
    assert lib.ask("tomatoes and basil").startswith("[fake]")
    text = lib.summarize(i)
    out = lib.query(QueryRequest("summarize it", filters=Filters(document_ids=(i,))))
    assert out["summary"] == text == lib.summary(i) and not out["hits"]
    lib.set_llm(CommandProvider(["/bin/cat", "{prompt}"]))
    assert "tomatoes" in lib.ask("tomatoes and basil")


def test_alias_merge_train_delete(lib, spark, tmp_path):
    lib.add_entity_alias("acme", "ACM")
    lib.merge_entities("acme", "beta systems", "same owner")
    assert lib.entity_by_name("Beta Systems") == "acme"
    with pytest.raises(C.EntityNotFound):
        lib.merge_entities("acme", "nobody")
    assert lib.train_semantic_index() and lib.stale_embedding_count() == 4
    assert lib.reembed_stale_chunks() == 4 and lib.stale_embedding_count() == 0
    lib.backup_to(str(tmp_path / "copy"))
    before = lib.stats()
    lib.delete_document(ids(lib)["b.md"])
    after = lib.stats()
    assert after["documents"] == before["documents"] - 1 and after["conflicts"] == 0 and lib.integrity_check() == []
    copy = Library(spark, str(tmp_path / "copy"), cfg=Config(lsa_dim=4))
    assert copy.stats()["documents"] == before["documents"] and copy.model.name == lib.model.name
    (tmp_path / "copy" / "model" / "lsa.npz").unlink()
    with pytest.raises(C.EmbeddingMismatch):
        Library(spark, str(tmp_path / "copy"))


def test_jobs_and_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "x.txt").write_text("Delta Corp launched Engine Nine in 2021.")
    lib = Library(spark, str(tmp_path / "lib"))
    lib.jobs.enqueue("process_document", path=str(tmp_path / "x.txt"))
    assert lib.run_jobs() == 1 and lib.documents().count() == 1
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    at = ["--library", str(tmp_path / "lib")]
    for args in (["docs"], ["search", "engine", "-k", "2"], ["entities"], ["claims", "Delta Corp"], ["stats"], ["integrity"], ["graph", "Delta Corp"], ["conflicts"], ["train"]):
        assert cli.main(at + args) == 0
    assert "Engine Nine" in capsys.readouterr().out
    assert cli.main(at + ["delete", "99"]) == 1
