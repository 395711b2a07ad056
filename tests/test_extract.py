import io
import zipfile

import pyarrow as pa
import pytest

from sparkloom import config as C
from sparkloom.sources import extract as E
from sparkloom.streaming import ingest


def archive(**files) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), text)
    return out.getvalue()


def test_markup():
    page = "<html><head><title>x</title></head><body><p>A &amp; b<p>c<br>d</p><script>if (a<b) c();</script><style>p{}</style>&#65;&#x42;&nope;&nbsp;e</body>"
    text = E.extract("p.html", page.encode()).text
    assert text.split() == [">", "A", "&", "b", "c", "d>>AB&nope;", "e"]  # the brackets that end dropped elements stay
    assert "title" not in text and "if (a" not in text and "AB&nope;" in text
    assert E.strip_markup("before <unfinished") == "before "


def test_office_files():
    word = archive(word__document_DOT_xml="<w:document><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t xml:space='preserve'> world &amp; all</w:t></w:r></w:p><w:p w:x='1'><w:t>Next</w:t></w:p></w:document>")
    assert E.extract("a.docx", word).text == "Hello world & all\nNext\n\n"
    sheet = archive(xl__sharedStrings_DOT_xml="<sst><si><t>name</t></si><si><r><t>to</t></r><r><t>tal</t></r></si></sst>", xl__worksheets__sheet1_DOT_xml='<row r="1"><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c><v>1.5</v></c><c t="inlineStr"><is><t>x</t></is></c></row>')
    assert E.extract("a.xlsx", sheet).text == "name | total\n1.5 | x\n\n"
    slides = archive(ppt__slides__slide1_DOT_xml="<a:p><a:t>One</a:t></a:p>", ppt__slides__slide2_DOT_xml="<a:p><a:t>Two</a:t></a:p>")
    assert E.extract("a.pptx", slides).text.split() == ["One", "Two"]
    book = archive(OEBPS__content1_DOT_xhtml="<p>Chapter</p>", OEBPS__toc_DOT_xhtml="<p>Contents</p>")
    assert E.extract("a.epub", book).text.split() == ["Chapter"]


@pytest.mark.parametrize("name,data,error", [("a.txt", b"", C.EmptyInput), ("a.txt", b" \n ", C.EmptyInput), ("a.bin", b"\x00\x01\x02\x03abc", C.Unsupported), ("a.txt", b"\xff\xfe\xfd", C.Unsupported), ("a.md", b"\xff\xfe", C.ExtractionFailed), ("a.pdf", b"%PDF-1.4", C.Unsupported), ("a.docx", b"PK not a zip", C.ExtractionFailed), ("a.docx", archive(other="x"), C.ExtractionFailed)])
def test_refusals(name, data, error):
    with pytest.raises(error):
        E.extract(name, data)


def test_too_large(monkeypatch):
    monkeypatch.setattr(E, "MAX_BYTES", 10)
    with pytest.raises(C.InputTooLarge):
        E.extract("a.txt", b"x" * 11)


@pytest.mark.parametrize("name,kind,language", [("a.MD", "markdown", None), ("b.py", "code", "python"), ("c.tsx", "code", None), ("d.csv", "data", None), ("e", "text", None), ("f.weird", "text", None), ("g.h", "code", "c")])
def test_types(name, kind, language):
    x = E.extract(name, b"some text")
    assert (x.doc_type, x.language) == (kind, language) and x.content_hash == E.sha(b"some text")


def test_table_keeps_failures(spark):
    rows = spark.createDataFrame([("x/a.txt", bytearray(b"hello")), ("x/b.txt", bytearray(b"")), ("x/c.pdf", bytearray(b"%PDF")), (None, None)], "path string, content binary")
    got = {r["path"]: (r["text"], r["error"]) for r in E.extracted(rows).collect()}
    assert got == {"x/a.txt": ("hello\n", None), "x/b.txt": (None, "EmptyInput"), "x/c.pdf": (None, "Unsupported"), None: (None, "EmptyInput")}


def test_batches_are_cut_by_bytes():
    data = [b"x" * n for n in (5, 90, 0, 40, 40, 300, 1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([*data, None])], ["i", "content"])
    parts = list(E.slices(iter([batch, batch.slice(2, 0), batch.slice(3)]), "content", 100))
    assert [i for p in parts for i in p.column("i").to_pylist()] == [*range(9), *range(3, 9)]
    assert len(parts) == 5 and all(sum(len(x or b"") for x in p.column("content").to_pylist()[:-1]) <= 100 for p in parts)


def test_stream_adds_content_once(spark, tmp_path):
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()
    (src / "a.txt").write_text("first text")
    (src / "b.txt").write_text("first text")
    (src / "bad.pdf").write_text("%PDF")
    run = lambda: ingest.ingest_stream(ingest.stream_files(spark, str(src)), out, check).awaitTermination()
    run()
    assert spark.read.parquet(out).count() == 1
    (src / "c.txt").write_text("first text")
    (src / "d.md").write_text("second text")
    run()
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["first text\n", "second text\n"]
