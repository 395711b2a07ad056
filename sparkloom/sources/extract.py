"""Bytes to text: markup, office documents, books, code and plain text.

``extract`` handles one file; ``extracted`` maps it over a table of files (as
``binaryFile`` reads them) and keeps failures as rows with their error's name.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..text import control_share, normalize

MAX_BYTES, MAX_ENTRY, MAX_ENTRIES, MAX_BOOK = 64 << 20, 256 << 20, 4096, 512
MARKDOWN = frozenset("markdown md mdown mkd".split())
LANGUAGES = {
    **dict.fromkeys(["c", "h"], "c"),
    **dict.fromkeys(["cc", "cpp", "hpp"], "cpp"),
    **dict.fromkeys(["js", "jsx"], "javascript"),
    **dict.fromkeys(["bash", "sh", "zsh"], "shell"),
    **dict.fromkeys(["cfg", "ini", "toml"], "toml"),
    **dict.fromkeys(["yaml", "yml"], "yaml"),
    **{"cs": "csharp", "go": "go", "java": "java", "kt": "kotlin", "m": "objc", "php": "php", "py": "python", "rb": "ruby", "rs": "rust", "sql": "sql", "swift": "swift", "ts": "typescript"},
}
CODE = frozenset(LANGUAGES) | {"tsx"}
DATA = frozenset("csv htm html json tsv xml".split())
ARCHIVES = frozenset("docx epub pptx xlsx".split())
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
_ENTITY = re.compile(r"&([^;&]{1,9});")
_BREAKS = frozenset("article blockquote br div footer h1 h2 h3 h4 h5 h6 header li p section table tr".split())
_BODIES = frozenset("head noscript script style".split())


@dataclass
class Extracted:
    text: str
    doc_type: str
    content_hash: str
    language: str | None = None


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def decode_entities(text: str) -> str:
    """The six named references and numeric ones; anything else stays."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name in _NAMED:
            return _NAMED[name]
        try:
            code = int(name[2:], 16) if name[:2] in ("#x", "#X") else int(name[1:]) if name[0] == "#" else -1
            return chr(code) if 0 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]
        except ValueError:
            return m[0]

    return _ENTITY.sub(one, text)


def strip_markup(page: str) -> str:
    """Text outside tags; bodies of scripts, styles and heads go, block tags that open become line breaks, an unfinished tag ends the text."""
    low = page.lower() if page.isascii() else "".join(c.lower() if c.isascii() else c for c in page)
    out: list[str] = []
    at, n = 0, len(page)
    dropped: str | None = None
    while at < n:
        tag = page.find("<", at)
        if dropped is None:
            out.append(decode_entities(page[at : n if tag < 0 else tag]))
        if tag < 0:
            break
        end = low.find(">", tag)
        if end < 0:
            break
        inside = low[tag + 1 : end]
        closing = inside.startswith("/")
        name = re.match(r"[a-z0-9]*", inside.lstrip("/"))[0]
        at = end + 1
        if dropped is not None:
            if closing and inside.lstrip("/") == dropped:
                dropped = None
        elif name in _BODIES and not closing:
            close = low.find("</" + name, tag)
            if close < 0:
                dropped = name
            else:  # the closing tag's own end is text up to its bracket
                at = close + len(name) + 2
        elif name in _BREAKS and not closing:
            out.append("\n")
    return "".join(out)


def _open(data: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError, ValueError) as e:
        raise C.ExtractionFailed(f"not an archive: {e}") from e
    if len(z.infolist()) > MAX_ENTRIES:
        raise C.ExtractionFailed("too many entries")
    return z


def _entry(z: zipfile.ZipFile, name: str) -> str:
    try:
        with z.open(name) as f:
            data = f.read(MAX_ENTRY + 1)
    except (KeyError, zipfile.BadZipFile, RuntimeError, OSError, EOFError, NotImplementedError) as e:
        raise C.ExtractionFailed(f"{name}: {e}") from e
    if len(data) > MAX_ENTRY:
        raise C.ExtractionFailed(f"{name} is too large")
    return data.decode("utf-8", "replace")


def _runs(xml: str, ns: str) -> str:
    """A line for each paragraph of an office document, from its text runs."""
    out = []
    for p in re.findall(rf"<{ns}:p(?:\s[^>]*)?>(.*?)(?=</{ns}:p>|\Z)", xml, re.S):
        line = "".join(decode_entities(t) for t in re.findall(rf"<{ns}:t(?:\s[^>]*)?>(.*?)</{ns}:t>", p, re.S)).strip()
        if line:
            out.append(line + "\n")
    return "".join(out)


def docx(data: bytes) -> str:
    return _runs(_entry(_open(data), "word/document.xml"), "w")


def xlsx(data: bytes) -> str:
    """The first sheet: a line for each row, cells joined by " | "."""
    z = _open(data)
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in re.findall(r"<si(?:\s[^>]*)?>(.*?)</si>", _entry(z, "xl/sharedStrings.xml"), re.S):
            shared.append("".join(decode_entities(t) for t in re.findall(r"<t(?:\s[^>]*)?>(.*?)</t>", si, re.S)))
    out = []
    for row in re.findall(r"<row\b[^>]*>(.*?)</row>", _entry(z, "xl/worksheets/sheet1.xml"), re.S):
        cells = []
        for head, cell in re.findall(r"<c((?:\s[^>]*[^/>])?)>(.*?)</c>", row, re.S):
            m = re.search(r"<v(?:\s[^>]*)?>(.*?)</v>", cell, re.S) or re.search(r"<is(?:\s[^>]*)?>.*?<t(?:\s[^>]*)?>(.*?)</t>", cell, re.S)
            value = decode_entities(m[1]).strip() if m else ""
            if 't="s"' in head:
                if value.isdigit() and int(value) < len(shared):
                    cells.append(shared[int(value)])
            elif value:
                cells.append(value)
        if cells:
            out.append(" | ".join(cells) + "\n")
    return "".join(out)


def pptx(data: bytes) -> str:
    z = _open(data)
    slides = sorted(n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml"))
    return "".join(_runs(_entry(z, n), "a") + "\n" for n in slides)


def epub(data: bytes) -> str:
    z = _open(data)
    pages = sorted(n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))
    chosen = [n for n in pages if "content" in n] or pages
    return "".join(strip_markup(_entry(z, n)) + "\n" for n in chosen[:MAX_BOOK])


_READERS = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "epub": epub}


def kind_of(filename: str) -> tuple[str, str]:
    """The extension and type that a file's name gives it, whether or not its bytes can be read."""
    ext = filename.rsplit(".", 1)[-1].lower() if "." in filename.rsplit("/", 1)[-1] else ""
    return ext, "markdown" if ext in MARKDOWN else "code" if ext in CODE else "data" if ext in DATA else "binary" if ext in ARCHIVES or ext == "pdf" else "text"


def extract(filename: str, data: bytes) -> Extracted:
    """The normalised text of a file, its type and the hash of its bytes; a LoomError says why there is none."""
    if not data:
        raise C.EmptyInput("empty file")
    if len(data) > MAX_BYTES:
        raise C.InputTooLarge(f"{len(data)} bytes")
    ext, kind = kind_of(filename)
    if ext == "pdf":
        raise C.Unsupported("no reader for pdf")
    if ext in ARCHIVES:
        text = _READERS[ext](data)
    else:
        try:
            text = data.decode()
        except UnicodeDecodeError as e:
            raise (C.Unsupported if kind == "text" else C.ExtractionFailed)("not UTF-8") from e
        if kind == "text" and control_share(text) >= 0.1:
            raise C.Unsupported("control characters")
        if ext in ("html", "htm", "xml"):
            text = strip_markup(text)
    text = normalize(text)
    if not text.strip():
        raise C.EmptyInput("no text")
    return Extracted(text, kind, sha(data), LANGUAGES.get(ext))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to rows with about ``most`` bytes in a column, one row at least: what a task holds doesn't grow with the rows of a batch."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before, at = np.cumsum(size) - size, 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(before, before[at] + most)))
            yield b.slice(at, to - at)
            at = to


SCHEMA = "path string, filename string, size long, doc_type string, language string, content_hash string, text string, error string"


def extracted(files: DataFrame) -> DataFrame:
    """path, filename, size, doc_type, language, content_hash, text, error of a table of (path, content); failures have a type too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "content"):
            rows = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                name = (path or "").rsplit("/", 1)[-1]
                try:
                    x = extract(name, data or b"")
                    rows.append((path, name, len(data), x.doc_type, x.language, x.content_hash, x.text, None))
                except C.LoomError as e:
                    rows.append((path, name, len(data or b""), kind_of(name)[1], None, None, None, type(e).__name__))
            kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 5]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files below a folder as (path, content); those beyond the size limit come without content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return files.select("path", F.when(F.col("length") <= MAX_BYTES, F.col("content")).otherwise(F.substring("content", 1, MAX_BYTES + 1)).alias("content"))
