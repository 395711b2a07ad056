"""Documents to chunks: blocks of prose or code, packed, split, merged and weighted.

A state machine over one document's lines, so documents are independent: one
Arrow map, no shuffle. Lengths and offsets are bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import Config
from ..sources.extract import sha

_OPENERS = tuple(
    "fn |pub fn |pub(crate) fn |func |function |export function |def |async def |class |public class |private class |export class |impl |trait |struct |enum |interface |type |mod |package |import |#include|var |let |const |CREATE|INSERT|SELECT|UPDATE".split("|")
)
_UNITS = tuple("class |def |enum |fn |func |function |impl |pub fn |struct |trait ".split("|"))


@dataclass
class Chunk:
    text: str
    section: str | None
    kind: str
    start: int
    end: int
    authority: float = 1.0


def _size(s: str) -> int:
    return len(s.encode())


def heading_like(line: str) -> bool:
    """A line of its own in capitals (8 words at most), or one that ends in a colon (6 words); 60 bytes at most."""
    if not line or _size(line) > 60 or ". " in line or line[0] == "#":
        return False
    letters = [c for c in line if c.isalpha()]
    words = len(line.split())
    if letters and all(c.isupper() for c in letters) and words <= 8:
        return True
    return line.endswith(":") and 0 < words <= 6 and line[0].isalpha()


def _lines(text: str) -> Iterator[tuple[int, int, str]]:
    at = 0
    for line in text.split("\n"):
        n = _size(line) + 1
        yield at, at + n, line
        at += n


def prose_blocks(text: str) -> list[Chunk]:
    raw = text.encode()
    out: list[Chunk] = []
    section: str | None = None
    begin: int | None = None

    def close(end: int) -> None:
        nonlocal begin
        if begin is not None:
            t = raw[begin:end].decode().strip()
            if t:
                out.append(Chunk(t, section, "prose", begin, begin + _size(t)))
            begin = None

    for start, end, line in _lines(text):
        bare = line.strip()
        title = None
        if len(bare) > 1 and bare[0] == "#":
            rest = bare.lstrip("#")
            if rest.strip() and len(bare) - len(rest) <= 4:
                title = rest.strip()
        if title is None and heading_like(bare):
            title = bare.rstrip(":")
        if title is not None:
            close(start)
            out.append(Chunk(f"## {title}", title, "heading", start, end))
            section = title
        elif not bare:
            close(start)
        elif begin is None:
            begin = start
    close(len(raw))
    return out


def code_blocks(text: str) -> list[Chunk]:
    """Blocks that begin at an opener in the first column; what stands before the first one is left out."""
    raw = text.encode()
    starts = [start for start, _, line in _lines(text) if line.startswith(_OPENERS)]
    cuts = list(zip(starts, starts[1:] + [len(raw)])) if starts else [(0, len(raw))]
    out = []
    for a, b in cuts:
        t = raw[a:b].decode().strip()
        if t:
            unit = any(u in t.split("\n", 1)[0] for u in _UNITS)
            out.append(Chunk(t, None, "code_unit" if unit else "code", a, a + _size(t)))
    return out


def pack(blocks: list[Chunk], most: int) -> list[Chunk]:
    """Joins blocks of a kind up to ``most`` bytes; a heading begins a new chunk and stays with what follows."""
    out: list[Chunk] = []
    cur: Chunk | None = None
    section = None
    for b in blocks:
        heading = b.kind == "heading"
        if cur is not None and (heading or _size(cur.text) + _size(b.text) + 2 > most or b.kind != cur.kind):
            out.append(cur)
            cur = None
        if heading:
            section = b.section
            cur = Chunk(b.text + "\n\n", section, "prose", b.start, b.end)
        elif cur is None:
            cur = Chunk(b.text + "\n", b.section, b.kind, b.start, b.end)
        else:
            cur.text += b.text + "\n"
            cur.end = b.end
    if cur is not None and cur.text.strip():
        cur.text = cur.text.strip()
        out.append(cur)
    return out


def split_long(chunks: list[Chunk], most: int) -> list[Chunk]:
    """Cuts chunks of more than twice ``most`` bytes after stops and line ends, at least ``most`` bytes apart."""
    out = []
    for c in chunks:
        total = _size(c.text)
        if total <= 2 * most:
            out.append(c)
            continue
        cuts, last, at = [], 0, 0
        for i, ch in enumerate(c.text):
            n = _size(ch)
            if ch in ".!?\n" and (i + 1 == len(c.text) or c.text[i + 1].isspace()) and at - last >= most:
                cuts.append(at + n)
                last = at
            at += n
        raw, prev = c.text.encode(), 0
        for cut in [*cuts, total]:
            piece = raw[prev:cut].decode().strip() if cut > prev else ""
            if piece:
                out.append(replace(c, text=piece, start=c.start + prev, end=c.start + cut))
            prev = cut
    return out


def merge_short(chunks: list[Chunk], least: int) -> list[Chunk]:
    """Puts chunks of fewer than ``least`` bytes, but no code units, before the next one."""
    out: list[Chunk] = []
    held: Chunk | None = None
    for i, c in enumerate(chunks):
        if held is not None:
            c = replace(c, text=f"{held.text}\n{c.text}", start=held.start, section=held.section if c.section is None else c.section)
            held = None
        if i + 1 < len(chunks) and _size(c.text) < least and c.kind != "code_unit":
            held = c
        else:
            out.append(c)
    return out


def chunk_document(text: str, doc_type: str, cfg: Config = Config()) -> list[Chunk]:
    chunks = merge_short(split_long(pack((code_blocks if doc_type == "code" else prose_blocks)(text), cfg.chunk_max_chars), cfg.chunk_max_chars), cfg.chunk_min_chars)
    n = len(chunks)
    tail = n - max(n // 10, 1) if n > 10 else n
    for i, c in enumerate(chunks):
        c.authority = 1.2 if i < 3 else 1.1 if i >= tail or c.kind == "code_unit" else 1.0
    return chunks


SCHEMA = "id long, document_id long, chunk_index int, text string, section_title string, kind string, start_offset long, end_offset long, authority_score double, content_hash string"


def chunks(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Chunks of documents (id, text, doc_type); a chunk's id is document id * 2**20 + index, so ids keep the order of ingestion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]
        for b in batches:
            rows = []
            for doc, text, kind in zip(*(b.column(k).to_pylist() for k in range(3))):
                for i, c in enumerate(chunk_document(text or "", kind, cfg)):
                    rows.append((doc * 2**20 + i, doc, i, c.text, c.section, c.kind, c.start, c.end, c.authority, sha(c.text.encode())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select("id", "text", "doc_type").mapInArrow(run, SCHEMA)
