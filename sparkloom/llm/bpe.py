"""Byte-level BPE encoding and decoding with a local rank file.

Each match of the split pattern is merged by itself, as tiktoken does. Long
texts are cut first at safe boundaries: a match never holds a white-space
character after another kind of character, and the pattern looks ahead only
within white space, so a cut between a non-space and a following white-space
character leaves the matches as they were. Runs of white space of BLANK_CHARS
and more, on which the pattern's look-ahead would exhaust the stack, are matched
here: all but the last character before a word is one match, and at the end of
the text the whole run. Runs of one kind without a boundary are left whole.

Null texts count as empty: no tokens, and the hashes of nothing. Special
tokens' strings are ordinary text. Rows keep their multiplicity; more columns
are ignored; an empty table gives an empty result; texts of any length are
encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks

#: Characters after which a text is cut at the next safe boundary.
PIECE_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n\t])")
#: White space as the pattern has it; runs of so many characters are taken out of long texts.
BLANK_CHARS = 4096
_BLANK = re.compile(f"[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{{{BLANK_CHARS},}}")
_coders: dict[tuple[str, str], tuple] = {}


def coder(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file and the decimal form of each id; kept by process."""
    key = rank_file, pattern
    if key not in _coders:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _coders[key] = enc, [str(i) for i in range(max(ranks.values()) + 1)]
    return _coders[key]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cuts of a text at safe boundaries, each of ``size`` characters or up to the first boundary after."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    if at < len(text):
        yield text[at:]


def encode(enc, text: str) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    ids, at = [], 0
    for m in _BLANK.finditer(text):
        end = m.end() - (m.end() < len(text))
        ids += [i for x in pieces(text[at : m.start()]) for i in enc.encode_ordinary(x)]
        ids += enc._encode_single_piece(text[m.start() : end])
        at = end
    return ids + [i for x in pieces(text[at:]) for i in enc.encode_ordinary(x)]


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = True, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded bytes and, if asked for, ids (array<int>) and decoded (the bytes).

    Works by row: no shuffle, and memory for one batch of rows.
    """
    spark = docs.sparkSession
    blocks.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, decimal = coder(rank_file, pattern)
        for batch in batches:
            n, ids_hash, back_hash, all_ids, back = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(enc, text or "")
                raw = enc.decode_bytes(ids)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                back_hash.append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                if with_bytes:
                    back.append(raw)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), blocks.strings(ids_hash), blocks.strings(back_hash)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            if with_bytes:
                columns.append(pa.array(back, pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded binary" * with_bytes
    return docs.select("doc_id", "text").mapInArrow(run, schema)
