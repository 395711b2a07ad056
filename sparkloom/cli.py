"""Command line: python -m sparkloom.cli [--library PATH] [--json] COMMAND ..."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import DataFrame

from .config import LoomError, QueryRequest
from .library import Library
from .llm_providers import FakeProvider
from .session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom")
    p.add_argument("--library", default="library")
    p.add_argument("--json", action="store_true")
    p.add_argument("--llm", choices=["null", "fake"], default="null")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "docs", "conflicts", "stats", "integrity", "train", "reembed", "vacuum"):
        sub.add_parser(name)
    for name, arg in (("ingest", "paths"), ("entities", "limit"), ("claims", "subject"), ("graph", "entity"), ("delete", "id"), ("backup", "dest"), ("ask", "question")):
        one = sub.add_parser(name)
        if arg == "paths":
            one.add_argument(arg, nargs="+")
        elif arg == "limit":
            one.add_argument(arg, nargs="?", type=int, default=50)
        else:
            one.add_argument(arg, type=int if arg == "id" else str)
    for name in ("search", "query"):
        one = sub.add_parser(name)
        one.add_argument("text")
        one.add_argument("-k", type=int, default=8)
        one.add_argument("--mode", default="auto")
    one = sub.add_parser("provenance")
    one.add_argument("kind")
    one.add_argument("artifact")
    return p


def run(a: argparse.Namespace, lib: Library):
    match a.command:
        case "init":
            lib._save()
            return {"library": str(lib.path)}
        case "ingest":
            return [lib.ingest_file(p) for p in a.paths]
        case "docs":
            return lib.documents()
        case "search" | "query":
            out = lib.query(QueryRequest(a.text, top_k=a.k, mode=a.mode))
            return out | {"plan": dataclasses.asdict(out["plan"])}
        case "ask":
            return {"answer": lib.ask(a.question)}
        case "entities":
            return lib.list_entities(a.limit)
        case "claims":
            return lib.claims_about(a.subject)
        case "conflicts":
            return lib.conflicts()
        case "graph":
            return lib.neighborhood(lib.entity_by_name(a.entity) or a.entity)[0]
        case "stats":
            return lib.stats()
        case "provenance":
            return lib.provenance_of(a.kind, a.artifact)
        case "delete":
            lib.delete_document(a.id)
            return {"deleted": a.id}
        case "backup":
            lib.backup_to(a.dest)
            return {"backup": a.dest}
        case "integrity":
            return lib.integrity_check()
        case "train":
            return {"trained": lib.train_semantic_index()}
        case "reembed":
            return {"reembedded": lib.reembed_stale_chunks()}
        case "vacuum":
            lib.vacuum()
            return {"vacuumed": True}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    lib = Library(local_session(), a.library)
    if a.llm == "fake":
        lib.set_llm(FakeProvider())
    try:
        out = run(a, lib)
    except LoomError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    if isinstance(out, DataFrame):
        out = [r.asDict(recursive=True) for r in out.limit(1000).collect()]
    rows = out if isinstance(out, list) and not a.json else [out]
    for r in rows:
        print(json.dumps(r, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
