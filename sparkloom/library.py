"""A library of documents in a folder: versions of Parquet tables and a manifest that names the current one.

Derived tables (chunks, vectors, postings, mentions, claims, edges, provenance)
are functions of the documents, the user's aliases and the merge log, so delete,
merge and retrain recompute or filter them, and nothing drifts. A change writes a
new version and then swaps the manifest: readers see all of it or none.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import config as C
from .config import Config, Filters, QueryRequest
from .llm_providers import NullProvider, Provider
from .operators import chunk, claims, dense, embed, entities, fusion, graph, knowledge, lexical, provenance
from .plans import planner
from .session import ship
from .sources.extract import extracted, read_files
from .streaming.jobs import Events, Jobs
from .text import canonical_key, tokenize

SCHEMA_VERSION = 1
TABLES = ("documents", "chunks", "vectors", "mentions", "claims", "keywords")
DOCUMENTS = "id long, path string, filename string, size long, doc_type string, language string, content_hash string, text string, text_bytes long, created_at string, summary string"


class Library:
    def __init__(self, spark: SparkSession, path: str | None = None, cfg: Config = Config(), clock=time.time, llm: Provider | None = None):
        self.spark, self.cfg, self.clock = ship(spark), cfg, clock
        self.temporary = path is None
        self.path = Path(path or tempfile.mkdtemp(prefix="library-"))
        self.path.mkdir(parents=True, exist_ok=True)
        self.llm, self.events = llm or NullProvider(), Events()
        self.jobs = Jobs(clock, cfg.job_backoff_base_secs, cfg.job_backoff_max_secs)
        self.index: dense.Index | None = None
        file = self.path / "manifest.json"
        if file.exists():
            self.manifest = json.loads(file.read_text())
            if self.manifest["schema"] > SCHEMA_VERSION:
                raise C.SchemaTooNew(f"schema {self.manifest['schema']}")
        else:
            self.manifest = {"schema": SCHEMA_VERSION, "tables": {}, "aliases": [], "merges": [], "next_id": 1, "model": None, "versions": C.VERSIONS, "meta": {}}
        self.model: embed.HashingEmbedder | embed.LsaModel = self._load_model() or embed.HashingEmbedder(cfg.embedding_dim)
        had = self.manifest["meta"].get("embedding")
        if had and had != self.model.name:
            raise C.EmbeddingMismatch(f"{had} was indexed, {self.model.name} is active")

    # --- tables

    def _save(self) -> None:
        tmp = self.path / f"manifest.{uuid.uuid4().hex}"
        tmp.write_text(json.dumps(self.manifest))
        os.replace(tmp, self.path / "manifest.json")

    def table(self, name: str) -> DataFrame:
        at = self.manifest["tables"].get(name)
        if at is None:
            schema = {"documents": DOCUMENTS, "chunks": chunk.SCHEMA, "vectors": "id long, vector array<float>, embedding_model string", "mentions": knowledge.MENTIONS, "claims": knowledge.CLAIMS, "keywords": "chunk_id long, document_id long, term string, weight double, rank int"}[name]
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*(str(self.path / p) for p in at))

    def _publish(self, tables: dict[str, DataFrame], append: bool = False) -> None:
        written = {}
        for name, t in tables.items():
            at = f"{name}-{uuid.uuid4().hex}"
            t.write.parquet(str(self.path / at))
            written[name] = [*(self.manifest["tables"].get(name, []) if append else []), at]
        self.manifest["tables"] |= written
        self._save()

    def vacuum(self) -> None:
        """Removes tables that the manifest doesn't name."""
        live = {p for at in self.manifest["tables"].values() for p in at}
        for p in self.path.iterdir():
            if p.is_dir() and p.name not in live and p.name != "model":
                shutil.rmtree(p)

    def _now(self) -> str:
        t = self.clock()
        return time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(t)) + f".{int(t * 1000) % 1000:03d}Z"

    # --- ingestion

    def ingest(self, files: DataFrame) -> DataFrame:
        """Adds the files (path, content) whose content is new; the table of what failed. Ids follow the order of content hashes."""
        seen = extracted(files)
        at = str(self.path / f"incoming-{uuid.uuid4().hex}")
        seen.write.parquet(at)
        seen = self.spark.read.parquet(at)
        first = W.partitionBy("content_hash").orderBy("path", "filename")
        new = seen.where("error is null").withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
        new = new.join(self.table("documents").select("content_hash"), "content_hash", "left_anti").withColumn("bucket", F.substring("content_hash", 1, 3))
        sizes = new.groupBy("bucket").count().orderBy("bucket").collect()  # at most 4096 rows
        if sizes:
            offsets, at_id = [], self.manifest["next_id"]
            for r in sizes:
                offsets.append((r[0], at_id))
                at_id += r[1]
            base = self.spark.createDataFrame(offsets, "bucket string, base long")
            place = F.row_number().over(W.partitionBy("bucket").orderBy("content_hash"))
            docs = new.join(F.broadcast(base), "bucket").withColumn("id", F.col("base") + place - 1)
            docs = docs.select("id", "path", "filename", "size", "doc_type", "language", "content_hash", "text", F.octet_length("text").cast("long").alias("text_bytes"), F.lit(self._now()).alias("created_at"), F.lit(None).cast("string").alias("summary"))
            self.manifest["next_id"] = at_id
            self._publish({"documents": docs}, append=True)
            self._derive(self.table("documents").where(F.col("id") >= offsets[0][1]))
            self.events.publish("documents.added", offsets[0][1], str(at_id - offsets[0][1]))
        return seen.where("error is not null").select("path", "error")

    def _derive(self, docs: DataFrame) -> None:
        self._publish({"chunks": chunk.chunks(docs, self.cfg)}, append=True)
        new = self.table("chunks").join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        self._publish({"vectors": embed.embedded(new, self.model)}, append=True)
        if self.cfg.enable_knowledge_extraction:
            self._publish({"mentions": knowledge.mentions(new), "claims": knowledge.claim_table(new)}, append=True)
            self._publish({"keywords": knowledge.keyword_table(self.table("chunks"))})
        self.manifest["meta"]["embedding"] = self.model.name
        self._save()
        self.index = None

    def ingest_bytes(self, filename: str, data: bytes) -> dict:
        """The document of these bytes, added if they are new; a LoomError if they hold no text."""
        from .sources.extract import extract

        x = extract(filename, data)
        self.ingest(self.spark.createDataFrame([(filename, bytearray(data))], "path string, content binary"))
        return self._one(self.table("documents").where(F.col("content_hash") == x.content_hash))

    def ingest_file(self, path: str) -> dict:
        return self.ingest_bytes(path, Path(path).read_bytes())

    def ingest_folder(self, path: str, pattern: str | None = None) -> DataFrame:
        return self.ingest(read_files(self.spark, path, pattern))

    # --- documents

    def _one(self, t: DataFrame) -> dict:
        row = t.drop("text").first()
        if row is None:
            raise C.DocumentNotFound
        return row.asDict()

    def documents(self) -> DataFrame:
        """Newest first; a path names the newest document that had it."""
        newest = F.row_number().over(W.partitionBy("path").orderBy(F.desc("id")))
        rows = self.table("documents").withColumn("path", F.when(newest == 1, F.col("path")))
        sizes = self.table("chunks").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("chunk_count"), F.countDistinct("section_title").alias("section_count"))
        return rows.drop("text").join(sizes, "id", "left").orderBy(F.desc("created_at"), F.desc("id"))

    def document(self, doc_id: int) -> dict:
        return self._one(self.table("documents").where(F.col("id") == doc_id))

    def summarize(self, doc_id: int) -> str:
        """Makes and keeps a summary with the language model."""
        row = provenance.summary_input(self.table("chunks").where(F.col("document_id") == doc_id)).first()
        if row is None:
            raise C.DocumentNotFound
        text = self.llm.generate(f"Summarise:\n{row['text']}", self.cfg.summary_max_tokens, self.cfg.summary_temperature)
        docs = self.table("documents").withColumn("summary", F.when(F.col("id") == doc_id, F.lit(text)).otherwise(F.col("summary")))
        self._publish({"documents": docs})
        return text

    def summary(self, doc_id: int) -> str | None:
        return self.document(doc_id)["summary"]

    def delete_document(self, doc_id: int) -> None:
        self.document(doc_id)
        kept = {"documents": self.table("documents").where(F.col("id") != doc_id)}
        kept |= {n: self.table(n).where(F.col("document_id") != doc_id) for n in ("chunks", "mentions", "claims")}
        kept["vectors"] = self.table("vectors").where(F.shiftright("id", 20) != doc_id)
        self._publish(kept)
        self._publish({"keywords": knowledge.keyword_table(self.table("chunks"))})
        self.index = None
        self.events.publish("document.deleted", doc_id)

    # --- entities, claims, graph

    def resolved(self) -> DataFrame:
        rows = entities.resolve(self.table("mentions"))
        if self.manifest["aliases"]:
            user = self.spark.createDataFrame([(a.lower(), k) for k, a in self.manifest["aliases"]], "alias string, aliased string")
            rows = rows.join(F.broadcast(user), F.lower("surface") == F.col("alias"), "left").withColumn("entity_key", F.coalesce("aliased", "entity_key")).drop("alias", "aliased")
        return entities.merged(rows, [tuple(m) for m in self.manifest["merges"]])

    def list_entities(self, most: int = 100) -> DataFrame:
        return entities.entity_table(self.resolved()).orderBy(F.desc("mention_count"), "entity_key").limit(most)

    def entity_by_name(self, name: str) -> str | None:
        row = entities.entity_table(self.resolved()).where((F.col("entity_key") == canonical_key(name)) | F.exists("aliases", lambda a: F.lower(a) == name.lower())).first()
        return row and row["entity_key"]

    def document_entities(self, doc_id: int) -> DataFrame:
        return self.resolved().where(F.col("document_id") == doc_id).groupBy("entity_key").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "entity_key")

    def add_entity_alias(self, entity: str, alias: str) -> None:
        if [entity, alias] not in self.manifest["aliases"]:
            self.manifest["aliases"].append([entity, alias])
            self._save()

    def merge_entities(self, survivor: str, gone: str, reason: str = "") -> None:
        if survivor == gone or entities.entity_table(self.resolved()).where(F.col("entity_key").isin(survivor, gone)).count() < 2:
            raise C.EntityNotFound(f"{survivor}, {gone}")
        self.manifest["merges"].append([survivor, gone])
        self.manifest["meta"].setdefault("merge_reasons", []).append(reason)
        self._save()
        self.events.publish("entity.merged", 0, f"{gone} -> {survivor}")

    def edges(self) -> DataFrame:
        return entities.cooccurrence(self.resolved())

    def neighborhood(self, entity: str, most: int = 20) -> tuple[DataFrame, DataFrame]:
        return graph.neighborhood(self.edges(), self.resolved(), entity, most)

    def traverse(self, entity: str, depth: int = 2, most: int = 20) -> DataFrame:
        return graph.traverse(self.edges(), entity, depth, most)

    def degrees(self) -> DataFrame:
        return graph.degrees(self.edges())

    def document_claims(self, doc_id: int) -> DataFrame:
        return self.table("claims").where(F.col("document_id") == doc_id).orderBy("claim_id")

    def claims_about(self, subject: str) -> DataFrame:
        return self.table("claims").where(F.col("subject_key") == canonical_key(subject)).orderBy("claim_id")

    def conflicts(self, most: int = 100) -> DataFrame:
        return claims.latest(claims.conflicts(self.table("claims")), most)

    def provenance(self) -> DataFrame:
        return provenance.table(self.table("chunks"), self.table("mentions"), self.table("claims"))

    def provenance_of(self, kind: str, artifact: str) -> DataFrame:
        return self.provenance().where((F.col("artifact_type") == kind) & (F.col("artifact_id") == artifact))

    # --- semantic model

    def train_semantic_index(self) -> bool:
        """Trains LSA on the chunks if there are enough; vectors stay those of the old model until they are made again."""
        rows = self.table("chunks")
        if self.cfg.embedding_provider != "lsa" or rows.count() < self.cfg.semantic_min_chunks:
            return False
        model = embed.train(rows, self.cfg)
        if model is None:
            return False
        at = self.path / "model"
        at.mkdir(exist_ok=True)
        np.savez(at / "lsa.npz", terms=np.array(model.terms), vectors=model.vectors)
        self.model = model
        self.manifest["model"] = model.name
        self.manifest["meta"]["embedding"] = model.name
        self._save()
        self.events.publish("semantic.trained", 0, model.name)
        return True

    def _load_model(self) -> embed.LsaModel | None:
        file = self.path / "model" / "lsa.npz"
        if self.manifest["model"] is None or not file.exists():
            return None
        with np.load(file) as z:
            return embed.LsaModel(z["terms"].tolist(), z["vectors"])

    def stale_embedding_count(self) -> int:
        return embed.stale(self.table("vectors"), self.model.name).count()

    def reembed_stale_chunks(self) -> int:
        vectors = self.table("vectors")
        old = embed.stale(vectors, self.model.name)
        n = old.count()
        if n:
            again = embed.embedded(self.table("chunks").join(old.select("id"), "id", "left_semi"), self.model)
            self._publish({"vectors": vectors.where(F.col("embedding_model").eqNullSafe(self.model.name)).unionByName(again)})
            self.index = None
        return n

    # --- queries

    def candidates(self, f: Filters) -> DataFrame | None:
        """Ids of chunks that satisfy the filters; None for no filter."""
        if f.empty():
            return None
        rows = self.table("chunks")
        docs = self.table("documents")
        if f.document_ids:
            rows = rows.where(F.col("document_id").isin(*f.document_ids))
        if f.doc_types:
            docs = docs.where(F.col("doc_type").isin(*f.doc_types))
        if f.as_of:
            docs = docs.where(F.col("created_at") <= f.as_of)
        if f.must_contain:
            rows = rows.where(F.lower("text").contains(f.must_contain.lower()))
        if f.entities:
            keys = [canonical_key(n) for n in f.entities]
            rows = rows.join(self.resolved().where(F.col("entity_key").isin(keys)).select("document_id").distinct(), "document_id", "left_semi")
        return rows.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(F.col("id").alias("chunk_id"))

    def _dense(self, text: str, k: int, allowed: DataFrame | None) -> DataFrame:
        vectors = self.table("vectors").where(F.col("embedding_model") == self.model.name).select("id", "vector")
        query = self.model.embed(text)
        if not query.any():
            return self.spark.createDataFrame([], "query_id long, id long, rank int, value double")
        mark = dense.fingerprint(vectors, self.model.name)
        if dense.use_index(self.cfg, mark[1], allowed is not None):
            if self.index is None or self.index.fingerprint != mark:
                self.index = dense.build(vectors, max(1, min(1024, int(mark[1] ** 0.5))), model=self.model.name)
            found = self.index.search([(0, query.tolist())], k, max(1, self.cfg.ann_ef_search // 4))
        else:
            if allowed is not None:
                vectors = vectors.join(allowed.select(F.col("chunk_id").alias("id")), "id", "left_semi")
            found = dense.exact(vectors, [(0, query.tolist())], k, self.cfg.max_dense_scan)
        return found.select("query_id", "id", "rank", F.col("similarity").alias("value"))

    def _lexical(self, text: str, k: int, allowed: DataFrame | None) -> DataFrame:
        empty = self.spark.createDataFrame([], "query_id long, id long, rank int, value double")
        if not tokenize(text):
            return empty
        rows = self.table("chunks")
        found = lexical.search(lexical.postings(rows), lexical.stats(rows), lexical.phrases(self.spark, [(0, text)]), k, allowed)
        return found.select("query_id", F.col("chunk_id").alias("id"), "rank", F.col("score").alias("value"))

    def known_entities(self, text: str, most: int = 20) -> list[tuple[str, str]]:
        """(key, name) of entities whose whole name is in the question."""
        words = [t for t in tokenize(text) if len(t.encode()) >= 3]
        if not words:
            return []
        rows = entities.entity_table(self.resolved()).where(F.lit(text.lower()).contains(F.lower("display_name")) & F.arrays_overlap(F.split(F.col("entity_key"), " "), F.array(*map(F.lit, words))))
        return [(r["entity_key"], r["display_name"]) for r in rows.orderBy(F.desc("mention_count"), "entity_key").limit(most).collect()]

    def query(self, request: QueryRequest | str) -> dict:
        """plan, hits (with what matched), context, and, if asked for, provenance and related entities."""
        r = QueryRequest(request) if isinstance(request, str) else request
        if not r.text.strip():
            raise C.EmptyQuery
        p = planner.plan(r, self.cfg)
        known = self.known_entities(r.text)
        if p.use_summary and len(r.filters.document_ids) == 1 and (s := self.summary(r.filters.document_ids[0])):
            return {"plan": p, "hits": [], "context": s, "summary": s, "provenance": [], "entities": []}
        k, allowed = fusion.depth(r.top_k), self.candidates(r.filters)
        channels = []
        if p.mode in ("hybrid", "lexical"):
            channels.append(("fts", p.w_fts, self._lexical(r.text, k, allowed)))
        if p.mode in ("hybrid", "dense"):
            channels.append(("vector", p.w_vector, self._dense(r.text, k, allowed)))
        if p.mode == "entity" and known:
            rows = self.resolved().where(F.col("entity_key").isin([x[0] for x in known])).select("chunk_id").distinct()
            rows = rows.join(allowed, "chunk_id", "left_semi") if allowed is not None else rows
            top = rows.orderBy("chunk_id").limit(k).withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("chunk_id")))  # k rows
            channels.append(("entity", fusion.ENTITY_WEIGHT, top.select(F.lit(0).cast("long").alias("query_id"), F.col("chunk_id").alias("id"), "rank", F.lit(None).cast("double").alias("value"))))
        hits = self._hits(r, p, channels, known) if channels else []
        hits = self._temporal(p, hits)
        out = {"plan": p, "hits": hits, "context": planner.assemble_context(hits, r.context_budget, r.max_per_document), "summary": None, "provenance": [], "entities": []}
        if r.include_provenance and hits:
            rows = provenance.first_of(provenance.of_chunks(self.table("chunks").where(F.col("id").isin([h["id"] for h in hits]))), "chunk")
            out["provenance"] = [x.asDict() for x in rows.orderBy("artifact_id").collect()]
        if (r.include_graph or p.use_entities) and hits:
            near = self.resolved().where(F.col("chunk_id").isin([h["id"] for h in hits[:6]])).select("entity_key").distinct().orderBy("entity_key")
            out["entities"] = [x[0] for x in near.collect()]
        return out

    def _hits(self, r: QueryRequest, p: planner.QueryPlan, channels: list, known: list) -> list[dict]:
        fused = fusion.rrf(channels, self.cfg.rrf_k)
        rows = fused.join(self.table("chunks"), "id").join(self.table("documents").select(F.col("id").alias("document_id"), F.col("filename").alias("document")), "document_id")
        names = [] if p.mode == "entity" else [x[1] for x in known]
        score = fusion.boosts(F.col("score"), F.col("text"), F.col("section_title"), F.col("authority_score"), F.lit(r.text), F.array(*map(F.lit, names)).cast("array<string>"))
        rows = rows.withColumn("score", score).withColumn("query", F.lit(r.text))
        order = fusion.rerank(rows.select("query_id", "id", "score", "text", "query"), self.cfg.rerank_top_n if self.cfg.enable_reranking and tokenize(r.text) else 0)
        found = rows.drop("score", "query_id", "query").join(order, "id").orderBy("rank").collect()  # at most 600 rows
        vectors = {}
        if self.cfg.mmr_lambda < 0.999 and r.top_k < len(found):
            vectors = {x["id"]: np.array(x["vector"]) for x in self.table("vectors").where(F.col("id").isin([x["id"] for x in found[:64]])).collect()}
        chosen = fusion.mmr([x["id"] for x in found], [x["score"] for x in found], vectors, r.top_k, self.cfg.mmr_lambda)
        out = []
        for i, c in enumerate(chosen, 1):
            x = found[c]
            why = [m.asDict() for m in x["matched_by"]]
            if r.text.strip() and r.text.lower() in x["text"].lower():
                why.append({"source": "phrase"})
            why += [{"source": "entity", "name": n} for n in names[:20] if n.lower() in x["text"].lower()][:1]
            if set(tokenize(x["section_title"] or "")) & set(tokenize(r.text)):
                why.append({"source": "section"})
            out.append({"rank": i, "id": x["id"], "document_id": x["document_id"], "document": x["document"], "section": x["section_title"], "text": x["text"], "score": x["score"], "matched_by": why})
        return out

    def _temporal(self, p: planner.QueryPlan, hits: list[dict]) -> list[dict]:
        year = time.gmtime(self.clock()).tm_year
        if p.temporal.kind == "latest":
            for h in hits:
                h["score"] += self.cfg.freshness_boost * p.temporal.score(h["text"], year)
            hits = sorted(hits, key=lambda h: -h["score"])
            for i, h in enumerate(hits, 1):
                h["rank"] = i
        elif p.temporal.kind == "years":
            hits = [h for h in hits if p.temporal.score(h["text"], year) > 0] or hits
        return hits

    def ask(self, question: str) -> str:
        """An answer from the sources only, or that there are none."""
        found = self.query(QueryRequest(question))
        if not found["hits"] and not found["context"]:
            return "The library holds nothing about this."
        return self.llm.generate(planner.grounded_prompt(question, found["context"]), 512, 0.2)

    # --- upkeep

    def stats(self) -> dict[str, int]:
        out = {r["name"]: r["rows"] for r in provenance.counts(documents=self.table("documents"), chunks=self.table("chunks"), mentions=self.table("mentions"), claims=self.table("claims"), entities=entities.entity_table(self.resolved()), relationships=self.edges(), conflicts=claims.conflicts(self.table("claims")), provenance=self.provenance()).collect()}
        return out | {"bytes": sum(p.stat().st_size for p in self.path.rglob("*") if p.is_file())}

    def integrity_check(self) -> list[str]:
        docs, rows = self.table("documents"), self.table("chunks")
        found = [(n, provenance.orphans(self.table(n), "document_id", docs).count()) for n in ("chunks", "mentions", "claims")] + [("vectors", provenance.orphans(self.table("vectors"), "id", rows).count())]
        return [f"{n}: {c} rows without a parent" for n, c in found if c]

    def backup_to(self, dest: str) -> None:
        """The current version's tables and the manifest."""
        to = Path(dest)
        to.mkdir(parents=True, exist_ok=False)
        for at in [p for paths in self.manifest["tables"].values() for p in paths] + ["model"] * (self.path / "model").exists():
            shutil.copytree(self.path / at, to / at)
        (to / "manifest.json").write_text(json.dumps(self.manifest))

    def run_jobs(self) -> int:
        """Runs queued jobs: process_document (path), reembed, train_semantic (which queues reembed), delete_document (id)."""

        def train(_: dict) -> None:
            if self.train_semantic_index():
                self.jobs.enqueue("reembed")

        return self.jobs.work({"process_document": lambda x: self.ingest_file(x["path"]), "reembed": lambda _: self.reembed_stale_chunks(), "train_semantic": train, "delete_document": lambda x: self.delete_document(x["id"])})

    def subscribe(self, f) -> None:
        self.events.subscribe(f)

    def set_llm(self, provider: Provider) -> None:
        self.llm = provider

    def close(self) -> None:
        self.jobs.cancel_pending()
        if self.temporary:
            shutil.rmtree(self.path, ignore_errors=True)
