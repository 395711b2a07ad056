"""Times the headline queries: one JSON line with the seconds of each and their sum."""

import json
import os
import time

from sparkloom import queries as catalogue
from sparkloom.session import local_session, ship

HEADLINE = "doc_dedup normalize_hash html_text chunks keywords tokens hashing_embedding bm25_topk bm25_prefix cosine_topk rrf_hybrid rerank claims_rendered conflicts_numeric entities_resolved cooccurrence traverse intent_batch".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = ship(local_session("bench", cpus, memory="8g", partitions=max(8, int(cpus))))
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["stats"](spark, sf_dir).collect()  # starts workers
    seconds, rates = {}, {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    m = catalogue.QUERIES["chunks"](spark, sf_dir).count()
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    rates = {"chunked_docs_per_s": round(n / seconds["chunks"], 1), "chunks_per_s": round(m / seconds["chunks"], 1), "embedded_docs_per_s": round(n / seconds["hashing_embedding"], 1), "lexical_queries_per_s": round(q / seconds["bm25_topk"], 1), "hybrid_queries_per_s": round(q / seconds["rrf_hybrid"], 1)}
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf_dir.rstrip("/").rsplit("sf", 1)[-1]), "rates": rates}))


if __name__ == "__main__":
    main()
