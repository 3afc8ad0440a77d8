"""Headline queries, warm: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from duewise.operators.retrieval import hybrid_retrieve  # noqa: E402
from duewise.queries.catalog import SPECS  # noqa: E402
from duewise.session import build_session, materialise  # noqa: E402
from duewise.sources.driver_tables import read_raw  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LARGE = "retrieval_large_pool"  # 2,000 queries over one pool of all orders
HEADLINE = [
    "O074_recovery_features", "O075_live_features", "O076_promise_features", "O034_policy", "O171_baseline_vs_engine",
    "O084_slice_cube", "O091_cuped_slices", "O111_hybrid_retrieve", "O170_live_decision_pass", "O162_state_replay",
    "O093_classification_metrics", "O156_rule_report", LARGE,
]


def large_pool(spark, sf_dir: str):
    orders = read_raw(spark, sf_dir, "orders")
    vectors = read_raw(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    text = F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "MMMM d"), F.col("o_custkey").cast("string"))
    rows = orders.withColumn("vec_id", F.col("o_orderkey") % n).join(vectors, "vec_id").select(
        F.col("o_orderkey").alias("invoice_id"), text.alias("case_text"), F.col("o_totalprice").alias("amount"), F.lit("all").alias("segment"),
        F.lit("all").alias("industry"), F.lit(False).alias("is_disputed"), "embedding",
    )
    asked = rows.orderBy(F.xxhash64("invoice_id")).limit(2000).withColumnsRenamed({"invoice_id": "query_id", "case_text": "text"})
    return hybrid_retrieve(materialise(asked, "queries"), materialise(rows, "corpus"))


def timed(spark, key: str) -> float:
    start = time.time()
    (large_pool if key == LARGE else SPECS[key].run)(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    spark = build_session("duewise-bench", cores=CPUS)
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for key in wanted:
        timed(spark, key)
        seconds[key] = timed(spark, key)
        print(f"{key} {seconds[key]}", file=sys.stderr, flush=True)
    inputs = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in ("orders", "lineitem", "events")}
    print(json.dumps({
        "metric": "headline queries, warm, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cores": CPUS, "input_rows": inputs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
