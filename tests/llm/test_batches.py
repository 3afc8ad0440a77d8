"""Rows go to Python in batches of bounded size."""

import pyarrow as pa
from pyspark.sql import functions as F

from duewise.llm import secrets
from duewise.llm.common import prepare

LIMIT = 4 << 20


def test_long_rows_go_to_python_some_at_a_time(spark):
    docs = prepare(spark).range(0, 5000, numPartitions=1).select("id", F.repeat(F.lit("word "), 1000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    got = docs.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 5000 and max(r["size"] for r in got) < LIMIT + 100_000
    wide = docs.limit(3).select("id", F.repeat("text", 1200).alias("text"))
    assert [r["n"] for r in wide.mapInArrow(sizes, "n long, size long").collect()] == [1, 1, 1]


def test_redaction_keeps_rows_in_place_over_many_batches(spark):
    secret = F.when(F.col("id") % 3 == 0, F.concat(F.lit("password = x9Qe7kLm2Vb"), F.col("id"), F.lit(" ")))
    text = F.when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.coalesce(secret, F.lit("")), F.repeat(F.lit("word "), 1000)))
    docs = prepare(spark).range(0, 2500, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text"))
    rows = secrets.redact(docs.withColumn("n_chars", F.length("text"))).collect()
    assert len(rows) == 2500
    for r in rows:
        want = None if r["doc_id"] % 5 == 0 else ("[secret] " if r["doc_id"] % 3 == 0 else "") + "word " * 1000
        assert r["text"] == want and r["n_chars"] == (want and len(want))
