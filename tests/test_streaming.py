"""Completeness of runs on a stream against the batch contract."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import traces
from ledgerloom.streaming import runs

STORE = "spark.sql.streaming.stateStore.providerClass"


def test_completeness_of_a_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for run in range(60):
        n = rng.randint(1, 9)
        numbers = [k for k in range(1, n + 1) if run % 3 or rng.random() > 0.3]
        numbers += numbers[:1] if run % 4 == 0 else []
        rng.shuffle(numbers)
        rows += [(f"r{run}", k, n if i % 2 == 0 else None, 1_700_000_000 + rng.randint(0, 1200)) for i, k in enumerate(numbers)]
    rng.shuffle(rows)
    made = lambda some: spark.createDataFrame(some, "run string, sequence long, n long, s long").select("run", "sequence", "n", F.timestamp_seconds("s").alias("ts"))
    folder = f"file://{tmp_path}/in"
    for k in range(3):
        made(rows[k::3]).coalesce(1).write.mode("append").parquet(folder)
    made([("end", 1, 1, 1_700_100_000)]).coalesce(1).write.mode("append").parquet(folder)  # time goes on
    made([("end", 1, 1, 1_700_200_000)]).coalesce(1).write.mode("append").parquet(folder)
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("run string, sequence long, n long, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
        told = runs.run_completeness(stream, "run", "sequence", "n", "ts", "1 hour", 3600)
        query = told.writeStream.format("memory").queryName("told").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    found = sorted(tuple(r) for r in spark.table("told").where("run <> 'end'").collect())
    expected = sorted(tuple(r) for r in traces.completeness(made(rows), "run", "sequence", "n").collect())
    assert len({r[0] for r in found}) == len(found)
    assert found == expected and {r[3] is None for r in found} == {True, False}
