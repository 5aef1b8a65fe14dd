"""The settled gate: batches in any order, replayed and late, against the batch query; the state ends."""

import random

from pyspark.sql import functions as F

from provena.streaming import gate

SCHEMA = "k string, ts timestamp, ok boolean"


def _run(spark, stream, folder, out):
    q = gate.settled(stream, "ts", "k", "ok", late="200 seconds", keep="500 seconds").writeStream.foreachBatch(gate.by_batch(out)).option("checkpointLocation", folder).outputMode("append").start()
    q.processAllAvailable()
    rows = [o.get("numRowsTotal", 0) for o in (q.lastProgress or {}).get("stateOperators", [])] if q.lastProgress else []
    q.stop()
    return rows


def test_settled_equals_the_batch_query(spark, tmp_path):
    r, rows = random.Random(8), []
    for task in range(12):
        rows += [(f"t{task}", 1000 + 7 * task + 10 * k, r.random() < 0.3) for k in range(r.randint(1, 5))]
    want = {}
    for k, _, ok in sorted(rows, key=lambda x: x[1]):
        status, tries = want.get(k, ("open", 0))
        if status == "open":
            tries += 1
            want[k] = ("ok" if ok else "escalated" if tries > 2 else "open", tries)
    r.shuffle(rows)
    put = lambda some, name: spark.createDataFrame(some, "k string, s long, ok boolean").select("k", F.timestamp_seconds("s").alias("ts"), "ok").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{name}")
    put(rows[: len(rows) // 2], "a")
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    _run(spark, stream(), state, out)
    # The other half, out of order, with a third of what came before again; then time goes on, and what comes too late is left out.
    put(rows[len(rows) // 2 :] + rows[: len(rows) // 3], "b")
    _run(spark, stream(), state, out)
    put([("later", 1400, True)], "c")
    _run(spark, stream(), state, out)
    put([("t0", 1001, True), ("t1", 1002, True)], "d")
    _run(spark, stream(), state, out)
    got = [tuple(x) for x in gate.written(spark, out).select("task", "status", "tries").collect()]
    assert sorted(got) == sorted((k, *v) for k, v in want.items() if v[0] != "open")
    # A batch that is written again replaces itself.
    last = spark.read.parquet(f"{out}/batch=1")
    again = spark.createDataFrame(last.collect(), last.schema)
    gate.by_batch(out)(again, 1)
    assert sorted(tuple(x) for x in gate.written(spark, out).select("task", "status", "tries").collect()) == sorted(got)
    # Long after, nothing is kept but the last task's own.
    put([("end", 9000, False)], "e")
    _run(spark, stream(), state, out)
    put([("end", 9001, False)], "f")
    assert sum(_run(spark, stream(), state, out)) <= 8
