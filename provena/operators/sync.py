"""Upkeep by deltas: which rules trace to which files, kept in a folder and changed batch by batch.

The trace is kept in buckets by file. A batch reads and writes the buckets of the files it names, nothing
else; what is kept by rule (files, and a sum of hashes of what they say, which deltas add to and take from)
is changed for the rules it touches. A manifest, written last, says which version of each bucket holds, so a
batch that died halfway is as if it hadn't begun, and one that comes again isn't applied again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a trace; a manifest names each of them, and a batch is at most a rewrite of all.
BUCKETS = 64

_TRACE = "file string, rule string, value string, bucket int"
_RULES = "rule string, files long, digest decimal(38,0), bucket int"
_CHANGED = "file string, rule string, verdict string, rules long, batch int"


def _bucket(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def _said(file: Column, value: Column) -> Column:
    """A hash that sums of are kept: what a file says of a rule."""
    return F.xxhash64(file, value).cast("decimal(38,0)")


class Trace:
    """A trace in a folder: (file, rule, value), one value for each file and rule."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.state = {"batch": -1, "buckets": buckets, "trace": {}, "rules": {}}
        last = self._manifests().orderBy(F.desc("batch")).first()
        if last:
            self.state = json.loads(last["state"])

    def _manifests(self) -> DataFrame:
        jvm, path = self.spark._jvm, f"{self.folder}/manifest"
        at = jvm.org.apache.hadoop.fs.Path(path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema("batch int, state string").json(f"{path}/*") if there else self.spark.createDataFrame([], "batch int, state string")

    def _read(self, what: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows that hold now, of some buckets or of all: only their folders are read."""
        held = {int(b): v for b, v in self.state[what].items() if buckets is None or int(b) in buckets}
        paths = [f"{self.folder}/{what}/v{v}/bucket={b}" for b, v in sorted(held.items())]
        if not paths:
            return self.spark.createDataFrame([], schema)
        own = [c for c in schema.split(", ") if not c.startswith("bucket ")]
        rows = self.spark.read.schema(", ".join(own)).parquet(*paths)
        return rows.withColumn("bucket", _bucket(F.col("file" if what == "trace" else "rule"), self.state["buckets"]))

    def trace(self) -> DataFrame:
        return self._read("trace", _TRACE).drop("bucket")

    def rules(self) -> DataFrame:
        """(rule, files, digest) of the rules that some file has."""
        return self._read("rules", _RULES).drop("bucket")

    def changed(self, batch: int | None = None) -> DataFrame:
        """(file, rule, verdict, rules, batch) of a batch, or of all: what became of each row that it named, and how many rules the file had after it. rule is null for files whose rows all stayed away."""
        done = range(self.state["batch"] + 1) if batch is None else [batch]
        paths = [f"{self.folder}/changed/v{b}" for b in done]
        return self.spark.read.schema(_CHANGED).parquet(*paths) if paths else self.spark.createDataFrame([], _CHANGED)

    def _write(self, what: str, rows: DataFrame, batch: int, touched: list[int]) -> None:
        """A new version of the touched buckets; those of which nothing is left are in no manifest."""
        path = f"{self.folder}/{what}/v{batch}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        # Told by the folders written, so that the rows are computed once.
        left = {r["bucket"] for r in self.spark.read.schema("bucket int").parquet(path).distinct().collect()}
        for b in touched:
            self.state[what].pop(str(b), None)
            if b in left:
                self.state[what][str(b)] = batch

    def apply(self, changes: DataFrame, batch: int) -> DataFrame:
        """changed() of this batch, once the changes (file, rule, value; null: removed; seq: the last of a file and rule holds) are part of the trace.

        A batch that was applied before changes nothing; batches follow one another by number.
        """
        if batch <= self.state["batch"]:
            return self.changed(batch)
        if batch != self.state["batch"] + 1:
            raise ValueError(f"batch {batch} after {self.state['batch']}")
        n, before = self.state["buckets"], json.dumps(self.state)
        try:
            latest = changes.groupBy("file", "rule").agg(F.max_by("value", "seq").alias("new"))
            files = [r["bucket"] for r in changes.select(_bucket(F.col("file"), n).alias("bucket")).distinct().collect()]
            old = self._read("trace", _TRACE, files).drop("bucket")
            # By file and rule alone, as the changes are grouped: they are shuffled once.
            both = old.withColumn("_held", F.lit(True)).join(latest.withColumn("_named", F.lit(True)), ["file", "rule"], "full_outer").withColumn("bucket", _bucket(F.col("file"), n))
            value = F.when(F.col("_named"), F.col("new")).otherwise(F.col("value"))
            verdict = (
                F.when(F.col("_held").isNull(), F.when(F.col("new").isNull(), "absent").otherwise("added"))
                .when(F.col("new").isNull(), "removed")
                .when(F.col("new") == F.col("value"), "unchanged")
                .otherwise("modified")
            )
            # Written first: what follows reads it, not the join.
            path = f"{self.folder}/joined/v{batch}"
            both.select("file", "rule", "bucket", "value", value.alias("now"), F.when(F.col("_named"), verdict).alias("verdict")).write.mode("overwrite").parquet(path)
            both = self.spark.read.parquet(path)
            self._write("trace", both.where("now is not null").select("file", "rule", F.col("now").alias("value"), "bucket"), batch, files)
            counts = both.groupBy("file").agg(F.count("now").alias("rules"), F.count("verdict").alias("_named")).where("_named > 0").drop("_named")
            named = both.where("verdict is not null").join(counts, "file").select("file", "rule", "verdict", "rules", F.lit(batch).alias("batch"))
            named.write.mode("overwrite").parquet(f"{self.folder}/changed/v{batch}")
            self._follow(both.where("verdict in ('added', 'removed', 'modified')"), batch, n)
            self.state["batch"] = batch
            self.spark.createDataFrame([(batch, json.dumps(self.state))], "batch int, state string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/v{batch}")
        except BaseException:
            self.state = json.loads(before)
            raise
        return self.changed(batch)

    def _follow(self, moved: DataFrame, batch: int, n: int) -> None:
        """Adds to the rules that rows moved of."""
        file = F.col("file")
        more = F.coalesce(F.when(F.col("now").isNotNull(), _said(file, F.col("now"))), F.lit(0)) - F.coalesce(F.when(F.col("value").isNotNull(), _said(file, F.col("value"))), F.lit(0))
        files = F.col("now").isNotNull().cast("long") - F.col("value").isNotNull().cast("long")
        delta = moved.groupBy("rule").agg(F.sum(files).alias("_files"), F.sum(more.cast("decimal(38,0)")).cast("decimal(38,0)").alias("_digest"))
        touched = [r["bucket"] for r in moved.select(_bucket(F.col("rule"), n).alias("bucket")).distinct().collect()]
        both = self._read("rules", _RULES, touched).drop("bucket").join(delta, "rule", "full_outer").withColumn("bucket", _bucket(F.col("rule"), n))
        zero = lambda c: F.coalesce(c, F.lit(0))
        new = both.select("rule", (zero("files") + zero("_files")).cast("long").alias("files"), (zero("digest") + zero("_digest")).cast("decimal(38,0)").alias("digest"), "bucket").where("files > 0")
        self._write("rules", new, batch, touched)


def digests(trace: DataFrame) -> DataFrame:
    """(rule, files, digest) of a whole trace: what Trace.rules() is kept equal to."""
    return trace.groupBy("rule").agg(F.count("*").alias("files"), F.sum(_said(F.col("file"), F.col("value"))).cast("decimal(38,0)").alias("digest"))
