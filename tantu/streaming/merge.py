"""Streams of corpus deliveries: morph entries merged batch by batch, counts of tokens by time with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tantu.operators.ordered import ordered_merge


class MorphTable:
    """A table of morph entries that grows by merges. Each merge writes a new version, so readers and restarts are safe."""

    KEYS, IDENTITY, ORDER = ["slp_key"], ["l", "p", "f"], ["ord_no", "built_at"]

    def __init__(self, spark: SparkSession, path: str, schema: str = "slp_key string, ord_no int, l string, p string, f string, built_at timestamp"):
        self.spark, self.path, self.schema = spark, path, schema

    def versions(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName().split("=")[1]) for p in names if p.getName().startswith("v=") and fs.exists(hadoop.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        found = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Merge a batch; a batch that is sent again after a restart is known by its id, and would add nothing anyway."""
        if batch_id in self.versions():
            return
        names = [c.split()[0] for c in self.schema.split(", ")]
        merged = ordered_merge(self.read(), batch.select(*names), self.KEYS, self.IDENTITY, self.ORDER)
        merged.select(*names).write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")


def merge_stream(entries: DataFrame, target: MorphTable, checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch of a stream of morph entries into the table, until what is there now is taken."""
    return entries.writeStream.foreachBatch(target.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lemma_counts(groups: DataFrame, late: str = "10 days", window: str = "30 days") -> DataFrame:
    """(start, lemma, n): lemmas of a stream of parse groups by time window; groups later than ``late`` are no more counted.

    A group that is sent twice within that time counts once.
    """
    once = groups.where("lemma is not null and lemma <> ''").withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["group_id"])
    counted = once.groupBy(F.window("seen_at", window).alias("w"), "lemma").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "lemma", "n")
