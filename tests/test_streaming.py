from datetime import datetime, timedelta

from tantu.streaming import merge
from tests.conftest import rows

DAY = datetime(2024, 1, 1)
ENTRY = "slp_key string, ord_no int, l string, p string, f string, built_at timestamp"
GROUP = "group_id long, lemma string, seen_at timestamp"


def test_batches_merge_once_and_in_order(spark, tmp_path):
    source, target = str(tmp_path / "in"), merge.MorphTable(spark, str(tmp_path / "table"))
    deliveries = [[("a", 0, "x", "noun", "", DAY), ("a", 1, "y", "noun", "", DAY)], [("a", 0, "x", "noun", "", DAY), ("a", 0, "z", "noun", "", DAY), ("b", 0, "q", "verb", None, DAY)]]
    for batch in deliveries:
        spark.createDataFrame(batch, ENTRY).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ENTRY).parquet(source)
        merge.merge_stream(stream, target, str(tmp_path / "check")).awaitTermination(60)
    assert rows(target.read().select("slp_key", "l")) == {("a", "x"), ("a", "y"), ("a", "z"), ("b", "q")}
    assert target.read().count() == 4
    before = target.versions()
    merge.merge_stream(spark.readStream.schema(ENTRY).parquet(source), target, str(tmp_path / "check")).awaitTermination(60)
    assert target.versions() == before


def test_counts_by_window(spark, tmp_path):
    source = str(tmp_path / "groups")
    data = [(1, "a", DAY), (1, "a", DAY), (2, "a", DAY + timedelta(days=1)), (3, None, DAY), (4, "", DAY), (5, "b", DAY + timedelta(days=2))]
    spark.createDataFrame(data, GROUP).coalesce(1).write.parquet(source)
    counts = merge.lemma_counts(spark.readStream.schema(GROUP).parquet(source))
    counts.writeStream.outputMode("complete").format("memory").queryName("lemma_counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    assert {(r.lemma, r.n) for r in spark.table("lemma_counts").collect()} == {("a", 2), ("b", 1)}
