"""Counts of every term, kept up to date by signed deltas of the records that were added, changed or deleted.

A store is a folder with two partitioned tables, each change of which is one more generation: ``records`` (what each
record last held, in buckets of neighbouring record numbers) and ``counts`` (signed changes of occurrences and record
counts by term, in buckets of the term's hash). An update reads the buckets of the records that it brings, nothing else, and
writes its own deltas; counts are the sums over generations, which ``compact`` merges. A generation counts once its mark is
written, last of all: a store that was left in the middle of an update reopens as it was before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tantu.session import shared_dir

RARE = 3  # in fewer records: rare
COMMON = 0.01  # in more than this share of the records: common
BUCKETS = 16  # of terms
SPAN = 1 << 20  # neighbouring record numbers in a bucket of records


def signed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(fld, term, total, records): changes that take the counts from records ``old`` to ``new`` (fld, rec, terms).

    The null term counts the records themselves. Changes that cancel out give no row. Terms are taken exactly as they are;
    null and empty terms are none.
    """
    return _summed(old.select("fld", F.lit(-1).alias("sign"), "terms").union(new.select("fld", F.lit(1), "terms")))


def _summed(sides: DataFrame) -> DataFrame:
    terms = F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    # a term comes once a record, with how often it occurs there; the null term is the record itself
    once = F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("term"), F.size(F.filter(terms, lambda x: x == t)).alias("n")))
    few = F.size(terms) == F.size(F.array_distinct(terms))
    plain = F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(1).alias("n")))
    parts = F.concat(F.when(few, plain).otherwise(once), F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("n"))))
    rows = sides.select("fld", "sign", F.explode(parts).alias("p")).select("fld", "p.term", (F.col("p.n") * F.col("sign")).alias("total"), F.col("sign").alias("records"))
    return rows.groupBy("fld", "term").agg(F.sum("total").alias("total"), F.sum("records").alias("records")).where("total <> 0 or records <> 0")


class TermStore:
    """Persistent term counts in a folder that all executors share; an existing folder is opened with all it holds."""

    RECORDS = "fld string, rec bigint, digest bigint, terms array<string>"
    COUNTS = "fld string, term string, total bigint, records bigint"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS, span: int = SPAN):
        self.spark, self.buckets, self.span = spark, buckets, span
        self.path = path or f"{shared_dir(spark)}/terms-{uuid.uuid4().hex}"
        self.generations = self._marked()

    def _folder(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marked(self) -> list[int]:
        """Generations whose mark is there, the oldest first."""
        at, fs = self._folder("done")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at)) if fs.exists(at) else []

    def _mark(self, gen: int) -> None:
        at, fs = self._folder(f"done/{gen}")
        fs.create(at, True).close()
        self.generations = [*self.generations, gen]

    def _bucket(self) -> Column:
        return F.floor(F.coalesce("rec", F.lit(0)) / F.lit(self.span)).cast("bigint").alias("at")

    def _held(self) -> DataFrame:
        """Every version of every record with its generation and bucket."""
        every = self.spark.read.schema(self.RECORDS + ", gen int, at bigint").parquet(f"{self.path}/records")
        return every.where(F.col("gen").isin(self.generations))

    @staticmethod
    def _last(versions: DataFrame) -> DataFrame:
        """Of every record its latest version, if it was not deleted."""
        last = versions.groupBy("fld", "rec").agg(F.max(F.struct("gen", "digest", "terms")).alias("v"))
        return last.select("fld", "rec", "v.digest", "v.terms").where("terms is not null")

    def records(self) -> DataFrame:
        """(fld, rec, digest, terms): what each record last held; deleted records are gone."""
        if not self.generations:
            return self.spark.createDataFrame([], self.RECORDS)
        return self._last(self._held())

    def counts(self) -> DataFrame:
        """(fld, term, total, records) of every term that some record holds, and of the null term: all records."""
        if not self.generations:
            return self.spark.createDataFrame([], self.COUNTS)
        every = self.spark.read.schema(self.COUNTS + ", gen int, bucket int").parquet(f"{self.path}/counts").where(F.col("gen").isin(self.generations))
        if len(self.generations) > 1:
            every = every.groupBy("fld", "term").agg(F.sum("total").alias("total"), F.sum("records").alias("records")).where("records > 0")
        return every.select("fld", "term", "total", "records")

    def touched(self, changes: DataFrame) -> list[int]:
        """The record buckets of the changes; as many as the numbers' range divided by ``span`` at most."""
        return sorted(r.at for r in changes.select(self._bucket()).distinct().collect())

    def apply(self, changes: DataFrame) -> None:
        """Bring in added, changed and deleted records: ``changes`` (fld, rec, terms), terms null for a deleted one.

        Records must come once each. Of what the store holds only the buckets of these records are read. Records whose
        digest is unchanged are left out before anything is counted, so a record that is sent again costs a place in one
        join and no delta. Deleting an unknown record changes nothing.
        """
        # an array<string> has no null digest: nulls hash as nothing, so the size goes in, too
        new = changes.select("fld", "rec", "terms", F.when(F.col("terms").isNotNull(), F.xxhash64("terms", F.size("terms"))).alias("digest"))
        gen = self.generations[-1] + 1 if self.generations else 0
        records, counts = f"{self.path}/records/gen={gen}", f"{self.path}/counts/gen={gen}"
        write = lambda df: df.select("fld", "rec", "digest", "terms", self._bucket()).write.mode("overwrite").partitionBy("at").parquet(records)
        read = lambda: self.spark.read.schema(self.RECORDS + ", at bigint").parquet(records)
        if self.generations:
            held = self._last(self._held().where(F.col("at").isin(self.touched(changes))))
            held = held.select("fld", "rec", F.col("digest").alias("old_digest"), F.col("terms").alias("old_terms"))
            both = new.join(held, (new["fld"].eqNullSafe(held["fld"])) & (new["rec"].eqNullSafe(held["rec"])), "left").where("not (digest <=> old_digest)")
            both = both.select(new["fld"], new["rec"], "digest", "terms", "old_terms")
            sides = both.select("fld", F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("old_terms").alias("terms")), F.struct(F.lit(1).alias("sign"), "terms"))).alias("s"))
            delta = _summed(sides.select("fld", "s.sign", "s.terms").where("terms is not null"))
            write(both)
        else:
            write(new.where("digest is not null"))
            delta = _summed(read().select("fld", F.lit(1).alias("sign"), "terms"))
        bucket = F.pmod(F.xxhash64("fld", "term"), F.lit(self.buckets)).cast("int").alias("bucket")
        delta.select("fld", "term", "total", "records", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(counts)
        self._mark(gen)

    def compact(self) -> None:
        """Merge all generations into one, in a new folder; the old one is left for readers that still use it."""
        whole = TermStore(self.spark, f"{self.path}-{uuid.uuid4().hex[:8]}", self.buckets, self.span)
        bucket = F.pmod(F.xxhash64("fld", "term"), F.lit(self.buckets)).cast("int").alias("bucket")
        self.counts().select("*", bucket).write.partitionBy("bucket").parquet(f"{whole.path}/counts/gen=0")
        self.records().select("*", self._bucket()).write.partitionBy("at").parquet(f"{whole.path}/records/gen=0")
        whole._mark(0)
        self.path, self.generations = whole.path, whole.generations

    def marks(self, rare: int = RARE, common: float = COMMON) -> DataFrame:
        """(fld, term, total, records, mark): mark rare, common or null; rare comes first where both hold."""
        counts = self.counts()
        size = counts.where("term is null").select("fld", F.col("records").alias("all"))  # a row for each field
        mark = F.when(F.col("records") < rare, "rare").when(F.col("records") > common * F.col("all"), "common")
        return counts.where("term is not null").join(size, "fld").select("fld", "term", "total", "records", mark.alias("mark"))


def corpus_records(tables) -> DataFrame:
    """(fld, rec, terms): units with their words and parse groups with their lemma, a record once.

    Several deliveries of one unit are one record: the terms of its latest one. A parse group without a lemma is none.
    """
    units = tables("work_units").select(F.col("unit_id").alias("rec"), F.coalesce("words", F.filter(F.split("w", " "), lambda x: x != ""), F.array().cast("array<string>")).alias("terms"), F.col("ingested_at").alias("at"))
    words = units.groupBy("rec").agg(F.max(F.struct(F.coalesce("at", F.timestamp_seconds(F.lit(0))), "terms"))["terms"].alias("terms"))
    groups = tables("parse_groups").where("lemma is not null and lemma <> ''").groupBy(F.col("group_id").alias("rec")).agg(F.array_sort(F.collect_set("lemma")).alias("terms"))
    return words.select(F.lit("words").alias("fld"), "rec", "terms").union(groups.select(F.lit("lemma"), "rec", "terms"))


def corpus_changes(tables, since: str) -> tuple[DataFrame, DataFrame]:
    """The corpus as two deliveries: the records as known before a day, and all that was added or sent again from then on.

    A record without a time belongs to the first. A unit of the second delivery stands as its latest row there says.
    """
    day = F.to_timestamp(F.lit(since))
    time = {"work_units": "ingested_at", "parse_groups": "seen_at"}
    late = lambda n: F.coalesce(F.col(time[n]) >= day, F.lit(False))
    before = lambda n: tables(n).where(~late(n)) if n in time else tables(n)
    after = lambda n: tables(n).where(late(n)) if n in time else tables(n)
    return corpus_records(before), corpus_records(after)


def updated_counts(tables, since: str = "2024-01-01") -> DataFrame:
    """(fld, term, total, records, mark) by two deliveries to one store: the records known before a day, then all changes."""
    first, changes = corpus_changes(tables, since)
    store = TermStore(first.sparkSession)
    store.apply(first)
    store.apply(changes)
    return store.marks()


def corpus_marks(tables) -> DataFrame:
    """(fld, term, total, records, mark) over all units and parse groups, through a store in the shared folder."""
    return updated_counts(tables)
