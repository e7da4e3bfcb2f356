"""Small stores of a reader: known words and bookmarks, from logs of marks; imports, exports, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tantu.operators.ordered import first_by

RECENT = 4
STARS = 100


def latest(log: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """The last entry of each key (ties: the greater other columns)."""
    rest = [c for c in log.columns if c not in keys and c != ts]
    last = log.groupBy(*keys).agg(F.max(F.struct(ts, *rest)).alias("e"))
    return last.select(*keys, *[F.col(f"e.{c}").alias(c) for c in [ts, *rest]]).select(*log.columns)


def current(log: DataFrame, keys: list[str], action: str = "action", removed: tuple[str, ...] = ("remove",), ts: str = "ts") -> DataFrame:
    """What a log of marks and unmarks leaves: the last entry of each key, unless it removes it."""
    return latest(log, keys, ts).where(~F.col(action).isin(*removed))


def toggled(log: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that were toggled an odd number of times, with the last time."""
    counts = log.groupBy(*keys).agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    return counts.where("n % 2 = 1").select(*keys, "ts")


def newest(df: DataFrame, most: int = RECENT, ts: str = "ts", per: list[str] | None = None) -> DataFrame:
    """The newest entries, of each group if ``per`` is given; ties by the other columns."""
    order = [F.desc(ts), *[c for c in df.columns if c != ts]]
    if per is None:
        return df.orderBy(*order).limit(most)
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
    return df.withColumn("__r", rank).where(F.col("__r") <= most).drop("__r")


def imported(store: DataFrame, incoming: DataFrame, keys: list[str], overwrite: bool) -> DataFrame:
    """The union of a store and an import with ``added`` (the key is new); of shared keys one side's values stay."""
    values = [c for c in store.columns if c not in keys]
    a = store.select(*keys, F.struct(*values).alias("__a"))
    b = first_by(incoming, keys, values).select(*keys, F.struct(*values).alias("__b"))
    both = a.join(b, keys, "full")
    pick = F.coalesce("__b", "__a") if overwrite else F.coalesce("__a", "__b")
    return both.select(*keys, F.col("__a").isNull().alias("added"), pick.alias("__v")).select(*keys, *[F.col(f"__v.{c}").alias(c) for c in values], "added")


def with_titles(marks: DataFrame, works: DataFrame) -> DataFrame:
    """Marks with the title of their work, or its id where the catalog has none."""
    return marks.join(works.select("work_id", "title"), "work_id", "left").withColumn("title", F.coalesce("title", "work_id"))


def as_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON object a row; times keep their microseconds."""
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return df.select(F.to_json(F.struct(*columns), {"timestampNTZFormat": micros, "timestampFormat": micros + "XXX"}).alias("json"))


def read_store(texts: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """Stores from their JSON text; a corrupt one becomes an empty one (all fields null)."""
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    return texts.select(parsed.alias("s")).select("s.*")


def preferences(df: DataFrame) -> DataFrame:
    """Display preferences (deva, iast, legacy): legacy names are read, and one script at least is on."""
    deva = F.coalesce("deva", F.col("legacy").isin("deva", "both"), F.lit(True))
    iast = F.coalesce("iast", F.col("legacy").isin("iast", "both"), F.lit(True))
    return df.withColumns({"deva": deva | ~iast, "iast": iast})


def chip(total: Column, unknown: Column, off: Column) -> Column:
    """What the vocabulary chip says; nothing on an empty page."""
    return F.when(total == 0, "").when(off, F.concat(total.cast("string"), F.lit(" words"))).otherwise(F.concat(F.lit("unknown "), unknown.cast("string"), F.lit(" / "), total.cast("string")))
