"""Problem 6: records that differ in white space, case, punctuation or field order only.

The canonical key of a record is an md5 over its two texts, lower-cased and reduced to letters and digits, in sorted
order.  A persistent ledger keeps one row per key (copies, earliest record) in hash buckets; a batch is aggregated to one row per
key first (map-side combine, so a key with a third of all rows sends one row per task), then full-outer-joined with the
matching buckets.

Defined results: a record of which a text is null or has no letter or digit has no key and is no copy of anything;
repeated rows are copies; the representative is the smallest id, so ties cannot occur; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.common import materialise, scratch, table
from spanforge.llm.ledger import Ledger, loads

HOT_SHARE = 1e-4  # keys with at least this share of all rows: at most 1 / HOT_SHARE, so they may be broadcast


def canonical(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", "")


def keyed(rows: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """(id, key) of the records that have a key."""
    two = rows.select(F.col(id_col).alias("id"), canonical(F.col(a)).alias("x"), canonical(F.col(b)).alias("y")).where("x <> '' and y <> ''")
    return two.select("id", F.unhex(F.md5(F.concat(F.least("x", "y"), F.lit("\x01"), F.greatest("x", "y")))).alias("key"))


class CopyLedger:
    """Persistent (key, copies, first) counts in the folder `path`, opened again if it exists; a batch given twice counts once."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.state = Ledger(spark, path, {"copies": ("key binary", {"copies": "sum", "first": "min"})}, buckets)

    def add(self, name: str, batch: DataFrame) -> CopyLedger:
        if not self.state.applied(name):
            self.state.merge("copies", batch.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("first")))
            self.state.commit(name)
        return self

    def read(self) -> DataFrame:
        return self.state.read("copies").select("key", "copies", "first")


def other_copies(rows: DataFrame, ledger: CopyLedger) -> DataFrame:
    """(first_line, line_no) of each copy but the representative: hot keys by a broadcast of proven size, the rest by a shuffled join."""
    rep = ledger.read().where("copies > 1").select("key", "copies", "first")
    total = ledger.read().agg(F.sum("copies")).first()[0] or 0
    hot = rep.where(F.col("copies") >= max(2.0, HOT_SHARE * total)) if HOT_SHARE * total > 50 else rep.where("false")
    cold = rep.where(F.col("copies") < max(2.0, HOT_SHARE * total)) if HOT_SHARE * total > 50 else rep
    out = rows.join(F.broadcast(hot), "key").select("first", "id").unionByName(rows.join(cold.hint("merge"), "key").select("first", "id"))
    return out.where("id <> first").select(F.col("first").alias("first_line"), F.col("id").alias("line_no"))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, CopyLedger]:
    """The keyed rows and the ledger after the batches in the order of load."""
    lines = table(spark, sf_dir, "paired_sp_train").select("line_no", "src", "trg", "loaded_at")
    led, parts = CopyLedger(spark, scratch(spark, "ledger")), []
    for i, batch in enumerate(loads(lines, "loaded_at")):
        parts.append(materialise(keyed(batch, "line_no", "src", "trg"), "keys"))
        led.add(f"load {i}", parts[-1])
    return reduce(DataFrame.unionByName, parts), led


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return other_copies(*_both(spark, sf_dir))


def p6_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct record with its number of copies."""
    return _both(spark, sf_dir)[1].read().select(F.col("first").alias("line_no"), "copies")
