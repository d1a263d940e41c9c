"""Persistent bucketed state that batches are merged into: the store of problems 1 and 6.

A ledger is a folder.  Each of its tables is cut into buckets by a hash of the key; a batch is aggregated first, full-outer-
joined with the matching buckets and only those are written anew, one task a bucket.  What is valid stands in a manifest, to
which one row is added when a batch is complete: the place of every bucket, running totals and the batch's name.  So a ledger can
be opened again at any time, a batch that failed half-way leaves no trace, and a batch that is applied twice counts once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, batch string, state string"


class Ledger:
    """tables: name -> (schema of the keys, {value: 'sum' or 'min'}); every value is a long."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, dict[str, str]]], buckets: int | None = None):
        self.spark, self.path, self.tables = spark, path, tables
        at = self._manifest().orderBy(F.desc("version")).limit(1).collect()
        self.version = at[0]["version"] if at else 0
        state = json.loads(at[0]["state"]) if at else {"buckets": buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))), "live": {}, "totals": {}}
        self.buckets: int = state["buckets"]  # fixed when the ledger is made, by the parallelism of the job
        self.live: dict[str, dict[int, str]] = {t: {int(b): p for b, p in of.items()} for t, of in state["live"].items()}
        self.totals: dict[str, int] = state["totals"]
        self._staged: dict[str, dict[int, str]] = {}

    def _manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
        except AnalysisException:  # a new ledger
            return self.spark.createDataFrame([], MANIFEST)

    def applied(self, batch: str) -> bool:
        return not self._manifest().where(F.col("batch") == batch).isEmpty()

    def _keys(self, table: str) -> list[str]:
        return [c.split()[0] for c in self.tables[table][0].split(", ")]

    def read(self, table: str, only: list[int] | None = None, live: dict[int, str] | None = None) -> DataFrame:
        """All rows of a table, or those of some buckets, with the values before and after the last batch that touched them (was_*)."""
        keys, values = self.tables[table]
        schema = ", ".join(["bucket int", keys, *(f"{v} long, was_{v} long" for v in values)])
        places: dict[str, list[int]] = {}
        for b, p in (self.live.get(table, {}) if live is None else live).items():
            if only is None or b in only:
                places.setdefault(p, []).append(b)
        out = self.spark.createDataFrame([], schema)
        for p, bs in sorted(places.items()):
            df = self.spark.read.schema(schema).parquet(p)
            out = out.unionByName(df if len(bs) == self.buckets else df.where(F.col("bucket").isin(bs)))
        return out

    def merge(self, table: str, change: DataFrame) -> DataFrame:
        """Stages the sum of a table and a change (keys and values, several rows of a key are added up); gives the rows touched."""
        keys, rules = self._keys(table), self.tables[table][1]
        how = {"sum": F.sum, "min": F.min}
        change = change.groupBy(*keys).agg(*[how[r](v).alias(f"d_{v}") for v, r in rules.items()])
        place = f"{self.path}/{table}-{uuid.uuid4().hex[:12]}"
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        change.withColumn("bucket", bucket).write.parquet(f"{place}/change")
        change = self.spark.read.parquet(f"{place}/change")
        touched = [r[0] for r in change.select("bucket").distinct().collect()]  # at most `buckets` numbers
        old, new = self.read(table, touched).alias("o"), change.alias("n")
        same = F.col("o.bucket") == F.col("n.bucket")
        for k in keys:
            same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        both = old.join(new, same, "full_outer")
        zero = F.lit(0).cast("long")
        value = {
            "sum": lambda v: F.coalesce(f"o.{v}", zero) + F.coalesce(f"n.d_{v}", zero),
            "min": lambda v: F.least(f"o.{v}", f"n.d_{v}"),
        }
        was = lambda v, r: F.coalesce(f"o.{v}", zero) if r == "sum" else F.col(f"o.{v}")
        cols = [c for v, r in rules.items() for c in (value[r](v).alias(v), was(v, r).alias(f"was_{v}"))]
        merged = both.select(F.coalesce("o.bucket", "n.bucket").alias("bucket"), *[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], *cols)
        merged = merged.repartitionById(self.buckets, F.col("bucket"))
        merged.write.partitionBy("bucket").parquet(f"{place}/rows")
        self._staged[table] = {b: f"{place}/rows" for b in touched}
        return self.read(table, touched, self._staged[table])

    def commit(self, batch: str, totals: dict[str, int] | None = None) -> None:
        """Makes what was staged valid, with changes of the running totals."""
        for t, of in self._staged.items():
            self.live.setdefault(t, {}).update(of)
        self._staged = {}
        for k, n in (totals or {}).items():
            self.totals[k] = self.totals.get(k, 0) + n
        self.version += 1
        state = json.dumps({"buckets": self.buckets, "live": self.live, "totals": self.totals}, sort_keys=True)
        self.spark.createDataFrame([(self.version, batch, state)], MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")


def loads(rows: DataFrame, column: str, parts: int = 2) -> list[DataFrame]:
    """The rows in the order they were loaded, cut into spans of equal time; rows without a time go with the first."""
    t = F.col(column).cast("timestamp").cast("double")
    lo, hi = rows.agg(F.min(t), F.max(t)).first()
    if lo is None or hi <= lo:
        return [rows]
    part = F.least(F.floor((t - lo) / ((hi - lo) / parts)), F.lit(parts - 1))
    return [rows.where(F.coalesce(part, F.lit(0)) == i) for i in range(parts)]
