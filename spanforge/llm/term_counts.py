"""Problem 1: frequency of every distinct value or term, kept by incremental signed deltas.

A batch holds added records at +1 and deleted ones at -1; a changed record is its old version at -1 plus its new one at +1.
Only the batch is aggregated, map-side first; the per-term changes are merged into a persistent ledger (see ledger).  A text
row is a record of its own.  A record of many rows (an export with its entries) may come in several batches, so its terms are
kept with their rows in a second table of the ledger, and a record counts for a term when its first row of that term comes and
no more when its last one goes.

Defined results: null terms are never counted; the empty string is a term of `vocab` (stored values) and never of a text
(pieces are non-empty); a null text changes nothing and is no record; an export with null entries only is a record; repeated
rows count as often as they occur; ties need no order as marks depend on counts alone; an empty batch leaves the counts as they
are; a batch given twice counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.common import scratch, table
from spanforge.llm.ledger import Ledger, loads

BLANKS = "[ \\t\\r\\n]+"
TABLES = {
    "terms": ("field string, term string", {"occurrences": "sum", "records": "sum"}),
    "members": ("field string, record string, term string", {"n": "sum"}),  # rows of each term of a record; all rows of the record with a null term
}


def pieces(text: Column) -> Column:
    """Non-empty pieces of a text cut at runs of blank, tab, CR and LF and at nothing else."""
    return F.filter(F.split(text, BLANKS), lambda x: x != "")


def text_deltas(rows: DataFrame, text: str, field: str, sign: int = 1) -> DataFrame:
    """(field, term, occurrences, records): changes by text rows, each row one record; the null term has the records."""
    toks = rows.where(F.col(text).isNotNull()).select(F.sort_array(pieces(F.col(text))).alias("t"))
    first = F.transform("t", lambda x, i: F.struct(x.alias("term"), F.when((i == 0) | (F.get("t", i - 1) != x), F.lit(1)).otherwise(F.lit(0)).alias("r")))
    one = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("r")))
    each = toks.select(F.explode(F.concat(first, one)).alias("e")).select("e.*")
    return each.groupBy("term").agg((F.count("*") * sign).alias("occurrences"), (F.sum("r") * sign).alias("records")).select(F.lit(field).alias("field"), "term", "occurrences", "records")


def member_deltas(rows: DataFrame, record: str, term: str, field: str, sign: int = 1) -> DataFrame:
    """(field, record, term, n): changes by records of many rows; the null term has all rows of a record."""
    r, t = F.col(record).cast("string").alias("record"), F.col(term).alias("term")
    g = rows.select(r, t).groupBy("record", "term").agg((F.count("*") * sign).alias("n")).where("record is not null")
    both = g.where("term is not null").unionByName(g.groupBy("record").agg(F.lit(None).cast("string").alias("term"), F.sum("n").alias("n")))
    return both.select(F.lit(field).alias("field"), "record", "term", "n")


class TermLedger:
    """Persistent counts in the folder `path`, opened again if it exists."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.state = Ledger(spark, path, TABLES, buckets)

    @property
    def sums(self) -> dict[str, int]:
        """Number of records of each field."""
        return self.state.totals

    def apply(self, batch: str, texts: list[DataFrame] = (), members: list[DataFrame] = ()) -> TermLedger:
        """Merges the changes of a batch; a batch that was applied before is left out."""
        if self.state.applied(batch):
            return self
        changes = list(texts)
        if members:
            got = self._union(list(members))
            m = self.state.merge("members", got).where("n <> was_n")
            come = F.when((F.col("n") > 0) & (F.col("was_n") <= 0), 1).when((F.col("n") <= 0) & (F.col("was_n") > 0), -1).otherwise(0)
            changes.append(m.groupBy("field", "term").agg(F.sum(F.col("n") - F.col("was_n")).alias("occurrences"), F.sum(come).cast("long").alias("records")))
        got = self.state.merge("terms", self._union(changes))
        totals = {r["field"]: r["records"] - r["was_records"] for r in got.where("term is null").collect()}  # one row a field
        self.state.commit(batch, totals)
        return self

    @staticmethod
    def _union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def read(self) -> DataFrame:
        """(field, term, occurrences, records) of all terms there are."""
        return self.state.read("terms").where("term is not null and (occurrences <> 0 or records <> 0)").select("field", "term", "occurrences", "records")

    def marked(self, rare: dict[str, int], common: dict[str, float]) -> DataFrame:
        """Counts with mark 'rare' (at most rare[field] occurrences), 'common' (in more than common[field] of the records), else null."""
        mark = F.lit(None).cast("string")
        for f in rare:
            mark = F.when((F.col("field") == f) & (F.col("occurrences") <= rare[f]), "rare").when((F.col("field") == f) & (F.col("records") > common[f] * self.sums.get(f, 0)), "common").otherwise(mark)
        return self.read().withColumn("mark", mark)


RARE = {"vocab": 1, "trg": 2}
COMMON = {"vocab": 0.4, "trg": 0.02}


def corpus_ledger(spark: SparkSession, sf_dir: str) -> TermLedger:
    """Both fields of the project's data, merged in two batches in the order of export and load."""
    led = TermLedger(spark, scratch(spark, "terms"))
    vocab = loads(table(spark, sf_dir, "vocab").select("export_id", "vocab", "exported_at"), "exported_at")
    lines = loads(table(spark, sf_dir, "paired_sp_train").select("trg", "loaded_at"), "loaded_at")
    for i in range(max(len(vocab), len(lines))):
        led.apply(f"load {i}", [text_deltas(x, "trg", "trg") for x in lines[i : i + 1]], [member_deltas(x, "export_id", "vocab", "vocab") for x in vocab[i : i + 1]])
    return led


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_ledger(spark, sf_dir).marked(RARE, COMMON).where("mark is not null").select("field", "term", "mark")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_ledger(spark, sf_dir).marked(RARE, COMMON).select("field", "term", "occurrences", "records", "mark")


def p1_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts after a third batch that takes the devtest rows and the first export out and corrects the dev rows to lower case."""
    led = corpus_ledger(spark, sf_dir)
    rows = table(spark, sf_dir, "paired_sp_train").select("split", "trg")
    dev = rows.where("split = 'dev'")
    gone = table(spark, sf_dir, "vocab").where("export_id = 1")
    changes = [text_deltas(rows.where("split in ('dev', 'devtest')"), "trg", "trg", -1), text_deltas(dev.select(F.lower("trg").alias("trg")), "trg", "trg")]
    led.apply("held out", changes, [member_deltas(gone, "export_id", "vocab", "vocab", -1)])
    return led.marked(RARE, COMMON).select("field", "term", "occurrences", "records", "mark")
