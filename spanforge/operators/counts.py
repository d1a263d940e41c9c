"""The sparse span x token count table and its algebra.  A table is a frame (span, token, c); marginals are derived frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.common import materialise
from spanforge.functions import text as T


def word_token_counts(pairs: DataFrame) -> DataFrame:
    """c(word, token): a word counts with multiplicity, a token once a line; `n` weights a line."""
    weight = F.col("n") if "n" in pairs.columns else F.lit(1)
    per_line = pairs.select(weight.alias("n"), F.array_distinct("src").alias("src"), T.marked_words(F.col("trg")).alias("w"))
    return per_line.select("n", "src", F.explode("w").alias("word")).select("n", "word", F.explode("src").alias("token")).groupBy("word", "token").agg(F.sum("n").alias("c"))


def cooccurrence(pairs: DataFrame, maxlen: int | None = None, keep: DataFrame | None = None) -> DataFrame:
    """c(span, token).  Words and tokens are aggregated before spans are enumerated, spans on distinct words only; `keep` is a span list applied before the join with tokens."""
    wt = word_token_counts(pairs)
    ws = wt.select("word").distinct().select("word", F.explode(T.spans(F.col("word"), maxlen)).alias("s")).select("word", F.col("s.span").alias("span"))
    if keep is not None:
        ws = ws.join(keep.select("span"), "span", "left_semi")
    ws = ws.groupBy("word", "span").agg(F.count("*").alias("m"))
    return wt.join(ws, "word").groupBy("span", "token").agg(F.sum(F.col("c") * F.col("m")).alias("c"))


def by_span(counts: DataFrame) -> DataFrame:
    return counts.groupBy("span").agg(F.sum("c").alias("cs"))


def by_token(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.sum("c").alias("ct"))


def norm(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("c").alias("norm"))


def marginals(counts: DataFrame) -> DataFrame:
    """All three marginals in one pass: axis, key, total."""
    g = counts.groupingSets([["span"], ["token"], []], "span", "token").agg(F.sum("c").alias("total"), F.grouping_id().alias("g"))
    axis = F.when(F.col("g") == 1, "span").when(F.col("g") == 2, "token").otherwise("all")
    return g.select(axis.alias("axis"), F.coalesce("span", "token", F.lit("")).alias("key"), "total")


def extremes(counts: DataFrame, axis: str) -> DataFrame:
    return counts.groupBy(F.col(axis).alias("key")).agg(F.min("c").alias("least"), F.max("c").alias("most"))


def add(*tables: DataFrame) -> DataFrame:
    """Sum of count tables."""
    return reduce(DataFrame.unionByName, [t.select("span", "token", "c") for t in tables]).groupBy("span", "token").agg(F.sum("c").alias("c"))


def increase_all(counts: DataFrame, rows: DataFrame, value: float = 1) -> DataFrame:
    """The table with `value` added to every (span, token) of rows (span, tokens), as often as a token stands in a row."""
    more = rows.select("span", F.explode("tokens").alias("token"), F.lit(value).alias("c"))
    return add(counts, more)


def replace(counts: DataFrame, other: DataFrame) -> DataFrame:
    """The cells of another table for the spans of this one (which stay the index)."""
    return other.join(counts.select("span").distinct(), "span", "left_semi").select("span", "token", "c")


def scale(counts: DataFrame, f) -> DataFrame:
    """Scalar arithmetic on every cell, e.g. scale(t, lambda c: c / 2)."""
    return counts.withColumn("c", f(F.col("c")))


def sizes(counts: DataFrame) -> DataFrame:
    n = counts.agg(F.count("*").alias("nnz"), F.count_distinct("span").alias("n_spans"), F.count_distinct("token").alias("n_tokens"))
    return n.withColumn("sparsity", 1 - F.col("nnz") / (F.col("n_spans") * F.col("n_tokens")))


def delete_spans(counts: DataFrame, spans: DataFrame) -> DataFrame:
    return counts.join(spans.select("span"), "span", "left_anti")


def upsert(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells set to given values, the rest kept."""
    return counts.join(cells.select("span", "token"), ["span", "token"], "left_anti").unionByName(cells.select("span", "token", "c"))


def same_index(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same spans (the check before adding linked tables)."""
    x, y = a.select("span").distinct(), b.select("span").distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def ranked(df: DataFrame, order: list[str], name: str, base: int = 0) -> DataFrame:
    """Dense ranks in the given order without a single-task window or sort: ranks within range partitions plus the offsets of the partitions.  The order must be total."""
    k = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_r"))
    k = materialise(k, "ranked")
    n = k.groupBy("_p").agg(F.count("*").alias("n"))
    off = n.alias("a").join(n.alias("b"), F.col("b._p") < F.col("a._p"), "left").groupBy(F.col("a._p").alias("_p")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("_o"))
    return k.join(F.broadcast(off), "_p").withColumn(name, (F.col("_o") + F.col("_r") + base).cast("long")).drop("_p", "_r", "_o")  # offsets: one row per partition


def index(keys: DataFrame, key: str, id_col: str, base: int = 0) -> DataFrame:
    """Dense ids of distinct keys in key order."""
    return ranked(keys.select(key).distinct(), [key], id_col, base)


def select_rows(units: DataFrame, counts: DataFrame) -> DataFrame:
    """(unit, span, pos, token, c): the sparse row of a span restricted to a unit's tokens, 0 where there is no cell."""
    each = units.select("unit", "span", F.posexplode("src").alias("pos", "token"))
    return each.join(counts, ["span", "token"], "left").withColumn("c", F.coalesce("c", F.lit(0)))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def band_count(pairs: DataFrame) -> DataFrame:
    """c(span, token) of the places inside the band of each line: lists `spans` and `tokens` by place, a line's distinct pairs count once."""
    from spanforge.functions.math import in_band

    left = pairs.select("line_no", F.size("spans").alias("x1"), F.size("tokens").alias("x2"), "tokens", F.posexplode("spans").alias("i", "span"))
    each = left.select("line_no", "x1", "x2", "i", "span", F.posexplode("tokens").alias("j", "token"))
    return each.where(in_band(F.col("i"), F.col("j"), F.col("x1"), F.col("x2"))).select("line_no", "span", "token").distinct().groupBy("span", "token").agg(F.count("*").alias("c"))
