"""Pair scores of a span given source tokens, the family of plug-in models, and what is read off them: alignment, extraction, information, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.common import small
from spanforge.functions.math import digamma, log
from spanforge.operators import counts as C

PAIRED = ("max", "sum", "cond-exact", "pmi", "cpmi")
UNPAIRED = ("max-unpaired", "sum-unpaired")


def _with_norm(df: DataFrame, table: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(C.norm(table)))  # one row


def score(model: str, units: DataFrame, table: DataFrame, key: list[str] | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(*key, span, score) for distinct (key, span) of units whose span the table knows; minus infinity where no source token co-occurs.

    key names the source of a unit and sources gives its tokens (*key, src), once each; without them the tokens themselves are
    the key.  What hangs on the source alone (the sum of its tokens) is found once a source, and only cells that there are enter the sums."""
    key = key or ["src"]
    pairs = units.select(*key, "span").distinct()
    cs = small(table.groupBy("span").agg(F.sum("c").alias("cs"), F.max("c").alias("cm")))
    if model in UNPAIRED:
        x = F.col("cm" if model.startswith("max") else "cs")
        return _with_norm(pairs.join(cs, "span"), table).select(*key, "span", (digamma(x) - log(F.col("norm"))).alias("score"))
    if model not in PAIRED:
        raise ValueError(f"no model {model}")
    sources = units.select("src").distinct() if sources is None else sources
    tokens = F.array_distinct("src") if model == "cpmi" else F.col("src")
    each = sources.select(*key, F.explode(tokens).alias("token"))
    ct = small(C.by_token(table))
    of_source = each.join(ct, "token").groupBy(*key).agg(F.sum("ct").alias("sct"))
    cells = table.select("span", "token", "c").join(ct, "token").join(cs.select("span", "cs"), "span")
    hits = pairs.join(each, key).join(cells, ["span", "token"])
    hits = _with_norm(hits, table).withColumn("one", log(F.col("c")) - log(F.col("cs")) - log(F.col("ct")) + log(F.col("norm"))).withColumn("cond", log(F.col("c")) - log(F.col("ct")))
    g = hits.groupBy(*key, "span").agg(F.sum("c").alias("sc"), F.max("c").alias("mc"), F.max("one").alias("one"), F.max("cond").alias("cond"))
    g = pairs.join(cs.select("span"), "span", "left_semi").join(g, [*key, "span"], "left").join(of_source, key, "left")
    g = _with_norm(g, table).withColumn("sc", F.coalesce("sc", F.lit(0))).withColumn("mc", F.coalesce("mc", F.lit(0))).withColumn("sct", F.coalesce("sct", F.lit(0)))
    low = F.lit(float("-inf"))
    out = {
        "max": digamma(F.col("mc")) - log(F.col("norm")),
        "sum": digamma(F.col("sc")) - log(F.col("norm")),
        "cond-exact": F.when(F.col("sc") > 0, log(F.col("sc")) - log(F.col("sct"))).otherwise(low),
        "pmi": F.coalesce("one", low),
        "cpmi": F.when(F.col("sc") > 0, F.col("cond") - log(F.col("sc")) + log(F.col("sct"))).otherwise(low),
    }[model]
    return g.select(*key, "span", out.alias("score"))


def cell_score(model: str, table: DataFrame) -> DataFrame:
    """(span, token, score) of every cell: the score of a pair of one span and one token."""
    t = table.where("c > 0").select("span", "token", "c").join(small(C.by_token(table)), "token").join(small(C.by_span(table)), "span")
    t = _with_norm(t, table)
    pmi: Column = log(F.col("c")) - log(F.col("cs")) - log(F.col("ct")) + log(F.col("norm"))
    s = {"max": F.col("c").cast("double"), "sum": F.col("c").cast("double"), "cond-exact": C.ratio(F.col("c"), F.col("ct")), "pmi": pmi, "cpmi": pmi}[model]
    return t.select("span", "token", s.alias("score"))


def extract(model: str, table: DataFrame, k: int = 1) -> DataFrame:
    """The k best tokens of each span (k <= 0: all), ties by token."""
    s = cell_score(model, table)
    if k <= 0:
        return s
    w = Window.partitionBy("span").orderBy(F.desc(F.round("score", 9)), "token")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def align(model: str, units: DataFrame, table: DataFrame) -> DataFrame:
    """(src, span, pos, token, score): the source token each span is aligned to, the first of equals; `sum` gives every token with a count."""
    each = units.select("src", "span").distinct().select("src", "span", F.posexplode("src").alias("pos", "token"))
    if model == "cpmi":  # normalised by the source sentence, which does not change the order
        norm = units.select("src").distinct().select("src", F.explode(F.array_distinct("src")).alias("token")).join(C.by_token(table), "token").groupBy("src").agg(F.sum("ct").alias("sct"))
        row = each.select("src", "span", "token").distinct().join(table, ["span", "token"]).groupBy("src", "span").agg(F.sum("c").alias("sc"))
        s = each.join(table, ["span", "token"]).join(C.by_token(table), "token").join(norm, "src").join(row, ["src", "span"])
        s = s.select("src", "span", "pos", "token", (log(F.col("c")) - log(F.col("sc")) - log(F.col("ct")) + log(F.col("sct"))).alias("score"))
    else:
        s = each.join(cell_score(model, table), ["span", "token"]).select("src", "span", "pos", "token", "score")
    if model == "sum":
        return s
    w = Window.partitionBy("src", "span").orderBy(F.desc(F.round("score", 9)), "pos")  # equal but for the order of sums is equal
    return s.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def information(table: DataFrame) -> DataFrame:
    """(span, info): mutual information each span of two or more characters carries."""
    t = table.where("length(span) > 1 and c > 0").join(small(C.by_token(table)), "token").join(small(C.by_span(table)), "span")
    t = _with_norm(t, table).where("ct > 0")
    one = F.col("c") * (log(F.col("c")) - log(F.col("ct")) - log(F.col("cs")) + log(F.col("norm"))) / F.col("norm")
    return t.groupBy("span").agg(F.sum(one).alias("info"))


def least_informative(table: DataFrame, vocab_size: int, reduce: float) -> DataFrame:
    """Spans to prune: the least informative, at most a share `reduce` of all spans and down to vocab_size; ties by span.

    The cut may take most of the spans, so it is a distributed rank and not a sort into one task."""
    n = table.select("span").distinct().count()
    k = min(int(reduce * n), n - vocab_size)
    info = information(table).select(F.round("info", 12).alias("info"), "span")
    return C.ranked(info, ["info", "span"], "rank").where(F.col("rank") < k).select("span", "info")


def prune(table: DataFrame, vocab_size: int, reduce: float = 0.75) -> DataFrame:
    return C.delete_spans(table, least_informative(table, vocab_size, reduce))


def rare_characters(table: DataFrame, coverage: float) -> DataFrame:
    """(char, c): the rarest characters whose running mass stays within 1 - coverage; ties by character.  At most one row per code point."""
    chars = table.where("length(span) = 1").groupBy(F.col("span").alias("char")).agg(F.sum("c").alias("c"))
    run = F.sum("c").over(Window.orderBy("c", "char").rowsBetween(Window.unboundedPreceding, 0))
    total = F.broadcast(chars.agg(F.sum("c").alias("total")))
    return chars.withColumn("run", run).crossJoin(total).where(F.col("run") <= (1 - coverage) * F.col("total")).select("char", "c")


def prune_characters(table: DataFrame, coverage: float) -> DataFrame:
    """The table without spans that hold a removed character."""
    gone = F.broadcast(rare_characters(table, coverage).agg(F.collect_list("char").alias("gone")))  # one row, at most one entry per code point
    return table.crossJoin(gone).where(~F.arrays_overlap(F.split("span", ""), F.col("gone"))).drop("gone")
