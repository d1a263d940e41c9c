"""Tokenisation metrics, language-model metrics and the analysis of finished experiments."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["pair", "size", "vocab", "alignment", "model"]
VALUES = ["length", "renyi", "vocab_overlap", "single_char_macro", "single_char_micro", "vocab_usage", "fertility", "start_word"]


def token_metrics(tokens: DataFrame, words: Column, vocab_size: int | None = None) -> DataFrame:
    """One row for a tokenisation (tokens array, `words` per line): length, fertility, single-character shares, word-start share, Renyi efficiency and vocabulary use."""
    lines = tokens.select("tokens", words.alias("w"), F.size(F.filter("tokens", lambda x: F.length(F.regexp_replace(x, "^▁", "")) == 1)).alias("single"))
    a = lines.agg(
        F.sum(F.size("tokens")).alias("n"), F.count("*").alias("lines"), F.sum("w").alias("words"), F.sum("single").alias("single"),
        F.avg(F.when(F.size("tokens") > 0, F.col("single") / F.size("tokens"))).alias("single_char_macro"))
    freq = tokens.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("c"))
    b = freq.crossJoin(F.broadcast(a.select("n"))).agg(
        F.count("*").alias("used"), F.sum(F.pow(F.col("c") / F.col("n"), 3)).alias("p3"), F.sum(F.when(F.col("t").startswith("▁"), F.col("c")).otherwise(0)).alias("starts"))
    size = F.lit(vocab_size) if vocab_size else F.col("used")
    return a.crossJoin(b).select(
        (F.col("n") / F.col("lines")).alias("length"), (F.col("n") / F.col("words")).alias("fertility"), "single_char_macro", (F.col("single") / F.col("n")).alias("single_char_micro"),
        (F.col("starts") / F.col("n")).alias("start_word"), (F.ln("p3") / -2 / F.ln(size)).alias("renyi"), (F.col("used") / size).alias("vocab_usage"))


def vocab_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared tokens over all tokens of two vocabularies."""
    x, y = a.select("token").distinct(), b.select("token").distinct()
    both = x.withColumn("x", F.lit(1)).join(y.withColumn("y", F.lit(1)), "token", "full_outer")
    return both.agg((F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()) / F.count("*")).alias("overlap"))


def vocab_overlaps(vocab: DataFrame) -> DataFrame:
    """(export_id, other_id, overlap) of each vocabulary (export_id, token) and the next one by number."""
    t = vocab.select("export_id", "token").distinct()
    size = t.groupBy("export_id").agg(F.count("*").alias("n"))
    after = size.select("export_id", F.lead("export_id").over(Window.orderBy("export_id")).alias("other_id"), "n", F.lead("n").over(Window.orderBy("export_id")).alias("m")).where("other_id is not null")
    other = t.select(F.col("export_id").alias("other_id"), "token")
    shared = t.join(after, "export_id").join(other, ["other_id", "token"]).groupBy("export_id").agg(F.count("*").alias("k"))
    k = F.coalesce("k", F.lit(0))
    return after.join(shared, "export_id", "left").select("export_id", "other_id", (k / (F.col("n") + F.col("m") - k)).alias("overlap"))


def lm_metrics(samples: DataFrame) -> DataFrame:
    """Perplexities of the summed loss per sample, token, word, character and byte, and bits per byte and character."""
    s = samples.agg(F.sum("loss").alias("l"), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("tokens", "words", "chars", "bytes")])
    per = lambda c: F.exp(F.col("l") / F.col(c))
    return s.select(
        (F.col("l") / F.col("n")).alias("eval_loss"), per("n").alias("eval_ppl"), per("tokens").alias("eval_ppl_token"), per("words").alias("eval_ppl_words"), per("chars").alias("eval_ppl_chars"),
        per("bytes").alias("eval_ppl_bytes"), (F.col("l") / F.col("bytes") / F.ln(F.lit(2.0))).alias("eval_bpb"), (F.col("l") / F.col("chars") / F.ln(F.lit(2.0))).alias("eval_bpc"))


def cells(metrics: DataFrame) -> DataFrame:
    """Mean of each metric over seeds; rows without a model, repeated rows and rows of zeros left out."""
    clean = metrics.dropDuplicates().where(F.greatest(*[F.coalesce(F.col(v), F.lit(0.0)) for v in VALUES]) > 0)
    return clean.groupBy(*KEYS).agg(*[F.avg(v).alias(v) for v in VALUES])


def inverse(pair: str | Column) -> Column:
    """src-trg as trg-src."""
    p = F.split(pair, "-")
    return F.concat(p[1], F.lit("-"), p[0])


def parity(metrics: DataFrame, baseline: str = "unigram") -> DataFrame:
    """Length of each model over the baseline's length for the inverse pair."""
    c = cells(metrics)
    base = c.where(F.col("model") == baseline).select(inverse("pair").alias("pair"), "size", "vocab", "alignment", F.col("length").alias("base"))
    return c.join(base, ["pair", "size", "vocab", "alignment"]).select(*KEYS, (F.col("length") / F.col("base")).alias("parity"))


def ratio(metrics: DataFrame, value: str, baseline: str = "unigram") -> DataFrame:
    """A metric over the baseline's for the same pair."""
    c = cells(metrics)
    base = c.where(F.col("model") == baseline).select("pair", "size", "vocab", "alignment", F.col(value).alias("base"))
    return c.where(F.col("model") != baseline).join(base, ["pair", "size", "vocab", "alignment"]).select(*KEYS, F.when(F.col("base") != 0, F.col(value) / F.col("base")).alias("ratio"))


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """Every combination of the values of each axis (experiment keys, a few hundred rows)."""
    rows = list(itertools.product(*axes.values()))
    return spark.createDataFrame(rows, list(axes))


def on_grid(metrics: DataFrame, keys: DataFrame) -> DataFrame:
    """The mean metrics of every experiment of a grid, null where it is missing."""
    return keys.join(cells(metrics), keys.columns, "left")


def both_ratios(metrics: DataFrame, value: str, baseline: str = "unigram") -> DataFrame:
    """A metric over the baseline's for the same pair (ratio_src) and for the inverse pair (ratio_trg)."""
    c = cells(metrics)
    at = ["pair", "size", "vocab", "alignment"]
    base = c.where(F.col("model") == baseline).select(*at, F.col(value).alias("b"))
    own, other = base.withColumnRenamed("b", "src"), base.withColumn("pair", inverse("pair")).withColumnRenamed("b", "trg")
    safe = lambda b: F.when(F.col(b) != 0, F.col(value) / F.col(b))
    return c.where(F.col("model") != baseline).join(own, at, "left").join(other, at, "left").select(*KEYS, safe("src").alias("ratio_src"), safe("trg").alias("ratio_trg"))


def pivot(metrics: DataFrame, value: str, vocabs: list[int]) -> DataFrame:
    """pair x model x size by vocabulary size."""
    p = cells(metrics).groupBy("pair", "alignment", "model", "size").pivot("vocab", vocabs).agg(F.avg(value))
    return p.select("pair", "alignment", "model", "size", *[F.col(str(v)).alias(f"v{v}") for v in vocabs])


def trend(metrics: DataFrame, value: str) -> DataFrame:
    """A metric by vocabulary size at the largest corpus of each pair."""
    c = cells(metrics)
    top = c.groupBy("pair").agg(F.max("size").alias("size"))
    return c.join(top, ["pair", "size"]).select(*KEYS, value)


def linear_extrapolation(metrics: DataFrame, value: str, baseline: str = "unigram") -> DataFrame:
    """Least-squares line of a metric over log corpus size, and the size at which it reaches the best baseline value."""
    c = cells(metrics)
    top = c.where(F.col("model") == baseline).groupBy("pair", "vocab", "alignment").agg(F.max(value).alias("goal"))
    x, y = F.ln(F.col("size").cast("double")), F.col(value)
    fit = c.where((F.col("model") != baseline) & y.isNotNull()).groupBy("pair", "vocab", "alignment", "model").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return fit.join(top, ["pair", "vocab", "alignment"]).select("pair", "vocab", "alignment", "model", "slope", "intercept", "goal", F.when(F.col("slope") != 0, (F.col("goal") - F.col("intercept")) / F.col("slope")).alias("log_size"))


def exponential_fit(metrics: DataFrame, value: str) -> DataFrame:
    """(a, b, c) of a * exp(b x) + c through a metric over the rank of the corpus size, for series of three sizes or more (Gauss-Newton)."""
    import numpy as np
    import pandas as pd

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("size")[value].to_numpy(float)
        x = np.arange(len(y), dtype=float)
        best = (np.inf, 0.0, 0.0, float(y.mean()))
        for b in (-2.0, -1.0, -0.5, -0.1, 0.1, 0.5, 1.0):
            p = np.array([y[0] - y[-1], b, y[-1]])
            for _ in range(200):
                e = np.exp(np.clip(p[1] * x, -50, 50))
                r = y - (p[0] * e + p[2])
                j = np.stack([e, p[0] * x * e, np.ones_like(x)], 1)
                p = p + 0.5 * np.linalg.lstsq(j, r, rcond=None)[0]
            loss = float(((y - (p[0] * np.exp(np.clip(p[1] * x, -50, 50)) + p[2])) ** 2).sum())
            if loss < best[0]:
                best = (loss, *p)
        k = pdf.iloc[0]
        return pd.DataFrame([{"pair": k["pair"], "vocab": k["vocab"], "alignment": k["alignment"], "model": k["model"], "a": best[1], "b": best[2], "c": best[3]}])

    c = cells(metrics).where(F.col(value).isNotNull())
    long_enough = c.groupBy("pair", "vocab", "alignment", "model").agg(F.count("*").alias("k")).where("k >= 3").drop("k")
    return c.join(long_enough, ["pair", "vocab", "alignment", "model"]).groupBy("pair", "vocab", "alignment", "model").applyInPandas(fit, "pair string, vocab int, alignment string, model string, a double, b double, c double")
