"""Corpus operators: prepared parallel lines, words, spans, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.common import ship, table
from spanforge.functions import text as T


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parallel corpus with its line number."""
    return table(spark, sf_dir, "paired_sp_train").select("line_no", "pair", "split", "src", "trg")


def prepared(rows: DataFrame) -> DataFrame:
    """(line_no, src tokens, marked trg); a line without one of its sides is not a pair."""
    ship(rows.sparkSession)
    both = rows.where("src is not null and trg is not null")
    return both.select("line_no", T.split_tokens(T.prepare(F.col("src"))).alias("src"), T.mark_words(T.prepare(F.col("trg"))).alias("trg"))


def words(pairs: DataFrame) -> DataFrame:
    """(word, n) of every line with multiplicity; `n` weights a line where it is given."""
    weight = F.col("n") if "n" in pairs.columns else F.lit(1)
    return pairs.select(weight.alias("n"), F.explode(T.marked_words(F.col("trg"))).alias("word"))


def word_counts(pairs: DataFrame) -> DataFrame:
    return words(pairs).groupBy("word").agg(F.sum("n").alias("n"))


def span_counts(pairs: DataFrame, maxlen: int | None = None) -> DataFrame:
    """Frequency of every span; spans never cross words, so they are enumerated on distinct words only."""
    each = word_counts(pairs).select("n", F.explode(T.spans(F.col("word"), maxlen)).alias("s"))
    return each.groupBy(F.col("s.span").alias("span")).agg(F.sum("n").alias("freq"))


def threshold(freq: DataFrame, least: int) -> DataFrame:
    """Spans kept by a frequency threshold.  Single characters always stay; when more spans would go than stay, the kept list is built instead and a span exactly at the threshold goes too."""
    low = (F.length("span") >= 2) & (F.col("freq") < least)
    counts = freq.agg(F.count_if(low).alias("gone"), F.count_if(~low).alias("kept"))
    strict = F.broadcast(counts.select((F.col("gone") > F.col("kept")).alias("inverted")))
    return freq.crossJoin(strict).where(F.when(F.col("inverted"), (F.col("freq") > least) | (F.length("span") == 1)).otherwise(~low)).select("span", "freq")


def alphabet(freq: DataFrame) -> DataFrame:
    return freq.select(F.explode(F.split("span", "")).alias("char")).where("char <> ''").distinct()


def dropout(rows: DataFrame, p: float = 0.5, seed: int = 0) -> DataFrame:
    """Keep each row with probability 1 - p."""
    return rows.sample(False, 1 - p, seed)


def shuffle_take(rows: DataFrame, size: int, seed: int = 3) -> DataFrame:
    """A shuffled sample of `size` rows (the sampling operator; its limit is its meaning)."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "line_no"), "line_no").limit(size)


def buckets(rows: DataFrame, n: int) -> DataFrame:
    """Contiguous split into n buckets of ceil(N / n) rows; line numbers must be dense from 1."""
    size = F.broadcast(rows.agg(F.ceil(F.count("*") / n).alias("size")))
    return rows.crossJoin(size).withColumn("bucket", F.floor((F.col("line_no") - 1) / F.col("size")).cast("int")).drop("size")


def aligned_words(rows: DataFrame, align: DataFrame) -> DataFrame:
    """Word pairs by alignment link; (line_no, si, ti, src_word, trg_word)."""
    blank = "[ \\t\\r\\n]+"
    cut = lambda c: F.filter(F.split(c, blank), lambda x: x != "")
    both = rows.select("line_no", cut(F.col("src")).alias("s"), cut(F.col("trg")).alias("t")).join(align, "line_no")
    each = both.select("line_no", "s", "t", F.explode("links").alias("l")).select("line_no", "l.si", "l.ti", F.get("s", F.col("l.si")).alias("src_word"), F.get("t", F.col("l.ti")).alias("trg_word"))
    return each.where("src_word is not null and trg_word is not null")


def aligned_pairs(rows: DataFrame, align: DataFrame) -> DataFrame:
    """Each word pair as a line of its own, prepared: (src tokens, trg), weighted by how often it occurs."""
    ship(rows.sparkSession)
    each = aligned_words(rows, align).groupBy("src_word", "trg_word").agg(F.count("*").alias("n"))
    pair = each.select(T.split_tokens(T.prepare(F.col("src_word"))).alias("src"), T.mark_words(T.prepare(F.col("trg_word"))).alias("trg"), "n")
    return pair.groupBy("src", "trg").agg(F.sum("n").alias("n"))


def paired_words(pairs: DataFrame) -> DataFrame:
    """(src, word, n): distinct lattice inputs with their weight."""
    weight = F.col("n") if "n" in pairs.columns else F.lit(1)
    return pairs.select("src", F.explode(T.marked_words(F.col("trg"))).alias("word"), weight.alias("n")).groupBy("src", "word").agg(F.sum("n").alias("n"))


def words_with_sources(rows: DataFrame, align: DataFrame) -> DataFrame:
    """(line_no, pos, src, word): every marked word of each line with the source tokens its links name, or all tokens of the
    line where it has none.  Links name places of the texts cut at blanks, tabs and line ends; a place out of range is no link."""
    ship(rows.sparkSession)
    cut = lambda c: F.filter(F.split(c, "[ \\t\\r\\n]+"), lambda x: x != "")
    once = align.where("links is not null").groupBy("line_no").agg(F.flatten(F.collect_list("links")).alias("links"))  # repeated rows of a line
    both = rows.where("src is not null and trg is not null").join(once, "line_no", "left")
    each = both.select("line_no", cut(F.col("src")).alias("s"), T.split_tokens(T.prepare(F.col("src"))).alias("all"), "links", F.posexplode(cut(F.col("trg"))).alias("j", "word"))
    places = F.sort_array(F.array_distinct(F.transform(F.filter("links", lambda x: (x["ti"] == F.col("j")) & (x["si"] >= 0) & (x["si"] < F.size("s"))), lambda x: x["si"])))
    own = each.withColumn("own", F.array_join(F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.get("s", i)), " "))
    src = own.select("line_no", "j", "all", T.split_tokens(T.prepare(F.when(F.col("own") != "", F.col("own")))).alias("own"), T.mark_words(T.prepare(F.col("word"))).alias("trg"))
    src = src.select("line_no", "j", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("all")).alias("src"), F.posexplode(T.marked_words(F.col("trg"))).alias("k", "word"))
    return src.select("line_no", F.struct("j", "k").alias("pos"), "src", "word")
