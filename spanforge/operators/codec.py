"""Vocabulary layout, ids of token sequences and back.

Ids: unk 0, bos 1, eos 2, pad 3, byte k at 4 + k, span k (in span order) at 260 + k.  A negative special id is not set and
moves the rest down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import counts as C

SPECIALS = (("<unk>", 0), ("<s>", 1), ("</s>", 2), ("<pad>", 3))
BYTE = "▁▁{%d}"


def export_vocab(spark: SparkSession, spans: DataFrame, specials: tuple[tuple[str, int], ...] = SPECIALS) -> DataFrame:
    """(token, id): specials, 256 bytes, spans."""
    base = max([-1, *(i for _, i in specials)]) + 1
    rows = [(t, i) for t, i in specials if i >= 0] + [(BYTE % b, base + b) for b in range(256)]
    head = spark.createDataFrame(rows, "token string, id long")
    return head.unionByName(C.index(spans, "span", "id", base + 256).select(F.col("span").alias("token"), "id"))


def encode(tokens: DataFrame, vocab: DataFrame, bos: int | None = None, eos: int | None = None, pad: int | None = None, length: int | None = None, base: int = 4) -> DataFrame:
    """(line_no, ids): a token without an id is written as its bytes."""
    each = tokens.select("line_no", F.posexplode("tokens").alias("pos", "token")).join(vocab.where(F.col("id") >= base + 256), "token", "left")
    raw = F.transform(F.filter(F.split(F.regexp_replace(F.hex(F.encode("token", "UTF-8")), "(..)", "$1 "), " "), lambda x: x != ""), lambda x: (F.conv(x, 16, 10).cast("long") + base))
    each = each.select("line_no", "pos", F.when(F.col("id").isNotNull(), F.array("id")).otherwise(raw).alias("ids"))
    got = each.groupBy("line_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))
    ids: Column = F.coalesce("ids", F.array().cast("array<long>"))
    ids = F.concat(F.array(F.lit(bos).cast("long")), ids) if bos is not None else ids
    ids = F.concat(ids, F.array(F.lit(eos).cast("long"))) if eos is not None else ids
    if pad is not None and length:
        ids = F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))
    return tokens.select("line_no").join(got, "line_no", "left").select("line_no", ids.alias("ids"))


def decode(ids: DataFrame, vocab: DataFrame, base: int = 4) -> DataFrame:
    """(line_no, text): the bytes of all pieces joined, specials left out."""
    each = ids.select("line_no", F.posexplode("ids").alias("pos", "id")).where(F.col("id") >= base).join(vocab, "id", "left")
    byte = (F.col("id") - base).cast("int")
    as_hex = F.when(byte < 256, F.lpad(F.hex(byte), 2, "0")).otherwise(F.hex(F.encode(F.coalesce("token", F.lit("")), "UTF-8")))
    got = each.groupBy("line_no").agg(F.array_sort(F.collect_list(F.struct("pos", as_hex.alias("h")))).alias("hs"))
    text = F.decode(F.unhex(F.array_join(F.transform("hs", lambda x: x["h"]), "")), "UTF-8")
    return ids.select("line_no").join(got.select("line_no", text.alias("text")), "line_no", "left").select("line_no", F.coalesce("text", F.lit("")).alias("text"))


def merge_all(vocab: DataFrame) -> DataFrame:
    """(token, id) of all vocabularies (export_id, token, id): merged in order of export, each adding what none before it has, by its id."""
    first = vocab.groupBy("token").agg(F.min(F.struct("export_id", "id")).alias("f"))
    key = F.concat_ws("|", F.lpad(F.col("f.export_id").cast("string"), 20, "0"), F.lpad(F.col("f.id").cast("string"), 20, "0"), "token")
    both = first.select("token", key.alias("k"))
    return both.join(C.index(both.select("k"), "k", "id"), "k").select("token", "id")


def merge_vocabs(first: DataFrame, second: DataFrame) -> DataFrame:
    """(token, id): the first vocabulary re-numbered by id, then what only the second has, by its id."""
    a = first.groupBy("token").agg(F.min("id").alias("id"))
    b = second.groupBy("token").agg(F.min("id").alias("id")).join(a.select("token"), "token", "left_anti")
    both = a.withColumn("part", F.lit(0)).unionByName(b.withColumn("part", F.lit(1)))
    key = F.concat_ws("|", "part", F.lpad(F.col("id").cast("string"), 20, "0"), "token")
    return both.select("token", key.alias("k")).join(C.index(both.select(key.alias("k")), "k", "id"), "k").select("token", "id")


def token_ids(tokens: DataFrame, vocab: DataFrame, unk: int = 0) -> DataFrame:
    """(line_no, pos, token, id) of single tokens; one that is not in the vocabulary gets the unknown id."""
    return tokens.join(vocab, "token", "left").withColumn("id", F.coalesce("id", F.lit(unk).cast("long")))


def id_tokens(ids: DataFrame, vocab: DataFrame, ignored: int = -100) -> DataFrame:
    """The rows (..., id) with their tokens; the ignored id gives the empty token, an id that is not in the vocabulary the unknown one."""
    got = ids.join(vocab, "id", "left")
    return got.withColumn("token", F.when(F.col("id") == ignored, F.lit("")).otherwise(F.coalesce("token", F.lit("<unk>"))))
