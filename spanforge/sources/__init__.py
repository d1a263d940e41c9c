"""Sources and sinks: text lines, alignments, vocabularies, models and metric files."""

from __future__ import annotations

import io
import json
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.common import materialise
from spanforge.operators import counts as C

SEPARATORS = "[\\x{2028}\\x{2029}]"


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(line_no, text) of text files in path order; numbers are fixed at ingest, so parallel files can be joined on them.

    Lines are ordered by file, block of the file and place in the block, and numbered by distributed ranks."""
    out = None
    for i, p in enumerate(paths):
        at = [F.lit(i).alias("_i"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m")]
        df = spark.read.text(p).select(F.col("value").alias("text"), *at)
        out = df if out is None else out.unionByName(df)
    return C.ranked(materialise(out, "lines"), ["_i", "_f", "_b", "_m"], "line_no", 1).select("line_no", "text")


def scrub(df: DataFrame, column: str, replace: str = "") -> DataFrame:
    """Line separators inside a text removed (or replaced), ends trimmed."""
    return df.withColumn(column, F.trim(F.regexp_replace(column, SEPARATORS, replace)))


def write_lines(df: DataFrame, path: str, column: str = "text") -> None:
    """One text per line in line order."""
    df.orderBy("line_no").select(F.coalesce(F.col(column), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def write_parallel(df: DataFrame, src_path: str, trg_path: str, src: str = "src", trg: str = "trg") -> None:
    """The two sides of line pairs as two text files with the same line order."""
    df = materialise(df.select("line_no", src, trg), "parallel")
    write_lines(df, src_path, src)
    write_lines(df, trg_path, trg)


def write_splits(rows: DataFrame, path: str, splits: tuple[str, ...] = ("dev", "devtest")) -> None:
    """Each held-out split as a pair of text files under the path."""
    for name in splits:
        write_parallel(rows.where(F.col("split") == name), f"{path}/{name}.src", f"{path}/{name}.trg")


def zip_lines(**sides: DataFrame) -> DataFrame:
    """Positional zip of line frames, cut to the shortest."""
    out = None
    for name, df in sides.items():
        one = df.select("line_no", F.col("text").alias(name))
        out = one if out is None else out.join(one, "line_no")
    return out


def parse_links(col: str):
    """'0-0 1-2' (or with a third part, a score, left out) as links."""
    each = F.filter(F.split(F.trim(col), " +"), lambda x: x != "")
    return F.transform(each, lambda x: F.struct(F.split(x, "-")[0].cast("int").alias("si"), F.split(x, "-")[1].cast("int").alias("ti")))


def format_links(col: str):
    """Scored links as 'i-j-score'."""
    return F.array_join(F.transform(col, lambda x: F.concat_ws("-", x["si"].cast("string"), x["ti"].cast("string"), x["score"].cast("string"))), " ")


def save_model(table: DataFrame, path: str, **meta) -> None:
    """A count table as parquet with its metadata beside it."""
    table.write.mode("overwrite").parquet(f"{path}/counts")
    spark = table.sparkSession
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/counts"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def load_vocab(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(spans of a saved model, a warning if they are not as many as its metadata says); only the span column is read."""
    spans = spark.read.parquet(f"{path}/counts").select("span").distinct()
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    n = spans.count()
    return spans, None if meta.get("vocab_size") in (None, n) else f"the model has {n} spans, its metadata says {meta['vocab_size']}"


def export_archive(table: DataFrame, path: str, max_cells: int = 20_000_000, **meta) -> None:
    """A single-file model for exchange: an archive of JSON documents (index maps and id-keyed counts), written by the driver; a
    table of more than max_cells cells, which would not fit it, is refused (save_model writes tables of any size)."""
    if table.limit(max_cells + 1).count() > max_cells:
        raise ValueError(f"more than {max_cells} cells: use save_model")
    rows = table.select("span", "token", "c").toLocalIterator()
    spans: dict[str, int] = {}
    tokens: dict[str, int] = {}
    cells: dict[int, dict[int, float]] = {}
    for r in rows:
        cells.setdefault(spans.setdefault(r[0], len(spans)), {})[tokens.setdefault(r[1], len(tokens))] = r[2]
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w:gz") as t:
        for name, obj in (("_span_index", spans), ("_token_index", tokens), ("_count", cells)):
            _put(t, name, json.dumps(obj, ensure_ascii=False).encode())
    with tarfile.open(path, "w:gz") as t:
        _put(t, "self_data.json", json.dumps(meta).encode())
        _put(t, "table.tar.gz", inner.getvalue())


def _put(t: tarfile.TarFile, name: str, data: bytes) -> None:
    info = tarfile.TarInfo(name)
    info.size = len(data)
    t.addfile(info, io.BytesIO(data))


def import_archive(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Back to (span, token, c) and metadata; the maps are parsed by Spark."""
    with tarfile.open(path) as t:
        meta = json.loads(t.extractfile("self_data.json").read())
        with tarfile.open(fileobj=io.BytesIO(t.extractfile("table.tar.gz").read())) as u:
            text = {n: u.extractfile(n).read().decode() for n in ("_span_index", "_token_index", "_count")}
    one = spark.createDataFrame([(text["_span_index"], text["_token_index"], text["_count"])], "s string, t string, c string")
    ids = lambda c: F.explode(F.from_json(c, T.MapType(T.StringType(), T.IntegerType())))
    spans = one.select(ids("s").alias("span", "sid"))
    tokens = one.select(ids("t").alias("token", "tid"))
    cells = one.select(F.explode(F.from_json("c", "map<string,map<string,double>>")).alias("sid", "row")).select(F.col("sid").cast("int").alias("sid"), F.explode("row").alias("tid", "c")).withColumn("tid", F.col("tid").cast("int"))
    return cells.join(spans, "sid").join(tokens, "tid").select("span", "token", "c"), meta


def write_vocab_yaml(vocab: DataFrame, path: str) -> None:
    """'token: id' lines in id order, tokens as JSON strings (which YAML reads)."""
    with open(path, "w", encoding="utf-8") as f:
        for r in vocab.orderBy("id").toLocalIterator():
            f.write(f"{json.dumps(r['token'], ensure_ascii=False)}: {r['id']}\n")


def read_vocab_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of such a file or of plain 'token: id' lines."""
    line = spark.read.text(path).where("trim(value) <> ''")
    key = F.regexp_extract("value", "^(.*):\\s*(-?[0-9]+)\\s*$", 1)
    quoted = F.get_json_object(F.concat(F.lit('{"k":'), key, F.lit("}")), "$.k")
    return line.select(F.when(key.startswith('"'), quoted).otherwise(F.regexp_replace(key, "^'(.*)'$", "$1")).alias("token"), F.regexp_extract("value", ":\\s*(-?[0-9]+)\\s*$", 1).cast("long").alias("id"))


def write_pairs_tsv(pairs: DataFrame, path: str) -> None:
    pairs.select("span", "token", "score").write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_metrics(spark: SparkSession, grid: DataFrame, path: str, schema: str, default: float | None = 0.0) -> DataFrame:
    """Metric files (JSON) of an experiment grid with column `path`; a missing file gives defaults, or no row where default is None."""
    got = spark.read.schema(schema).json(path).withColumn("path", F.input_file_name())
    key = F.element_at(F.split("path", "/"), -1)
    names = [f.name for f in got.schema.fields if f.name != "path"]
    joined = grid.withColumn("_k", key).join(got.withColumn("_k", key).drop("path"), "_k", "inner" if default is None else "left").drop("_k")
    return joined if default is None else joined.fillna(default, names)


def comet_score(line: str):
    """The last blank-separated part of a score line."""
    return F.element_at(F.split(F.trim(line), " +"), -1).cast("double")


def score_pivot(df: DataFrame, key: list[str], column: str, names: list[str]) -> DataFrame:
    """One column per named score of a JSON list of {name, score}."""
    each = df.select(*key, F.explode_outer(F.from_json(column, "array<struct<name:string,score:double>>")).alias("e"))
    return each.groupBy(*key).pivot("e.name", names).agg(F.first("e.score", ignorenulls=True))
