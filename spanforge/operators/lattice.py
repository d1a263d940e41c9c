"""Lattice operators on words: best segmentation, expected counts, and the trainers built on them.

A lattice input is a unit (src, word, n): equal inputs are searched once and weighted.  Sources are named by 128 hash bits
(s1, s2) in every shuffle, so the token arrays move once.  Expected counts are summed by higher-order functions in the JVM;
cells are looked up, and best segmentations found, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from math import isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.common import materialise, ship
from spanforge.functions import text as T
from spanforge.operators import corpus
from spanforge.operators import counts as C
from spanforge.operators import scores as S

SOURCE = ["s1", "s2"]
EDGES = "array<struct<start:int,end:int,span:string,score:double>>"


def let(x: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def named(df: DataFrame, src: Column | None = None) -> DataFrame:
    """The frame with the name (s1, s2) of its source."""
    src = F.col("src") if src is None else src
    return df.withColumn("s1", F.xxhash64(src)).withColumn("s2", F.xxhash64(F.lit(1), src))


def _scores(units: DataFrame, sources: DataFrame, spans: DataFrame, table: DataFrame, model: str) -> DataFrame:
    """(s1, s2, word, edges) by the scores of each (source, span), for any model."""
    key = [*SOURCE, "word"]
    each = units.select(*key).join(spans, "word")
    scored = each.join(S.score(model, each, table, SOURCE, sources), [*SOURCE, "span"])
    return scored.groupBy(*key).agg(F.collect_list(F.struct("start", "end", "span", "score")).alias("edges"))


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, its cells (n = 0; word is the span, x the count) before what is asked of it (n tokens in the source, x of them this one)."""
    token, row, total = None, {}, 0.0
    for b in batches:
        ct, out, at, end = [], [], [], 0
        sizes, i0, i1 = b["starts"].value_lengths().to_numpy(zero_copy_only=False).tolist(), b["starts"].flatten().to_numpy().tolist(), b["ends"].flatten().to_numpy().tolist()
        for i, (t, n, w, x) in enumerate(zip(b["token"].to_pylist(), b["n"].to_numpy().tolist(), b["word"].to_pylist(), b["x"].to_numpy().tolist())):
            if t != token:
                token, row, total = t, {}, 0.0
            if n == 0:
                row[w] = x
                total += x
            else:
                at.append(i)
                ct.append(total * x)
                begin, end = end, end + sizes[i]
                out += [row.get(w[j:k], 0.0) * x for j, k in zip(i0[begin:end], i1[begin:end])]
        if at:
            kept = b.take(pa.array(at, pa.int64()))
            sc = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], kept["starts"].value_lengths().to_numpy(zero_copy_only=False).cumsum())), pa.int32()), pa.array(out, pa.float64()))
            yield pa.RecordBatch.from_arrays([*(kept[k] for k in (*SOURCE, "word", "n", "starts", "ends")), pa.array(ct, pa.float64()), sc], names=[*SOURCE, "word", "n", "starts", "ends", "sct", "sc"])


def _summed(units: DataFrame, sources: DataFrame, spans: DataFrame, table: DataFrame) -> DataFrame:
    """(s1, s2, word, edges) of every unit for cond-exact.

    A score is a ratio of sums over the tokens of the source, so a unit goes to each of its tokens once, with the places of
    its spans, and meets the cells of the token there; what moves is units and cells, not their spans by their tokens.
    Sources of several different tokens are summed afterwards."""
    ship(units.sparkSession)
    key, none = [*SOURCE, "word"], F.array().cast("array<int>")
    places = spans.groupBy("word").agg(F.collect_list(F.struct("start", "end")).alias("p")).select("word", F.col("p.start").alias("starts"), F.col("p.end").alias("ends"))
    tokens = sources.select(*SOURCE, "src", F.explode_outer(F.array_distinct("src")).alias("token"))  # a source without tokens asks once, in vain
    tokens = tokens.select(*SOURCE, "token", F.greatest(F.size(F.array_distinct("src")), F.lit(1)).alias("n"), F.size(F.filter("src", lambda x: x == F.col("token"))).cast("double").alias("x"))
    asked = units.select(*key).join(places, "word", "left").join(tokens, SOURCE)
    asked = asked.select("token", "n", *key, F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"))
    cells = table.select("token", F.lit(0).alias("n"), F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"), F.col("span").alias("word"), F.col("c").cast("double").alias("x"), none.alias("starts"), none.alias("ends"))
    rows = cells.unionByName(asked).repartition("token").sortWithinPartitions("token", "n")
    got = materialise(rows.mapInArrow(_looked_up, "s1 long, s2 long, word string, n int, starts array<int>, ends array<int>, sct double, sc array<double>"), "looked_up")
    one = got.where("n = 1").select(*key, "starts", "ends", "sct", "sc")
    many = got.where("n > 1").groupBy(*key).agg(F.collect_list(F.struct("starts", "ends", "sct", "sc")).alias("g"))  # a row for each token of one source
    at = F.get("g", F.lit(0))
    total = F.aggregate("g", F.transform(at["sc"], lambda _: F.lit(0.0)), lambda a, x: F.zip_with(a, x["sc"], lambda p, q: p + q))
    many = many.select(*key, at["starts"].alias("starts"), at["ends"].alias("ends"), F.aggregate("g", F.lit(0.0), lambda a, x: a + x["sct"]).alias("sct"), total.alias("sc"))
    score = lambda i: F.when(F.get("sc", i) > 0, F.ln(F.get("sc", i)) - F.ln("sct")).otherwise(F.lit(float("-inf")))
    edge = lambda j, i: F.struct(j.alias("start"), F.get("ends", i).alias("end"), F.substring(F.col("word"), j + 1, F.get("ends", i) - j).alias("span"), score(i).alias("score"))
    return one.unionByName(many).select(*key, F.transform("starts", edge).cast(EDGES).alias("edges"))


def edges(units: DataFrame, sources: DataFrame, table: DataFrame, model: str, maxlen: int | None = None) -> DataFrame:
    """(s1, s2, word, edges) of each unit (s1, s2, word): the known spans of its word with their places and scores; sources is (s1, s2, src)."""
    key = [*SOURCE, "word"]
    known = table.select("span").distinct()
    spans = units.select("word").distinct().select("word", F.explode(T.spans(F.col("word"), maxlen)).alias("s")).select("word", "s.*").join(known, "span", "left_semi")
    if model == "cond-exact":
        return _summed(units, sources, spans, table)
    return units.select(*key).join(_scores(units, sources, spans, table, model), key, "left")


def _alphabet(table: DataFrame) -> DataFrame:
    return table.select(F.explode(F.split("span", "")).alias("ch")).where("ch <> ''").agg(F.array_join(F.collect_set("ch"), "").alias("alphabet"))  # one row, at most one entry per code point


def search(units: DataFrame, sources: DataFrame, table: DataFrame, model: str = "cond-exact", maxlen: int | None = None, inclusive: bool = False, nonfinite: str = "table_min") -> DataFrame:
    """(s1, s2, word, loss, tokens): best segmentation of each distinct unit (s1, s2, word).

    nonfinite: a known span without a finite score gets the least count of the table ('table_min') or is no edge ('floor').
    inclusive: spans up to maxlen; else, as published, up to maxlen - 1.  Scores that agree in nine digits are ties, which go
    to the shortest last span.  A character outside the alphabet, or a place no edge reaches, is one token and resets the score to 0."""
    longest = None if maxlen is None else maxlen if inclusive else maxlen - 1
    key = [*SOURCE, "word"]
    base = units.select(*key)
    if longest != 0:
        base = edges(units, sources, table, model, longest)
    else:
        base = base.withColumn("edges", F.lit(None).cast(EDGES))
    ship(units.sparkSession)
    low = table.agg(F.min("c").cast("double")).first()[0] if nonfinite == "table_min" else None
    e = F.coalesce("edges", F.array().cast(EDGES))
    rows = base.select(*key, e["start"].alias("starts"), e["end"].alias("ends"), e["score"].alias("scores"))
    return rows.mapInArrow(partial(_searched, alphabet=frozenset(_alphabet(table).first()[0]), low=low), "s1 long, s2 long, word string, loss double, tokens array<string>")


def best(word: str, edges: Iterable[tuple[int, int, float]], alphabet: frozenset[str], low: float | None) -> tuple[float, list[str]]:
    """(loss, tokens) of a word with edges (start, end, score), see search."""
    into: list[list[tuple[int, float]]] = [[] for _ in range(len(word) + 1)]
    for i, j, x in edges:
        if not isfinite(x):
            if low is None:
                continue
            x = low
        into[j].append((i, x))
    loss, back = [0.0], [0]
    for j in range(1, len(word) + 1):
        top, at = 0.0, j - 1
        if into[j] and word[j - 1] in alphabet:
            top, at = into[j][0][1] + loss[into[j][0][0]], into[j][0][0]
            if len(into[j]) > 1:
                _, at, top = max((round(x + loss[i], 9), i, x + loss[i]) for i, x in into[j])
        loss.append(top)
        back.append(at)
    tokens, j = [], len(word)
    while j:
        tokens.append(word[back[j] : j])
        j = back[j]
    return loss[-1], tokens[::-1]


def _searched(batches: Iterator[pa.RecordBatch], alphabet: frozenset[str], low: float | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = b["starts"].value_lengths().to_numpy(zero_copy_only=False).tolist()
        i, j, x = (b[k].flatten().to_numpy(zero_copy_only=False).tolist() for k in ("starts", "ends", "scores"))
        got, end = [], 0
        for w, n in zip(b["word"].to_pylist(), sizes):
            begin, end = end, end + n
            got.append(best(w, zip(i[begin:end], j[begin:end], x[begin:end]), alphabet, low))
        yield pa.RecordBatch.from_arrays([*(b[k] for k in (*SOURCE, "word")), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.string()))], names=[*SOURCE, "word", "loss", "tokens"])


def viterbi(units: DataFrame, table: DataFrame, model: str = "cond-exact", maxlen: int | None = None, inclusive: bool = False, nonfinite: str = "table_min") -> DataFrame:
    """(src, word, n, loss, tokens): best segmentation of each unit, see search."""
    u = materialise(named(units), "units")
    got = search(u, u.select(*SOURCE, "src").dropDuplicates(SOURCE), table, model, maxlen, inclusive, nonfinite)
    return u.join(got, [*SOURCE, "word"]).select("src", "word", "n", "loss", "tokens")


def tokenize(pairs: DataFrame, table: DataFrame, model: str = "cond-exact", **kw) -> DataFrame:
    """(line_no, tokens, loss): every line, segmented word by word given its whole source; distinct (src, word) are searched once."""
    src = F.array().cast("array<string>") if model in S.UNPAIRED else F.col("src")  # without a source, a word is searched once in all
    lines = materialise(named(pairs.select("line_no", src.alias("src"), T.marked_words(F.col("trg")).alias("ws"))), "lines")
    words = lines.select("line_no", *SOURCE, F.posexplode("ws").alias("pos", "word"))
    return _joined_lines(pairs, words, lines.select(*SOURCE, "src").dropDuplicates(SOURCE), table, model, **kw)


def tokenize_words(pairs: DataFrame, words: DataFrame, table: DataFrame, model: str = "cond-exact", **kw) -> DataFrame:
    """(line_no, tokens, loss) of lines whose words (line_no, pos, src, word) have sources of their own."""
    w = materialise(named(words), "words")
    return _joined_lines(pairs, w.select("line_no", "pos", *SOURCE, "word"), w.select(*SOURCE, "src").dropDuplicates(SOURCE), table, model, **kw)


def _joined_lines(pairs: DataFrame, words: DataFrame, sources: DataFrame, table: DataFrame, model: str, **kw) -> DataFrame:
    best = search(materialise(words.select(*SOURCE, "word").distinct(), "units"), materialise(sources, "sources"), table, model, **kw)
    got = words.join(best, [*SOURCE, "word"])
    lines = got.groupBy("line_no").agg(F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("ws"), F.sum("loss").alias("loss"))
    lines = lines.select("line_no", F.flatten(F.transform("ws", lambda x: x["tokens"])).alias("tokens"), "loss")
    return pairs.select("line_no").join(lines, "line_no", "left").select("line_no", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), F.coalesce("loss", F.lit(0.0)).alias("loss"))


def expected_counts(units: DataFrame, table: DataFrame, model: str = "cond-exact", maxlen: int | None = None) -> DataFrame:
    """(span, token, c): expected use of each span, by forward and backward sums over the lattice, weights softmax-normalised over the whole lattice."""
    u = materialise(named(units), "units")
    key = [*SOURCE, "word"]
    e = edges(u.select(*key), u.select(*SOURCE, "src").dropDuplicates(SOURCE), table, model, maxlen)
    finite = F.filter("edges", lambda x: ~F.isnan(x["score"]) & (x["score"] > float("-inf")))
    alone = F.filter(F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: F.struct(i.cast("int").alias("start"), (i + 1).cast("int").alias("end"), F.substring(F.col("word"), i + 1, F.lit(1)).alias("span"), F.lit(0.0).alias("score"))),
                     lambda x: ~F.exists("edges", lambda y: (y["start"] == x["start"]) & (y["end"] == x["end"])))
    base = u.select("src", "word", "n", *SOURCE).join(e, key).withColumn("edges", F.coalesce("edges", F.array().cast(EDGES)))
    base = base.withColumn("all", F.concat(finite, alone))
    top = F.array_max(F.transform("all", lambda x: x["score"]))
    base = base.withColumn("top", top).withColumn("z", F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x["score"] - F.col("top"))))
    weighed = F.transform("all", lambda x: F.struct(x["start"].alias("i"), x["end"].alias("j"), x["span"].alias("span"), (F.exp(x["score"] - F.col("top")) / F.col("z")).alias("w")))
    one = F.array(F.lit(1.0))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    n = F.length("word")
    places = F.sequence(F.lit(1), n)
    alpha = lambda es: F.aggregate(places, one, lambda acc, j: F.array_append(acc, total(F.filter(es, lambda x: x["j"] == j), lambda x: F.get(acc, x["i"]) * x["w"])))
    # beta is built from the end: entry k belongs to place n - k
    beta = lambda es: F.aggregate(places, one, lambda acc, k: F.array_append(acc, total(F.filter(es, lambda x: x["i"] == n - k), lambda x: F.get(acc, n - x["j"]) * x["w"])))
    used = lambda es: let(alpha(es), lambda a: let(beta(es), lambda b: F.transform(es, lambda x: F.struct(x["span"].alias("span"), (x["w"] * F.get(a, x["i"]) * F.get(b, n - x["j"])).alias("p")))))
    each = base.where("size(src) > 0").select("src", "n", F.explode(let(weighed, used)).alias("u"))
    return each.select(F.col("u.span").alias("span"), F.explode("src").alias("token"), (F.col("n") * F.col("u.p") / F.size("src")).alias("c")).join(table.select("span").distinct(), "span", "left_semi").groupBy("span", "token").agg(F.sum("c").alias("c"))


def hard_counts(best: DataFrame) -> DataFrame:
    """(span, token, c) over the chosen tokens; source duplicates count."""
    return best.select("src", "n", F.explode("tokens").alias("span")).select("n", "span", F.explode("src").alias("token")).groupBy("span", "token").agg(F.sum("n").alias("c"))


def initial_spans(pairs: DataFrame, vocab_size: int, runs: int = 3, p: float = 0.5, seed: int = 0, maxlen: int | None = None, least: int = 0) -> DataFrame:
    """(span): union of the spans that unpaired training leaves on samples of the lines, a sample dropping each line with probability p.

    Where a sample is too small for vocab_size spans, all it has are kept, so no run has to be started again."""
    out = None
    for r in range(runs):
        table = train(corpus.dropout(pairs, p, seed + r), vocab_size, "sum-unpaired", "em", n_iter=1, maxlen=maxlen, least=least)
        spans = table.select("span").distinct()
        out = spans if out is None else out.union(spans)
    return out.distinct()


def train(pairs: DataFrame, vocab_size: int, model: str = "cond-exact", method: str = "em", n_iter: int = 2, n_sub_iter: int = 1, reduce: float = 0.75, coverage: float = 1.0, maxlen: int | None = None, least: int = 0, spans: DataFrame | None = None, losses: list[float] | None = None) -> DataFrame:
    """The trained count table.  em: the segmentations' counts are added to the table; mc: expected counts replace it.  Each step is written, so lineage stays short and a lost executor costs one step.

    losses: gets the average loss of a unit in each em step.  maxlen falls to the longest span that is left."""
    keep = spans if spans is not None else corpus.threshold(corpus.span_counts(pairs, maxlen), least) if least else None
    table = materialise(C.cooccurrence(pairs, maxlen, keep), "counts")
    if coverage < 1:
        table = materialise(S.prune_characters(table, coverage), "counts")
    units = materialise(corpus.paired_words(pairs), "units")

    def size(t: DataFrame) -> tuple[int, int | None]:
        """(spans, length of the longest) in one pass."""
        r = t.agg(F.count_distinct("span"), F.max(F.length("span"))).first()
        return r[0], r[1] if maxlen is not None else None

    n, longest = size(table)
    vocab_size = min(vocab_size, n)

    def step(t: DataFrame) -> DataFrame:
        if method == "em":
            known = t.select("span").distinct()
            best = viterbi(units, t, model, longest)
            if losses is not None:
                best = materialise(best, "best")
                losses.append(best.agg(F.sum(F.col("loss") * F.col("n")) / F.sum("n")).first()[0])
            return materialise(C.add(t.withColumn("c", F.col("c").cast("double")), hard_counts(best).join(known, "span", "left_semi").withColumn("c", F.col("c").cast("double"))), "counts")
        return materialise(expected_counts(units, t, model, longest), "counts")

    for i in range(1, n_iter * n_sub_iter + 1):
        table = step(table)
        if i % n_sub_iter == 0:
            table = materialise(S.prune(table, vocab_size, reduce), "counts")
            n, longest = size(table)
            if n <= vocab_size:
                break
    return step(table)
