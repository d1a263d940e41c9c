"""Registry of the queries of the core with their DuckDB oracles.

Queries run over their whole tables.  Counts are built on the aligned word pairs (a line is one pair of words; sentence_counts and
tokenize_* take whole sentence pairs), with spans of up to MAXLEN characters kept from
LEAST occurrences: a cut of the published configuration, which has neither limit (README)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge import sources
from spanforge.common import materialise, table
from spanforge.functions import text as T
from spanforge.operators import alignment as A
from spanforge.operators import codec, corpus, lattice
from spanforge.operators import counts as C
from spanforge.operators import scores as S
from spanforge.plans import metrics as M
from spanforge.plans import oracle as O

MAXLEN, LEAST = O.MAXLEN, O.LEAST
Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def joined(df: DataFrame) -> DataFrame:
    """Arrays of tokens as one string, for results."""
    return df.select(*[F.array_join(c, " ").alias(c) if t == "array<string>" else F.array_join(c, " ").alias(c) if t in ("array<bigint>", "array<int>") else F.col(c) for c, t in df.dtypes])


def pairs(s: SparkSession, d: str) -> DataFrame:
    return corpus.prepared(corpus.lines(s, d))


def aligned(s: SparkSession, d: str) -> DataFrame:
    return corpus.aligned_pairs(corpus.lines(s, d), table(s, d, "alignment"))


def freq(s: SparkSession, d: str) -> DataFrame:
    return corpus.span_counts(aligned(s, d), MAXLEN)


def _counted(a: DataFrame) -> DataFrame:
    return C.cooccurrence(a, MAXLEN, corpus.threshold(corpus.span_counts(a, MAXLEN), LEAST))


def counts(s: SparkSession, d: str) -> DataFrame:
    return _counted(materialise(aligned(s, d), "aligned"))


def model(s: SparkSession, d: str) -> DataFrame:
    """The count table written once, for queries that read it (and its marginals) several times."""
    return materialise(counts(s, d), "counts")


def words_and_model(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(lattice inputs, count table) of the aligned words, which are written once for both."""
    a = materialise(aligned(s, d), "aligned")
    return corpus.paired_words(a), materialise(_counted(a), "counts")


def units(s: SparkSession, d: str) -> DataFrame:
    """Distinct (src, span) of all aligned words and their spans."""
    w = corpus.paired_words(aligned(s, d))
    return w.select("src", F.explode(T.spans(F.col("word"), MAXLEN)).alias("x")).select("src", "x.span").distinct()


def tokens_of(s: SparkSession, d: str) -> DataFrame:
    return pairs(s, d).select("line_no", T.marked_words(F.col("trg")).alias("tokens"))


def vocabs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "vocab").where("vocab is not null").select("export_id", F.col("vocab").alias("token"), F.col("id").cast("long").alias("id"))


def _scan(s, d):
    df = sources.scrub(sources.scrub(corpus.lines(s, d), "src"), "trg", " ")
    return df.select("line_no", "src", "trg")


def _lengths(s, d):
    p = pairs(s, d).select("line_no", F.array_join("src", " ").alias("t"))
    return p.select("line_no", F.length("t").alias("chars"), F.octet_length("t").alias("bytes"), F.size(F.filter(F.split("t", " "), lambda x: x != "")).alias("words"))


def _score(kind: str) -> Query:
    return lambda s, d: rounded(joined(S.score(kind, units(s, d), model(s, d)).where(F.col("score") > float("-inf"))))


def _extract(kind: str) -> Query:
    return lambda s, d: rounded(S.extract(kind, model(s, d), 3))


def _align(kind: str) -> Query:
    return lambda s, d: rounded(joined(S.align(kind, units(s, d), model(s, d))))


def _viterbi(inclusive: bool) -> Query:
    return lambda s, d: rounded(joined(lattice.viterbi(*words_and_model(s, d), "cond-exact", MAXLEN, inclusive)))


def _train(method: str) -> Query:
    return lambda s, d: rounded(lattice.train(materialise(aligned(s, d), "aligned"), 2000, "cond-exact", method, n_iter=2, coverage=0.9999, maxlen=MAXLEN, least=LEAST))


def _word_lines(s, d):
    r = corpus.aligned_words(corpus.lines(s, d), table(s, d, "alignment"))
    return r.select("line_no", F.array("src_word").alias("s"), F.array("trg_word").alias("t"))


def _lexical(s, d):
    p = pairs(s, d).select("line_no", F.array_distinct("src").alias("s"), F.array_distinct(T.marked_words(F.col("trg"))).alias("t"))
    return rounded(A.lexical_step(p), 8)


def sentence_model(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(prepared lines, count table of whole sentence pairs), spans from one occurrence per LINES_PER lines."""
    p = materialise(pairs(s, d), "pairs")
    keep = corpus.threshold(corpus.span_counts(p, MAXLEN), max(2, p.count() // O.LINES_PER))
    return p, materialise(C.cooccurrence(p, MAXLEN, keep), "counts")


def _paired(s, d):
    p, t = sentence_model(s, d)
    got = lattice.tokenize(p, t, "cond-exact", maxlen=MAXLEN, inclusive=True)
    return rounded(joined(got.where("size(tokens) > 0")), 4)


def _aligned_tokens(s, d):
    p, t = sentence_model(s, d)
    w = corpus.words_with_sources(corpus.lines(s, d), table(s, d, "alignment"))
    return rounded(joined(lattice.tokenize_words(p, w, t, "cond-exact", maxlen=MAXLEN, inclusive=True)), 4)


def _paired_metrics(s, d):
    """Metrics of the segmentation of whole sentence pairs."""
    p, t = sentence_model(s, d)
    got = lattice.tokenize(p, t, "cond-exact", maxlen=MAXLEN, inclusive=True).join(p.select("line_no", F.size("src").alias("w")), "line_no")
    return rounded(M.token_metrics(got.select("tokens", "w"), F.col("w"), t.select("span").distinct().count()))


def _symmetrise(s, d):
    links = table(s, d, "alignment").select("line_no", F.explode("links").alias("l")).select("line_no", "l.si", "l.ti").distinct()
    fwd = links.groupBy("line_no", "si").agg(F.min("ti").alias("ti"))
    bwd = links.groupBy("line_no", "ti").agg(F.max("si").alias("si"))
    return A.symmetrise(fwd, bwd)


def _encode(s, d):
    t = tokens_of(s, d)
    return joined(codec.encode(t, codec.export_vocab(s, corpus.threshold(corpus.span_counts(pairs(s, d), MAXLEN), 200)), bos=1, eos=2))


def _decode(s, d):
    t = tokens_of(s, d)
    v = codec.export_vocab(s, corpus.threshold(corpus.span_counts(pairs(s, d), MAXLEN), 200))
    return codec.decode(codec.encode(t, v, bos=1, eos=2), v)


def _lm(s, d):
    w = pairs(s, d).select("line_no", F.array_join("src", " ").alias("t"), "src")
    each = w.select("line_no", F.explode("src").alias("w"))
    f = each.groupBy("w").agg(F.count("*").alias("c")).crossJoin(F.broadcast(each.agg(F.count("*").alias("n"))))
    loss = each.join(f, "w").groupBy("line_no").agg(F.sum(-F.ln(F.col("c") / F.col("n"))).alias("loss"))
    samples = w.join(loss, "line_no").select("loss", F.size("src").alias("tokens"), F.size("src").alias("words"), F.length("t").alias("chars"), F.octet_length("t").alias("bytes"))
    return rounded(M.lm_metrics(samples), 4)


def _metrics(s, d):
    return table(s, d, "intrinsic_metrics")


def _tok(s, d):
    p = pairs(s, d).select(T.marked_words(F.col("trg")).alias("tokens"), F.size("src").alias("w"))
    return rounded(M.token_metrics(p, F.col("w")))


def _in_alphabet(s, d):
    """Whether a word has characters of 10 * LEAST occurrences or more alone."""
    f = materialise(freq(s, d), "freq")
    chars = F.broadcast(f.where(f"length(span) = 1 and freq >= {10 * LEAST}").agg(F.collect_set("span").alias("a")))  # one row, at most one entry per code point
    w = corpus.word_counts(aligned(s, d)).crossJoin(chars)
    return w.select("word", "n", F.forall(F.filter(F.split("word", ""), lambda x: x != ""), lambda x: F.array_contains("a", x)).alias("known"))


def _row_select(u, t):
    known = u.join(t.select("span").distinct(), "span", "left_semi").select(F.array_join("src", " ").alias("unit"), "span", "src")
    return C.select_rows(known, t).select("unit", "span", "pos", "token", "c")


QUERIES: dict[str, Query] = {
    "line_scan": _scan,
    "prepare_src": lambda s, d: joined(pairs(s, d).select("line_no", "src")),
    "prepare_trg": lambda s, d: pairs(s, d).select("line_no", "trg"),
    "detokenize": lambda s, d: pairs(s, d).select("line_no", T.detokenize(F.array_join(T.marked_words(F.col("trg")), " ")).alias("text")),
    "text_lengths": _lengths,
    "row_dropout": lambda s, d: corpus.dropout(corpus.lines(s, d), 0.5, 7).select("line_no"),
    "shuffle_take": lambda s, d: corpus.shuffle_take(corpus.lines(s, d), 1000, 3).select("line_no"),
    "split_buckets": lambda s, d: corpus.buckets(corpus.lines(s, d), 20).select("line_no", "bucket"),
    "head_lines": lambda s, d: corpus.lines(s, d).where("line_no <= 1000").select("line_no", "src", "trg"),
    "span_enumerate": lambda s, d: corpus.word_counts(aligned(s, d)).select("word", F.explode(T.spans(F.col("word"), MAXLEN)).alias("s")).select("word", "s.*"),
    "span_set": lambda s, d: freq(s, d).select("span"),
    "span_frequency": freq,
    "line_span_frequency": lambda s, d: corpus.span_counts(pairs(s, d), MAXLEN),
    "span_threshold": lambda s, d: corpus.threshold(freq(s, d), LEAST),
    "span_list_filter": lambda s, d: freq(s, d).join(table(s, d, "vocab").select(F.col("vocab").alias("span")).distinct(), "span", "left_semi"),
    "alphabet": lambda s, d: corpus.alphabet(freq(s, d)),
    "alphabet_filter": _in_alphabet,
    "cooccurrence": counts,
    "count_marginals": lambda s, d: C.marginals(counts(s, d)),
    "count_minmax": lambda s, d: C.extremes(counts(s, d), "span"),
    "table_add": lambda s, d: (lambda t: C.add(t, t.where("c >= 10")))(model(s, d)),
    "table_increase": lambda s, d: (lambda t: C.increase_all(t, t.where("c >= 100").select("span", F.array("token", "token").alias("tokens"))))(model(s, d)),
    "table_replace": lambda s, d: (lambda t: C.replace(t.where("length(span) = 1"), t))(model(s, d)),
    "table_scale": lambda s, d: rounded(C.scale(counts(s, d), lambda c: c * 3 / 2)),
    "table_upsert": lambda s, d: (lambda t: C.upsert(t, t.where("c = 1").withColumn("c", F.lit(5).cast("long"))))(model(s, d)),
    "sparsity": lambda s, d: rounded(C.sizes(model(s, d)), 9),
    "delete_spans": lambda s, d: C.delete_spans(model(s, d), corpus.threshold(freq(s, d), 10 * LEAST)),
    "row_select": lambda s, d: _row_select(units(s, d), model(s, d)),
    "reindex": lambda s, d: C.index(model(s, d), "span", "span_id"),
    **{f"score_{m.replace('-', '_')}": _score(m) for m in (*S.PAIRED, *S.UNPAIRED)},
    **{f"align_{m.replace('-', '_')}": _align(m) for m in S.PAIRED},
    **{f"extract_{m}": _extract(m) for m in ("max", "pmi")},
    "extract_topk": lambda s, d: rounded(S.extract("cond-exact", model(s, d), 3)),
    "information": lambda s, d: rounded(S.information(model(s, d)), 9),
    "prune_information": lambda s, d: rounded(S.least_informative(model(s, d), 1000, 0.25), 9),
    "rare_characters": lambda s, d: S.rare_characters(model(s, d), 0.99),
    "prune_characters": lambda s, d: S.prune_characters(model(s, d), 0.99),
    "viterbi_tokens": _viterbi(False),
    "viterbi_inclusive": _viterbi(True),
    "tokenize_lines": lambda s, d: rounded(joined(lattice.tokenize(pairs(s, d), model(s, d), "sum-unpaired", maxlen=MAXLEN, inclusive=True))),
    "expected_counts_step": lambda s, d: rounded(lattice.expected_counts(*words_and_model(s, d), "cond-exact", MAXLEN)),
    "hard_count_step": lambda s, d: lattice.hard_counts(lattice.viterbi(*words_and_model(s, d), "cond-exact", MAXLEN)),
    "train_em": _train("em"),
    "train_mc": _train("mc"),
    "word_pairs": lambda s, d: corpus.aligned_words(corpus.lines(s, d), table(s, d, "alignment")),
    "phrase_pairs": lambda s, d: A.phrases(corpus.lines(s, d), table(s, d, "alignment")),
    "link_symmetrise": _symmetrise,
    "lexical_step": _lexical,
    "sentence_counts": lambda s, d: sentence_model(s, d)[1],
    "tokenize_paired": _paired,
    "tokenize_aligned": _aligned_tokens,
    "paired_metrics": _paired_metrics,
    "vocab_export": lambda s, d: codec.export_vocab(s, corpus.threshold(freq(s, d), LEAST)),
    "encode_ids": _encode,
    "decode_ids": _decode,
    "vocab_merge": lambda s, d: codec.merge_all(vocabs(s, d)),
    "token_metrics": _tok,
    "vocab_overlap": lambda s, d: rounded(M.vocab_overlaps(vocabs(s, d))),
    "lm_metrics": _lm,
    "cell_mean": lambda s, d: rounded(M.cells(_metrics(s, d))),
    "parity_ratio": lambda s, d: rounded(M.parity(_metrics(s, d))),
    "renyi_ratio": lambda s, d: rounded(M.ratio(_metrics(s, d), "renyi")),
    "length_ratio": lambda s, d: rounded(M.ratio(_metrics(s, d), "length")),
    "ratio_matrix": lambda s, d: rounded(M.both_ratios(_metrics(s, d), "renyi")),
    "metric_grid": lambda s, d: rounded(M.on_grid(_metrics(s, d), M.grid(s, pair=["fra-ita", "ita-fra", "ces-ukr", "ukr-ces"], size=[100000, 500000], vocab=[8000, 16000, 32000], alignment=["align"], model=["unigram", "cond-exact"]))),
    "metric_pivot": lambda s, d: rounded(M.pivot(_metrics(s, d), "fertility", [8000, 16000, 32000])),
    "metric_trend": lambda s, d: rounded(M.trend(_metrics(s, d), "renyi")),
    "linear_extrapolation": lambda s, d: rounded(M.linear_extrapolation(_metrics(s, d), "renyi"), 5),
    "exponential_fit": lambda s, d: rounded(M.exponential_fit(_metrics(s, d), "length"), 3),
}
ORACLE: dict[str, str] = O.ORACLE
