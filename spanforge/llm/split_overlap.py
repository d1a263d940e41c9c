"""Problem 5: the same or nearly the same text in an evaluation split and in the training split.

A record is normalised to its distinct words (lower-cased runs of letters and digits) in the order of their hashes and cut
by content: a chunk ends where the hash leaves one of k equal ranges, k being fixed by the size band of the training text.
A rolling (additive) hash gives each chunk's digest.  Digests are joined across the splits; what shares one is checked
exactly on the words themselves.

The cut makes the join exact for word sets, whatever the order of the words and the places of the edits: two texts that
reach the threshold differ by at most d words, each of which changes one chunk, so of any d + 1 chunks of the one text at
least one stands unchanged in the other.  An evaluation text looks up its d + 1 longest chunks (chunks that no training text
has count with them: the bound is on changed chunks).  A text whose words fall into fewer than d + 1 chunks of a band (few,
most of them of four or five words) is looked up by chunks of one word, d + 1 rare ones, in a pass of its own.

Texts with the same set of words form one class, told apart by 128 hash bits, and a class that stands out sends its chunks
once a side, so copies are compared once and expanded in the result only.  Every chunk row carries a parity sketch of its
text's words, whose difference never exceeds that of the texts, so a pair that cannot reach the threshold is dropped inside
the join and none that can is.  Joins of chunks are plain sort-merge joins of two exchanges, which adaptive execution
splits where a chunk is very frequent.

Defined results: null, empty and blank texts and texts without letter or digit match nothing; a pair of rows comes out
once whichever texts of it match; repeated rows give a pair each; ties between chunks go by digest; empty tables give an
empty result; columns of other names play no part.
"""

from __future__ import annotations


from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.common import materialise, ship, table
from spanforge.llm import npwords

THRESHOLD = 0.8
REPEATED = 1e-6  # classes with at least this share of all texts, at most 1 / REPEATED, send one text a side
CHECK_ROWS = 500_000  # texts to check, or texts looked up word by word, that may be broadcast; beyond, they are joined by a shuffle
EVAL = ("dev", "devtest")
LENGTH = 255  # the low bits of a digest hold the number of words of its chunk
PROFILE = "cls long, chk long, id long, field int, ev boolean, sketch long, own array<long>, probe array<long>, rest boolean"


@lru_cache(1)
def bands() -> np.ndarray:
    """Least size of each size band; a text matches texts of its own band and of the two beside it only."""
    out = [1, 2, 3, 4]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 2, int(out[-1] / THRESHOLD) + 1))
    return np.array(out)


def differing(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Most words in which sets of n and m words differ that reach the threshold; -1 where none do."""
    common = np.ceil((n + m) * (THRESHOLD / (1 + THRESHOLD)) - 1e-9).astype(np.int64)
    return np.where(common <= np.minimum(n, m), n + m - 2 * common, -1)


def most_differing(n: np.ndarray, band: np.ndarray) -> np.ndarray:
    """The same over all partners of a band for texts of n words."""
    lo = np.maximum(bands()[band], np.ceil(n * THRESHOLD - 1e-9).astype(np.int64))
    hi = np.minimum(bands()[band + 1] - 1, np.floor(n / THRESHOLD + 1e-9).astype(np.int64))
    two = np.maximum(differing(n, hi), differing(n, np.maximum(hi - 1, lo)))  # grows with the partner but for parity
    return np.where(hi >= lo, two, -1)


def cuts(band: np.ndarray) -> np.ndarray:
    """Number of chunks a text of the band is cut into: one more than the d + 1 of its largest pair."""
    hi = bands()[band + 1] - 1
    return np.maximum(differing(np.floor(hi / THRESHOLD).astype(np.int64), hi), differing(hi, hi)) + 2


def chunked(hs: np.ndarray, begin: np.ndarray, n: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digest of each chunk, number of chunks of each text): texts are slices of the word hashes hs, sorted within, cut for a band each."""
    size = np.repeat(n, n)
    at = np.repeat(begin, n) + np.arange(len(size)) - np.repeat(np.cumsum(n) - n, n)
    h = hs[at]
    b = np.repeat(band, n).astype(np.uint64)
    group = ((h >> np.uint64(32)) * np.repeat(cuts(band), n).astype(np.uint64)) >> np.uint64(32)
    text = np.repeat(np.arange(len(n)), n)
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (group[1:] != group[:-1])))
    length = np.diff(np.append(first, len(h)))
    digest = npwords.mix(np.add.reduceat(npwords.mix(h ^ npwords.MULT), first) + (b[first] << np.uint64(40)) + group[first])
    digest = (digest & ~np.uint64(LENGTH)) | np.minimum(length, LENGTH).astype(np.uint64)
    return digest, np.bincount(text[first], minlength=len(n))


def longest(digest: np.ndarray, chunks: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The `need` longest chunks of each text."""
    text = np.repeat(np.arange(len(chunks)), chunks)
    order = np.lexsort((digest, -(digest & np.uint64(LENGTH)).astype(np.int64), text))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    kept = order[rank < np.repeat(need, chunks)]
    return digest[kept], np.minimum(chunks, need)


def distinct_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words of all texts, sorted by text and hash; first of each text that has any; their number; the text)."""
    h, t = npwords.words(texts)
    order = np.lexsort((h, t))
    hs, ts = h[order], t[order]
    keep = np.append(True, (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1]))[: len(hs)]
    hs, ts = hs[keep], ts[keep]
    begin = np.flatnonzero(np.diff(ts, prepend=-1))
    return hs, begin, np.diff(np.append(begin, len(hs))), ts[begin]


def signature(hs: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, second hash, sketch) of each text; a sketch is 56 parity bits, then the number of words up to 255."""
    cls = npwords.mix(np.add.reduceat(npwords.mix(hs + npwords.MULT), begin) + n.astype(np.uint64))
    chk = npwords.mix(np.add.reduceat(npwords.mix(npwords.mix(hs) ^ np.uint64(0x5BD1E9955BD1E995)), begin) ^ n.astype(np.uint64))
    bits = np.bitwise_xor.reduceat(np.uint64(1) << ((hs >> np.uint64(20)) % np.uint64(56)), begin)
    return cls, chk, (bits << np.uint64(8)) | np.minimum(n, 255).astype(np.uint64)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values.view(np.int64)))


def profiler(every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, ev, texts...) -> PROFILE.  own: chunks of a text cut for its own band; probe: chunks of an evaluation text cut for the
    bands of its partners, the d + 1 longest of each or, if `every`, all; rest: whether some band gives fewer than d + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ev = batch.column(0), batch.column(1)
            is_ev = np.array(ev.to_pylist(), bool)
            for f in range(2, batch.num_columns):
                hs, begin, n, row = distinct_words(batch.column(f).to_pylist())
                if not len(hs):
                    continue
                cls, chk, sketch = signature(hs, begin, n)
                band = np.searchsorted(bands(), n, "right") - 1
                large = n > 3  # smaller sets match equal ones only
                here = np.flatnonzero(large & ~is_ev[row])
                own, own_n = np.empty(0, np.uint64), np.zeros(len(n), np.int64)
                if len(here):
                    own, own_n[here] = chunked(hs, begin[here], n[here], band[here])
                each = np.flatnonzero(large & is_ev[row])
                probes, probe_n, rest = [], np.zeros((3, len(n)), np.int64), np.zeros(len(n), bool)
                order = []
                for k, step in enumerate((-1, 0, 1)):
                    d = most_differing(n[each], band[each] + step)
                    use = (d >= 0) & (band[each] + step >= 3)
                    at, need = each[use], d[use] + 1
                    if not len(at):
                        continue
                    digest, count = chunked(hs, begin[at], n[at], band[at] + step)
                    rest[at] |= count < need
                    if not every:
                        digest, count = longest(digest, count, need)
                    probes.append(digest)
                    order.append(np.repeat(at * 3 + k, count))
                    probe_n[k, at] = count
                probe = np.concatenate(probes)[np.argsort(np.concatenate(order), kind="stable")] if probes else np.empty(0, np.uint64)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls.view(np.int64)), pa.array(chk.view(np.int64)), ids.take(rows), pa.array(np.full(len(n), f - 2, np.int32)), ev.take(rows), pa.array(sketch.view(np.int64)),
                     _lists(own, own_n), _lists(probe, probe_n.sum(axis=0)), pa.array(rest)],
                    names=["cls", "chk", "id", "field", "ev", "sketch", "own", "probe", "rest"],
                )

    return run


def _size(sketch: str) -> F.Column:
    return F.col(sketch).bitwiseAND(255)


def _may() -> F.Column:
    """Whether texts with sketches sa and sb may reach the threshold."""
    most = (_size("sa") + _size("sb")) * ((1 - THRESHOLD) / (1 + THRESHOLD)) + 1e-9
    return (F.bit_count(F.shiftrightunsigned(F.col("sa").bitwiseXOR(F.col("sb")), 8)) <= most) & (F.abs(_size("sa") - _size("sb")) <= most) | (_size("sa") == 255) | (_size("sb") == 255)


def _near(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, shared): classes of evaluation and of training rows that share a chunk looked up and may reach the threshold, and the words of such chunks."""
    total = classes.agg(F.sum(F.col("n_ev") + F.col("n_tr"))).first()[0] or 0
    least = max(2.0, REPEATED * total)
    out = texts
    for side, ev in (("ev", "ev"), ("tr", "not ev")):
        often = F.broadcast(classes.where(F.col(f"n_{side}") >= least).select("cls", "chk", F.col(f"{side}_id").alias(f"r_{side}"), F.col(f"{side}_field").alias(f"f_{side}")))
        out = out.join(often, ["cls", "chk"], "left").where(f"not ({ev}) or r_{side} is null or (r_{side} = id and f_{side} = field)").drop(f"r_{side}", f"f_{side}")
    probe = out.where("ev").select(F.col("cls").alias("a"), F.col("sketch").alias("sa"), F.explode("probe").alias("digest"))
    own = out.where("not ev").select(F.col("cls").alias("b"), F.col("sketch").alias("sb"), F.explode("own").alias("digest"))
    hits = own.join(probe.hint("merge"), "digest").where((F.col("a") != F.col("b")) & _may()).select("a", "b", "digest").distinct()
    return hits.groupBy("a", "b").agg(F.sum(F.col("digest").bitwiseAND(LENGTH)).alias("shared"))


def _word_rows(known: object | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(texts...) -> (cls, sketch, word) of the words of each text, only those in the sorted array `known` where one is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = None if known is None else known.value
        for batch in batches:
            for f in range(batch.num_columns):
                hs, begin, n, _ = distinct_words(batch.column(f).to_pylist())
                if not len(hs):
                    continue
                cls, _, sketch = signature(hs, begin, n)
                text = np.repeat(np.arange(len(n)), n)
                if want is not None:
                    at = np.minimum(np.searchsorted(want, hs), len(want) - 1)
                    hit = want[at] == hs
                    hs, text = hs[hit], text[hit]
                yield pa.RecordBatch.from_arrays([pa.array(cls[text].view(np.int64)), pa.array(sketch[text].view(np.int64)), pa.array(hs.view(np.int64))], names=["cls", "sketch", "word"])

    return run


def _near_by_word(tagged: DataFrame, texts: DataFrame, fields: tuple[str, ...]) -> DataFrame | None:
    """(a, b, shared) for the evaluation texts with too few chunks: every pair that shares one of d + 1 words and may reach the
    threshold.  Any d + 1 words do; those in the fewest evaluation texts are taken."""
    spark = tagged.sparkSession
    rest = texts.where("ev and rest").select("id", "cls")
    n = rest.limit(CHECK_ROWS + 1).count()
    if n == 0:
        return None
    bounded = lambda df: F.broadcast(df) if n <= CHECK_ROWS else df
    schema = "cls long, sketch long, word long"

    def known(words: DataFrame) -> object | None:
        """The words for the workers, where they are few enough."""
        if n > CHECK_ROWS or words.limit(CHECK_ROWS + 1).count() > CHECK_ROWS:
            return None
        return spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in words.collect()], np.int64).view(np.uint64)))

    def rows_of(side: DataFrame, words: DataFrame) -> DataFrame:
        few = known(words)
        out = side.select(*fields).mapInArrow(_word_rows(few), schema)
        return out if few is not None else out.join(words, "word", "left_semi")

    wide = tagged.where("ev").join(bounded(rest.select("id").distinct()), "id").select(*fields)
    ev = wide.mapInArrow(_word_rows(None), schema).join(bounded(rest.select("cls").distinct()), "cls", "left_semi").distinct()
    ev = materialise(ev.select(F.col("cls").alias("a"), F.col("sketch").alias("sa"), "word"), "rest")
    df = rows_of(tagged.where("ev"), ev.select("word").distinct()).groupBy("word").agg(F.count("*").alias("df"))
    most = F.floor(_size("sa") * ((1 / THRESHOLD + 1) * (1 - THRESHOLD) / (1 + THRESHOLD)) + 1e-9)  # of all bands
    order = F.sort_array(F.collect_list(F.struct("df", "word")))
    rare = ev.join(df, "word").groupBy("a", "sa").agg(order.alias("w")).select("a", "sa", F.explode(F.slice("w", F.lit(1), F.when(_size("sa") < 255, most + 1).otherwise(F.size("w")).cast("int"))).alias("w"))
    rare = materialise(rare.select("a", "sa", F.col("w.word").alias("word")), "rare")
    tr = rows_of(tagged.where("not ev"), rare.select("word").distinct()).select(F.col("cls").alias("b"), F.col("sketch").alias("sb"), "word")
    hits = tr.join(rare, "word").where((F.col("a") != F.col("b")) & _may())
    return hits.groupBy("a", "b").agg(F.lit(0).cast("long").alias("shared"))


def _words_of(rows: DataFrame, id_col: str, fields: tuple[str, ...], wanted: DataFrame) -> DataFrame:
    """Distinct words of the wanted (id, field) texts."""
    if wanted.limit(CHECK_ROWS + 1).count() <= CHECK_ROWS:
        wanted = F.broadcast(wanted)
    each = rows.select(F.col(id_col).alias("id"), F.posexplode(F.array(*fields)).alias("field", "text")).join(wanted, ["id", "field"])
    return each.select("id", "field", F.array_distinct(F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), lambda x: x != "")).alias("s"))


def matched(rows: DataFrame, id_col: str, split_col: str, fields: tuple[str, ...], every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, pairs): the texts with their classes, and all pairs (a, ac, b, bc, shared, size) of classes with evaluation and with
    training rows that reach the threshold; shared is the number of words in shared chunks, of those looked up, size that of the evaluation text."""
    ship(rows.sparkSession)
    tagged = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(split_col).isin(*EVAL), F.lit(False)).alias("ev"), *[F.col(f).alias(f"t{i}") for i, f in enumerate(fields)])
    texts = materialise(tagged.mapInArrow(profiler(every), PROFILE), "profile")
    side = lambda ev: [F.count_if(ev), F.min(F.when(ev, F.col("id"))), F.min_by("field", F.when(ev, F.col("id")))]
    cols = [c.alias(f"{x}_{s}" if x == "n" else f"{s}_{x}") for s, ev in (("ev", F.col("ev")), ("tr", ~F.col("ev"))) for x, c in zip(("n", "id", "field"), side(ev))]
    classes = materialise(texts.groupBy("cls", "chk").agg(*cols), "classes")
    near = _near(texts, classes)
    by_word = _near_by_word(tagged, texts, tuple(f"t{i}" for i in range(len(fields))))
    if by_word is not None:
        near = near.unionByName(by_word).groupBy("a", "b").agg(F.max("shared").alias("shared"))
    near = materialise(near, "near")
    reps = lambda c, s: classes.where(f"n_{s} > 0").select(F.col("cls").alias(c), F.col("chk").alias(f"{c}c"), F.col(f"{s}_id").alias(f"{c}_id"), F.col(f"{s}_field").alias(f"{c}_field"))
    cand = materialise(near.join(reps("a", "ev"), "a").join(reps("b", "tr"), "b"), "candidates")
    wanted = cand.select(F.col("a_id").alias("id"), F.col("a_field").alias("field")).union(cand.select("b_id", "b_field")).distinct()
    s = materialise(_words_of(rows, id_col, fields, wanted), "words")
    both = cand.join(s.withColumnsRenamed({"id": "a_id", "field": "a_field", "s": "wa"}), ["a_id", "a_field"]).join(s.withColumnsRenamed({"id": "b_id", "field": "b_field", "s": "wb"}), ["b_id", "b_field"])
    common = F.size(F.array_intersect("wa", "wb"))
    exact = both.where(common >= THRESHOLD * (F.size("wa") + F.size("wb") - common) - 1e-9).select("a", "ac", "b", "bc", "shared", F.size("wa").alias("size"))
    same = classes.where("n_ev > 0 and n_tr > 0").select(F.col("cls").alias("a"), F.col("chk").alias("ac"), F.col("cls").alias("b"), F.col("chk").alias("bc"), F.lit(1).cast("long").alias("shared"), F.lit(1).alias("size"))
    return texts, exact.unionByName(same)


def overlaps(rows: DataFrame, id_col: str, split_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(ev_id, tr_id) of all row pairs across the splits."""
    texts, pairs = matched(rows, id_col, split_col, fields)
    left = texts.where("ev").select(F.col("cls").alias("a"), F.col("chk").alias("ac"), F.col("id").alias("ev_id"))
    right = texts.where("not ev").select(F.col("cls").alias("b"), F.col("chk").alias("bc"), F.col("id").alias("tr_id"))
    return pairs.join(left, ["a", "ac"]).join(right, ["b", "bc"]).select("ev_id", "tr_id").distinct()


def report(rows: DataFrame, id_col: str, split_col: str, by: list[str], fields: tuple[str, ...]) -> DataFrame:
    """(*by, pairs, eval_rows, train_rows) of the evaluation rows by the columns `by`, counted over groups of rows with the same classes, not over row pairs."""
    texts, pairs = matched(rows, id_col, split_col, fields)
    pairs = materialise(pairs.select(F.struct("a", "ac").alias("a"), F.struct("b", "bc").alias("b")).distinct(), "pairs")
    cls = F.struct("cls", "chk")
    of = lambda ev, c: texts.where(ev).select("id", cls.alias(c)).join(pairs.select(c).distinct(), c, "left_semi").groupBy("id").agg(F.sort_array(F.collect_set(c)).alias("sig"))
    named = rows.select(F.col(id_col).alias("id"), *by)
    ev = materialise(of("ev", "a").join(named, "id").groupBy(*by, "sig").agg(F.count("*").alias("n_ev")), "evgroups")
    tr = materialise(of("not ev", "b").groupBy("sig").agg(F.count("*").alias("n_tr")), "trgroups")
    sides = ev.select(*by, F.col("sig").alias("ea"), "n_ev", F.explode("sig").alias("a")).join(pairs, "a").join(tr.select(F.col("sig").alias("tb"), "n_tr", F.explode("sig").alias("b")), "b")
    both = materialise(sides.select(*by, "ea", "n_ev", "tb", "n_tr").distinct(), "groups")
    out = both.groupBy(*by).agg(F.sum(F.col("n_ev") * F.col("n_tr")).alias("pairs"))
    e = both.select(*by, "ea", "n_ev").distinct().groupBy(*by).agg(F.sum("n_ev").alias("eval_rows"))
    t = both.select(*by, "tb", "n_tr").distinct().groupBy(*by).agg(F.sum("n_tr").alias("train_rows"))
    same = lambda x: [F.col(f"o.{c}").eqNullSafe(F.col(f"{x}.{c}")) for c in by]
    return out.alias("o").join(e.alias("e"), same("e")).join(t.alias("t"), same("t")).select(*[f"o.{c}" for c in by], "pairs", "eval_rows", "train_rows")


def fractions(rows: DataFrame, id_col: str, split_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(id, field, fraction) of the evaluation texts that reach the threshold with some training text: the largest part of the
    text's words that lies in chunks shared with one training text; every chunk is looked up."""
    texts, pairs = matched(rows, id_col, split_col, fields, every=True)
    best = pairs.groupBy("a", "ac").agg(F.max(F.col("shared") / F.col("size")).alias("fraction"))
    each = texts.where("ev").select("id", "field", F.col("cls").alias("a"), F.col("chk").alias("ac"))
    return each.join(best, ["a", "ac"]).select("id", F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1).alias("field"), "fraction")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "paired_sp_train").select("line_no", "split", "source", "src", "trg")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlaps(_rows(spark, sf_dir), "line_no", "split", ("src", "trg"))
    return pairs.select(F.least("ev_id", "tr_id").alias("line_a"), F.greatest("ev_id", "tr_id").alias("line_b"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split and source of the evaluation row: overlapping pairs, evaluation rows and training rows."""
    return report(_rows(spark, sf_dir), "line_no", "split", ["split", "source"], ("src", "trg"))


def p5_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each evaluation text with a case and the part of its words in chunks shared with one training text."""
    return fractions(_rows(spark, sf_dir), "line_no", "split", ("src", "trg")).select(F.col("id").alias("line_no"), "field", F.round("fraction", 6).alias("fraction"))
