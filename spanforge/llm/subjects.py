"""Problem 9: subject areas of each document, in whatever language.

Anchored non-negative factorisation.  The document-term matrix is factored as W H with one component for each subject and one
for everything else.  H is seeded from the documents that annotators labelled and W and H are then updated in turn over all
documents: W by the multiplicative rule of the Kullback-Leibler loss with H fixed, H by the subject mixture of the documents
that a term stands in (leaning to the part the term has already), so terms nobody labelled take their subject from their documents.  The anchor holds in every round: a
component gets of a term what its share exceeds the subject's share of the labels by (LEAN of the rest of the way to 1), and
everything else gets the remainder, so words of no subject and the words of one language stay outside, however frequent they are.

Every term of every document takes part; rare terms are drawn to the common shares (PRIOR occurrences), none is cut.  Terms
are 64-bit hashes, so there is no vocabulary to hold; only terms with a part in some subject are handed to the workers, as
long as a count proves at most MAX_ACTIVE of them, and are joined beyond.  Terms without such a part are alike for W and enter
it as one number a document.  Rounds end when the parts change by less than SETTLED in all (at most MAX_ROUNDS).

The result is read off W: with H fixed, each sentence's W says what part of it each subject explains; a sentence is about the
subject with the largest part if that comes to at least half a term, and a document about the subjects of at least a fifth of
its sentences.

Seeds are taken from at most MAX_LABELLED labelled documents, chosen by hash (a documented bound on fitting); factorisation
and result cover all documents.

Defined results: null, empty and blank texts and texts without sentences (LEAST_WORDS words) have no subject; unknown,
null and oddly spelled labels are trimmed and lower-cased or left out; repeated labels count once; ties go to the subject
first in the alphabet; repeated rows come out each; without labels, or with a single subject, no document has a subject.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.common import materialise, ship, table
from spanforge.llm import npwords

LEAST_WORDS = 4
LEAST_PART = 0.2
MAX_LABELLED = 200_000
LEAN = 0.35
PRIOR = 4.0
SETTLED, MAX_ROUNDS, INNER = 0.01, 10, 6
OWN = 0.3
FLOOR, OTHER = 1e-4, 0.02  # least part of a term that a subject and everything else has
MAX_ACTIVE = 300_000
PIECE = 1 << 19  # characters that are cut at once
# a word is a run of letters; a sentence ends at a stop before a blank or closing mark, at a line end and at three bars
LETTER, STOP, LINE, BAR, AFTER = 1, 2, 4, 8, 16
KINDS = {LETTER: r"[^\W\d_]+", STOP: "[.!?]+", LINE: r"[\r\n]+", BAR: r"\|", AFTER: r"[\s\"»”“)]+"}


@lru_cache(1)
def kinds() -> np.ndarray:
    """For each code point, the kinds it is of."""
    every = np.arange(0x110000, dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    out = np.zeros(len(every), np.uint8)
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, every):
            out[m.start() : m.end()] |= kind
    return out


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text and number of words of each sentence, hash of each word in order); words are lower-cased, a sentence has LEAST_WORDS at least."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[codes]
    ok = (kind & LETTER).view(bool)
    edge = np.flatnonzero(np.diff(ok, prepend=False))  # the last one is a line end
    start, size = edge[::2], edge[1::2] - edge[::2]
    stop = np.flatnonzero(kind & (STOP | LINE | BAR))
    here, one, two = kind[stop], kind[np.minimum(stop + 1, len(kind) - 1)], kind[np.minimum(stop + 2, len(kind) - 1)]
    stop = stop[(here & LINE > 0) | (here & STOP > 0) & (one & AFTER > 0) | (here & one & two & BAR > 0)]
    count = np.diff(np.searchsorted(start, stop), prepend=0)  # words before each end of a sentence
    use = count >= LEAST_WORDS
    of = np.searchsorted(np.fromiter(accumulate(len(t) + 1 for t in low), np.int64, len(low)) - 1, stop[use])
    if not len(of):
        return of, count[use], np.empty(0, np.int64)
    at = np.cumsum(size) - size
    power = np.cumprod(np.full(int(size.max()) + 1, npwords.MULT, np.uint64))
    h = np.add.reduceat((codes[ok].astype(np.uint64) + np.uint64(1)) * power[np.arange(int(size.sum())) - np.repeat(at, size)], at) + power[size]
    return of, count[use], npwords.mix(h[np.repeat(use, count)]).view(np.int64)


def labels(subject_labels: DataFrame, subjects: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc_id, ks): indexes of the subjects each labelled document was given, and the subjects in order."""
    names = sorted(r[0] for r in subjects.select("subject").where("subject is not null").distinct().collect())  # the fixed table of areas
    clean = F.lower(F.trim("subject"))
    k = F.array_position(F.array(*[F.lit(n.lower()) for n in names]) if names else F.array().cast("array<string>"), clean) - 1
    ks = subject_labels.select("doc_id", k.cast("int").alias("k")).where("doc_id is not null and k >= 0").groupBy("doc_id").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    n = ks.count()
    return (ks if n <= MAX_LABELLED else ks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * MAX_LABELLED / n * 0.98))), names


def tokenise(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sent, terms): sentences of each document, and the sentence and hash of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            piece = np.fromiter(accumulate(map(len, texts)), np.int64, len(texts)) // PIECE
            for begin, end in zip(first := np.flatnonzero(np.diff(piece, prepend=-1)), [*first[1:], len(texts)]):
                of, count, h = cut(texts[begin:end])
                if not len(of):
                    continue
                n = np.bincount(of)
                rows = np.flatnonzero(n)
                number = np.arange(len(of)) - (np.cumsum(n) - n)[of]  # of the sentence in its text
                offsets = pa.array(np.append(0, np.cumsum(np.bincount(of, count)[rows])).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(begin + rows)), pa.array(n[rows].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(np.repeat(number, count).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(h))],
                    names=["doc_id", "n", "sent", "terms"])

    return docs.select("doc_id", "text").where("text is not null").mapInArrow(run, "doc_id long, n int, sent array<int>, terms array<long>")


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the entries of a list column, its different values, place of each entry's value among them)."""
    coded = col.flatten().dictionary_encode()
    return np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy())), coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _sums(terms: np.ndarray, at: np.ndarray, n: np.ndarray | None, values: Iterator[np.ndarray], extra: np.ndarray) -> pa.RecordBatch:
    """(term, n, c0..): sum of n (1 if None) and of the values (an array for each subject) of the entries of each term, and a row without a term of extra = (n, c0..)."""
    cols = [np.bincount(at, x, len(terms)).astype(float) for x in (n, *values)]
    there = cols[0] > 0
    arrays = [pa.array([*terms[there].tolist(), None], pa.int64()), *(pa.array(np.append(c[there], x)) for c, x in zip(cols, extra))]
    return pa.RecordBatch.from_arrays(arrays, names=["term", "n", *(f"c{k}" for k in range(len(cols) - 1))])


def _sum_schema(k: int) -> str:
    return "term long, n double, " + ", ".join(f"c{i} double" for i in range(k))


def seeds(tokens: DataFrame, ks: DataFrame, k: int) -> DataFrame:
    """(term, n, c0..) over the labelled documents: how many hold a term, and how many of those each subject has (a document of several subjects is divided)."""
    labelled = tokens.join(F.broadcast(ks), "doc_id").select("terms", "ks")  # at most MAX_LABELLED rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = np.zeros((b.num_rows, k))
            for i, of in enumerate(b.column(1).to_pylist()):
                m[i, of] = 1 / len(of)
            doc, own, at = _flat(b.column(0))
            doc, at = np.divmod(np.unique(doc * len(own) + at), max(len(own), 1))
            yield _sums(own, at, None, (m[doc, j] for j in range(k)), np.append(b.num_rows, m.sum(axis=0)))

    return labelled.mapInArrow(run, _sum_schema(k))


def parts(sums: DataFrame, k: int, prior: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """((term, n, p0..), shares of the subjects): the part of each term that each subject gets, for terms that have any; the shares of the labels stay the measure."""
    sums = materialise(sums.groupBy("term").agg(F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]), "terms")
    if prior is None:
        all_ = sums.where("term is null").first()  # one row
        prior = np.array([all_[f"c{i}"] for i in range(k)]) / max(all_["n"], 1e-9) if all_ else np.zeros(k)

    def part(i: int) -> Column:
        least = prior[i] + LEAN * (1 - prior[i])
        share = (F.col(f"c{i}") + PRIOR * float(prior[i])) / (F.col("n") + PRIOR)
        return F.greatest((share - float(least)) / float(1 - least), F.lit(0.0)) if least < 1 else F.lit(0.0)

    out = sums.where("term is not null").select("term", "n", *[part(i).alias(f"p{i}") for i in range(k)])
    return materialise(out.where(" or ".join(f"p{i} > 0" for i in range(k))), "parts"), prior


class Components:
    """H in the form the workers need: the ratio of every component for each term with a part in a subject, and for all others."""

    def __init__(self, terms: np.ndarray, n: np.ndarray, p: np.ndarray, tokens: float):
        order = np.argsort(terms)
        self.terms, p, n = terms[order], p[order], n[order]
        other = np.maximum(1 - p.sum(axis=1), OTHER)
        mass = np.append(((p + FLOOR) * n[:, None]).sum(axis=0) + FLOOR * max(tokens - n.sum(), 0) + 1e-9, (other * n).sum() + max(tokens - n.sum(), 0) + 1e-9)
        self.mass = mass
        self.u = np.hstack([p + FLOOR, other[:, None]]) / mass
        self.rest = np.append(np.full(p.shape[1], FLOOR), 1.0) / mass

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term, -1 for one without a part in a subject."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)


def mixtures(row: np.ndarray, u: np.ndarray, rest_u: np.ndarray, size: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, W): the mixture of each row that has terms with a part in a subject; `row` and `u` are the sorted row and the ratios of each such term, size the terms of all rows."""
    if not len(row):
        return np.empty(0, np.int64), np.empty((0, len(rest_u)))
    first = np.flatnonzero(np.diff(row, prepend=-1))
    count = np.diff(np.append(first, len(row)))
    at = row[first]
    rest = size[at] - count
    u = np.ascontiguousarray(u.T)
    w = np.full((len(rest_u), len(first)), 1 / len(rest_u))
    for _ in range(rounds):
        each = 1 / sum(np.repeat(x, count) * y for x, y in zip(w, u))
        o = w * rest_u[:, None]
        w = w * np.stack([np.add.reduceat(y * each, first) for y in u]) + rest * o / o.sum(axis=0)
        w /= w.sum(axis=0)
    return at, w.T


def _with_ratios(tokens: DataFrame, active: DataFrame, k: int, total: float) -> tuple[DataFrame, object | None]:
    """(tokens with a column `known`, components for the workers): where there are too many active terms for a broadcast, each
    document gets the parts of its own terms by a join and builds the components from them and the totals."""
    n = active.limit(MAX_ACTIVE + 1).count()
    if n <= MAX_ACTIVE:
        rows = active.collect()  # at most MAX_ACTIVE, counted above
        p = np.array([[r[f"p{i}"] for i in range(k)] for r in rows]).reshape(len(rows), k)
        h = Components(np.array([r["term"] for r in rows], np.int64), np.array([r["n"] for r in rows]), p, total)
        return tokens.withColumn("known", F.lit(None).cast("array<struct<term:bigint,u:array<double>>>")), tokens.sparkSession.sparkContext.broadcast(h)
    other = F.greatest(1 - sum(F.col(f"p{i}") for i in range(k)), F.lit(OTHER))
    mass = active.agg(F.sum("n").alias("n"), *[F.sum((F.col(f"p{i}") + FLOOR) * F.col("n")).alias(f"m{i}") for i in range(k)], F.sum(other * F.col("n")).alias("mo")).first()
    left = max(total - mass["n"], 0)
    m = np.array([*(mass[f"m{i}"] + FLOOR * left for i in range(k)), mass["mo"] + left + 1e-9])
    u = F.array(*[(F.col(f"p{i}") + FLOOR) / float(m[i]) for i in range(k)], other / float(m[k]))
    h = Components(np.empty(0, np.int64), np.empty(0), np.empty((0, k)), total)
    h.mass, h.rest = m, np.append(np.full(k, FLOOR), 1.0) / m
    numbered = materialise(tokens.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    own = numbered.select("_row", F.explode(F.array_distinct("terms")).alias("term")).join(active.select("term", u.alias("u")), "term")
    own = own.groupBy("_row").agg(F.collect_list(F.struct("term", "u")).alias("known"))  # terms of one document
    return numbered.join(own, "_row", "left").drop("_row"), tokens.sparkSession.sparkContext.broadcast(h)


def _ratios(h: Components, doc: np.ndarray, own: np.ndarray, at: np.ndarray, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(entries with a part in a subject, their ratios); own: the different terms, at: the place of each entry's among them."""
    if known.null_count == len(known):
        place = h.find(own)[at]
        hit = np.flatnonzero(place >= 0)
        return hit, h.u[place[hit]]
    pairs = {(i, e["term"]): e["u"] for i, of in enumerate(known.to_pylist()) for e in of or ()}
    term = own[at]
    hit = np.array([j for j, x in enumerate(zip(doc.tolist(), term.tolist())) if x in pairs], np.int64)
    return hit, np.array([pairs[x] for x in zip(doc[hit].tolist(), term[hit].tolist())]).reshape(len(hit), len(h.rest))


def update(tokens: DataFrame, active: DataFrame, k: int, total: float) -> DataFrame:
    """(term, n, c0..) over all documents: W with H fixed, then the subject mixture of its documents for every term."""
    rows, shared = _with_ratios(tokens, active, k, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for b in batches:
            doc, own, place = _flat(b.column(0))
            if not len(doc):
                continue
            hit, u = _ratios(h, doc, own, place, b.column(1))
            size = np.bincount(doc, minlength=b.num_rows)
            at, w = mixtures(doc[hit], u, h.rest, size, INNER)
            says = w[:, :k].sum(axis=1) * size[at] >= 0.5
            at, w = at[says], w[says, :k]
            m = np.zeros((k, b.num_rows))
            m[:, at] = (w / w.sum(axis=1, keepdims=True)).T
            use = np.zeros(b.num_rows)
            use[at] = 1
            lean = [m[j, doc[hit]] * (u[:, j] * h.mass[j] + OWN) for j in range(k)]  # a term with a part of its own leans to it within its document
            all_ = sum(lean)
            all_[all_ == 0] = 1  # documents without a subject

            def value(j: int) -> np.ndarray:
                each = np.repeat(m[j], size)
                each[hit] = lean[j] / all_
                return each

            yield _sums(own, place, np.repeat(use, size), map(value, range(k)), np.append(len(at), m.sum(axis=1)))

    return rows.select("terms", "known").mapInArrow(run, _sum_schema(k))


def factored(tokens: DataFrame, ks: DataFrame, k: int) -> tuple[DataFrame, float, list[float]]:
    """(parts, number of terms in all, change in each round): H after the rounds."""
    total = float(tokens.agg(F.sum(F.size("terms"))).first()[0] or 0)
    active, prior = parts(seeds(tokens, ks, k), k)
    changes: list[float] = []
    while len(changes) < MAX_ROUNDS:
        new, _ = parts(update(tokens, active, k, total), k, prior)
        zero = lambda side, i: F.coalesce(f"{side}.p{i}", F.lit(0.0))
        both = active.alias("a").join(new.alias("b"), "term", "full_outer")
        d = both.agg(sum(F.sum(F.abs(zero("a", i) - zero("b", i))) for i in range(k)).alias("d"), sum(F.sum(zero("a", i)) for i in range(k)).alias("s")).first()
        changes.append((d["d"] or 0.0) / max(d["s"] or 0.0, 1e-9))
        active = new
        if changes[-1] < SETTLED:
            break
    return active, total, changes


def shares(docs: DataFrame, subject_labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, sentences, subject, part): share of the document's sentences about each subject it has sentences of."""
    spark = docs.sparkSession
    ship(spark)
    ks, names = labels(subject_labels, subjects)
    k = len(names)
    schema = "doc_id long, sentences int, subject string, part double"
    if k < 2:
        return spark.createDataFrame([], schema)
    tokens = materialise(tokenise(docs), "tokens")
    active, total, _ = factored(tokens, ks, k)
    rows, shared = _with_ratios(tokens, active, k, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for b in batches:
            doc, own, place = _flat(b.column(3))
            if not len(doc):
                continue
            sent = b.column(2).flatten().to_numpy()
            key = np.cumsum(np.append(0, (doc[1:] != doc[:-1]) | (sent[1:] != sent[:-1])))  # sentences of the batch
            hit, u = _ratios(h, doc, own, place, b.column(4))
            size = np.bincount(key)
            at, w = mixtures(key[hit], u, h.rest, size, 2 * INNER)
            best = w[:, :k].argmax(axis=1)
            says = w[np.arange(len(at)), best] * size[at] >= 0.5
            row = doc[np.flatnonzero(np.diff(key, prepend=-1))][at[says]]
            pair, count = np.unique(row * k + best[says], return_counts=True)
            n = b.column(1).to_numpy()[pair // k]
            take = pa.array(pair // k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(n), pa.array([names[i] for i in pair % k], pa.string()), pa.array(count / n)], names=["doc_id", "sentences", "subject", "part"])

    return rows.select("doc_id", "n", "sent", "terms", "known").mapInArrow(run, schema)


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir).where(F.col("part") >= LEAST_PART - 1e-9).select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sentences of each subject over the corpus."""
    s = _shares(spark, sf_dir).where(F.col("part") >= LEAST_PART - 1e-9)
    return s.groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.sum(F.col("part") * F.col("sentences"))).cast("long").alias("sentences"))
