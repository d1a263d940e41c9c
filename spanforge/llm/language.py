"""Problem 2: language of each text and of each segment of a mixed one.

Rank-order profiles: the most frequent character n-grams of a segment, by rank, are compared with those of each language
by out-of-place distance.  A text is cut into segments at sentence and clause marks, brackets and quotation marks; all
segments of an Arrow slice are ranked and compared together in numpy, without a loop over texts.  Neighbouring segments
of one language are one; a segment with too few words or too small a lead takes the language of the rest of its text.

n-grams in no profile are out of place for every language alike and are left out.  Profiles are fitted on the fixed
table of clean samples (PROFILE n-grams a language).

Defined results: null, empty and blank texts have no language; texts without running words (fewer than LEAST_WORDS words or
LEAST_GRAMS known n-grams) have one of little confidence in p2_segments, none if no n-gram is known, and are no case; ties go to the language first in the alphabet; texts of any length are ranked whole; repeated rows come out
each; an empty sample table gives no languages and no rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.common import materialise, ship, table
from spanforge.llm import npwords

PROFILE = 700
LEAST_WORDS = 4
LEAD = 0.15  # least relative lead over the second language for a segment to count by itself
LEAST_GRAMS = 30  # least distinct n-grams of such a segment, which a word said over and over does not have
UNCLEAR = 0.22  # a segment of many words with a lead below this is looked at again in windows of WINDOW words
WINDOW = 8
SWITCH = 20.0  # log-odds that another language must have over a run of words of a segment to be looked at there
BOTH = 12  # letters of each of two scripts from which a segment is looked at again too
DELIMITERS = ".!?;:()[]{}\"„“”«»‹›–—|/*\n\r•"
SLICE = 2000
SKIP, CUT = 65535, 65534
RESULT = "field string, langs array<struct<lang: string, start: int, end: int, confidence: double>>"


class Profiles:
    """Character classes, n-gram ids and the rank of each n-gram in each language."""

    def __init__(self, samples: list[tuple[str, str]]):
        samples = [(lang, t.lower()) for lang, t in samples if lang and t]
        letters = sorted({c for _, t in samples for c in t if unicodedata.category(c)[0] == "L"})
        self.langs = sorted({lang for lang, _ in samples})
        self.letters, self.base = letters, len(letters) + 1
        self.cyrillic = np.array([False, *("Ѐ" <= c <= "ӿ" for c in letters)])
        no = {c: i + 1 for i, c in enumerate(letters)}
        counts = {lang: Counter() for lang in self.langs}
        for lang, t in samples:
            for w in "".join(c if c in no else " " for c in t).split():
                s = [0, *(no[c] for c in w), 0]
                counts[lang].update((a, b, c) for a, b, c in zip(s, s[1:], s[2:]))
                counts[lang].update((a, b) for a, b in zip(s[1:-1], s[2:-1]))
        tops = {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]] for lang, c in counts.items()}
        grams = sorted({g for top in tops.values() for g in top})
        self.ranks = np.full((len(grams), max(1, len(self.langs))), PROFILE, np.int32)
        ids = {g: i for i, g in enumerate(grams)}
        for k, lang in enumerate(self.langs):
            for r, g in enumerate(tops[lang]):
                self.ranks[ids[g], k] = r
        n = self.base
        self.logp = np.ascontiguousarray(-np.log(self.ranks.T + 20.0))  # of an n-gram in a language, falling with its rank
        # n-gram ids by sorted key; keys of bigrams follow those of trigrams
        key = lambda g: (g[0] * n + g[1]) * n + g[2] if len(g) == 3 else n**3 + g[0] * n + g[1]
        keys = np.array([key(g) for g in grams], np.int64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int32)
        self.dense = None
        if n <= 200:  # a table of all keys is small then
            self.dense = np.full(n**3 + n * n, -1, np.int32)
            self.dense[self.keys] = self.ids

    def lookup(self, key: np.ndarray) -> np.ndarray:
        """Id of each n-gram key, -1 for n-grams of no profile."""
        if self.dense is not None:
            return self.dense[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], -1)

    @lru_cache(1)  # noqa: B019
    def classes(self) -> np.ndarray:
        """Class of each code point: letter number, SKIP for marks and invisible characters, CUT for delimiters, 0 for the rest."""
        out = np.zeros(sys.maxunicode + 1, np.uint16)
        no = {c: i + 1 for i, c in enumerate(self.letters)}
        for c in [*range(0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800)]:
            ch = chr(c)
            plain = unicodedata.normalize("NFKC", ch).lower()
            if plain in no:
                out[c] = no[plain]
            elif unicodedata.category(ch) in ("Mn", "Cf"):
                out[c] = SKIP
        for c in DELIMITERS:
            out[ord(c)] = CUT
        out[0] = CUT
        return out

    def segments(self, texts: list[str | None], cuts: dict[int, list[int]] | None = None) -> tuple[np.ndarray, ...]:
        """cuts: gets the places where the language changes inside a segment, by number of the segment.

        (text, start, end, words, distinct n-grams, distances, whether it has letters of two scripts) of each segment that has n-grams of some profile; start and end in code points of the lower-cased text."""
        codes = npwords.joined(texts)
        cl = self.classes()[codes]
        text_no = np.cumsum(codes == 0) - (codes == 0)
        where = np.flatnonzero(cl != SKIP)
        cl = cl[where]
        seg = np.cumsum(cl == CUT)
        letter = (cl > 0) & (cl < CUT)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[:-1] |= letter[1:]
        s = np.where(letter, cl, 0)[keep].astype(np.int64)
        at, sg = where[keep], seg[keep]
        if len(s) < 3 or not self.langs:
            e = np.empty(0, np.int64)
            return e, e, e, e, e, np.empty((0, 1)), e.astype(bool)
        n, mid = self.base, s[1:-1] != 0
        ids = self.lookup(np.concatenate([((s[:-2] * n + s[1:-1]) * n + s[2:])[mid], (n**3 + s[:-1] * n + s[1:])[(s[:-1] != 0) & (s[1:] != 0)]]))
        sgs = np.concatenate([sg[1:-1][mid], sg[:-1][(s[:-1] != 0) & (s[1:] != 0)]])
        hit = ids >= 0
        key = np.sort(sgs[hit].astype(np.int64) << 20 | ids[hit])
        if not len(key):
            e = np.empty(0, np.int64)
            return e, e, e, e, e, np.empty((0, 1)), e.astype(bool)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(np.append(first, len(key)))
        key = key[first]
        if count.max() <= 0xFFF:
            key = np.sort((key >> 20) << 32 | (0xFFF - count) << 20 | key & 0xFFFFF)
            sid, gid = key >> 32, key & 0xFFFFF
        else:
            order = np.lexsort((key & 0xFFFFF, -count, key >> 20))
            sid, gid = key[order] >> 20, key[order] & 0xFFFFF
        begin = np.flatnonzero(np.diff(sid, prepend=-1))
        rank = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
        kept = rank < PROFILE
        gap = np.abs(self.ranks[gid] - rank[:, None].astype(np.int32)) * kept[:, None]
        grams = np.add.reduceat(kept.astype(np.int32), begin)
        dist = np.add.reduceat(gap, begin, axis=0) / grams[:, None]
        own = sid[begin]
        word = np.flatnonzero((s[:-1] == 0) & (s[1:] != 0)) + 1
        if s[0] != 0:
            word = np.append(0, word)
        words = np.bincount(sg[word], minlength=int(seg[-1]) + 2)[own]
        let = s != 0
        lo = np.searchsorted(sg[let], own, "left")
        hi = np.searchsorted(sg[let], own, "right") - 1
        start, end = at[let][lo], at[let][hi] + 1
        zero = np.append(-1, np.flatnonzero(codes == 0))
        t = text_no[start]
        cyr = np.bincount(sg, self.cyrillic[s], minlength=int(seg[-1]) + 2)[own]
        if cuts is not None:
            pos = np.concatenate([np.flatnonzero(mid) + 1, np.flatnonzero((s[:-1] != 0) & (s[1:] != 0))])
            cuts |= self._changes(ids[hit], pos[hit], word, sg, own, words, at - zero[text_no[at]] - 1)
        both = (cyr >= BOTH) & (np.bincount(sg, let, minlength=int(seg[-1]) + 2)[own] - cyr >= BOTH)
        return t, start - zero[t] - 1, end - zero[t] - 1, words, grams, dist, both

    def _changes(self, ids: np.ndarray, pos: np.ndarray, word: np.ndarray, sg: np.ndarray, own: np.ndarray, words: np.ndarray, place: np.ndarray) -> dict[int, list[int]]:
        """Places in the text at which the language changes, of each segment of more than one window in which some run of
        words, at any word, speaks for another language than the rest; words are compared one by one there."""
        long = np.zeros(int(sg[-1]) + 2, bool)
        long[own[words > WINDOW]] = True
        start = word[long[sg[word]]]
        if not len(start) or len(self.langs) < 2:
            return {}
        use = long[sg[pos]]
        at = np.searchsorted(start, pos[use], "right") - 1
        each = np.stack([np.bincount(at, lp[ids[use]], minlength=len(start)) for lp in self.logp], axis=1)  # words x languages
        seg = sg[start]
        first = np.flatnonzero(np.diff(seg, prepend=-1))
        size = np.diff(np.append(first, len(seg)))
        main = np.add.reduceat(each, first, axis=0).argmax(axis=1)
        lead = each - np.take_along_axis(each, np.repeat(main, size)[:, None], axis=1)
        run = np.concatenate([np.zeros((1, lead.shape[1])), np.cumsum(lead, axis=0)])
        odd = np.zeros(len(first), bool)
        of = np.repeat(np.arange(len(first)), size)
        for n in (LEAST_WORDS, WINDOW):
            inside = np.flatnonzero(of[n - 1 :] == of[: len(of) - n + 1])
            odd[of[inside[(run[inside + n] - run[inside]).max(axis=1) > SWITCH]]] = True
        out = {}
        for k in np.flatnonzero(odd).tolist():
            a, b = int(first[k]), int(first[k] + size[k])
            best, back = each[a].copy(), []
            for i in range(a + 1, b):
                top = int(best.argmax())
                stay = best >= best[top] - SWITCH
                back.append((top, stay))
                best = np.where(stay, best, best[top] - SWITCH) + each[i]
            lang, found = int(best.argmax()), []
            for i in range(b - 1, a, -1):
                top, stay = back[i - a - 1]
                if not stay[lang]:
                    lang = top
                    found.append(int(place[start[i]]))
            if found:
                out[int(np.searchsorted(own, seg[a]))] = found[::-1]
        return out

    @staticmethod
    def _clauses(texts: list[str | None], parts: tuple[np.ndarray, ...], changes: dict[int, list[int]]) -> dict[int, list[int]]:
        """The changes without those around a piece of too few running words, as names of another language make."""
        out = {}
        for i, cuts in changes.items():
            t = texts[parts[0][i]].replace("\0", " ")
            low = t.lower()
            t = t if len(t) == len(low) else low
            kept: list[int] = []
            last = int(parts[1][i])
            for c in [*cuts, int(parts[2][i])]:
                words = re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", t[last:c])
                if sum(not w[0].isupper() or len(w) > 1 and w.isupper() for w in words) >= LEAST_WORDS:
                    kept.append(last)
                last = c
            if len(kept) > 1:
                out[i] = kept[1:]
        return out

    def _windows(self, texts: list[str | None], parts: tuple[np.ndarray, ...], unclear: np.ndarray, changes: dict[int, list[int]]) -> tuple[np.ndarray, ...]:
        """The parts with each unclear one replaced by its pieces between changes of language, or else by its windows of words."""
        t, start, end = parts[0], parts[1], parts[2]
        pieces, owner, offset = [], [], []
        for i in unclear.tolist():
            low = texts[t[i]].replace("\0", " ").lower()[start[i] : end[i]]
            at = [m.start() for m in re.finditer(r"\S+", low)]
            cuts = [0, *(c - int(start[i]) for c in changes[i]), len(low)] if i in changes else [*at[::WINDOW], len(low)]
            if i not in changes and len(at) % WINDOW and len(at) % WINDOW < WINDOW // 2 and len(cuts) > 2:
                del cuts[-2]  # a short last window goes to the one before
            for x, y in zip(cuts, cuts[1:]):
                pieces.append(low[x:y])
                owner.append(i)
                offset.append(x)
        own, off = np.array(owner), np.array(offset)
        k, s, e, *rest = self.segments(pieces)
        new = (t[own[k]], start[own[k]] + off[k] + s, start[own[k]] + off[k] + e, *rest)
        left = np.ones(len(t), bool)
        left[unclear] = False
        out = [np.concatenate([a[left], b]) for a, b in zip(parts, new)]
        order = np.lexsort((out[1], out[0]))
        return tuple(a[order] for a in out)

    @staticmethod
    def _leads(dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best language, relative lead over the second) of each row."""
        best = dist.argmin(axis=1)
        if dist.shape[1] < 2:
            return best, np.ones(len(dist))
        two = np.partition(dist, 1, axis=1)
        return best, (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1e-9)

    def label(self, texts: list[str | None], every: bool = False) -> list[list[tuple[str, int, int, float]] | None]:
        """Runs of one language in each text; every: also of texts without running words, with less confidence."""
        out: list[list | None] = [None] * len(texts)
        changes: dict[int, list[int]] = {}
        parts = self.segments(texts, changes)
        if not len(parts[0]):
            return out
        changes = self._clauses(texts, parts, changes)
        again = (parts[3] >= 2 * WINDOW) & ((self._leads(parts[5])[1] < UNCLEAR) | parts[6])
        again[list(changes)] = True
        unclear = np.flatnonzero(again)
        if len(unclear):
            parts = self._windows(texts, parts, unclear, changes)
        t, start, end, words, grams, dist, _ = parts
        best, lead = self._leads(dist)
        sure = (words >= LEAST_WORDS) & (grams >= LEAST_GRAMS) & (lead >= LEAD)
        first = np.flatnonzero(np.diff(t, prepend=-1))
        last = np.append(first[1:], len(t))
        total, variety = np.add.reduceat(words, first), np.add.reduceat(grams, first)
        # language of the whole: least distance over all segments of the text, weighted by their n-grams
        main, main_lead = self._leads(np.add.reduceat(dist * grams[:, None], first, axis=0) / variety[:, None])
        one = np.minimum.reduceat(np.where(sure, best, 999), first), np.maximum.reduceat(np.where(sure, best, -1), first)
        langs, final = self.langs, last - 1
        rows = zip(t[first].tolist(), first.tolist(), last.tolist(), total.tolist(), variety.tolist(), main.tolist(), main_lead.tolist(), one[0].tolist(), one[1].tolist(), start[first].tolist(), end[final].tolist())
        for k, a, b, n, v, m, c, lo, hi, x, y in rows:
            if n < LEAST_WORDS or v < LEAST_GRAMS:
                if every:
                    out[k] = [(langs[m], x, y, c * min(1.0, n / LEAST_WORDS) * min(1.0, v / LEAST_GRAMS) / 2)]
                continue
            if lo >= hi or hi < 0:
                out[k] = [(langs[hi if hi >= 0 else m], x, y, c)]
                continue
            runs: list[list] = []
            prev = next(int(best[i]) for i in range(a, b) if sure[i])
            for i in range(a, b):
                prev = int(best[i]) if sure[i] else prev
                if runs and runs[-1][0] == prev:
                    runs[-1][2] = int(end[i])
                    runs[-1][3].append(float(lead[i]))
                else:
                    runs.append([prev, int(start[i]), int(end[i]), [float(lead[i])]])
            out[k] = [(langs[r[0]], r[1], r[2], sum(r[3]) / len(r[3])) for r in runs]
        return out


def identify(rows: DataFrame, id_col: str, fields: tuple[str, ...], samples: DataFrame, every: bool = False, labels: tuple[str, ...] = ()) -> DataFrame:
    """(id, field, langs) and, where the columns of the fields' labels are named, (label, text): the language runs of each field that has running words or, if `every`, of each that is not blank; one
    without a known n-gram has a run without language and confidence."""
    ship(rows.sparkSession)
    p = Profiles([(r[0], r[1]) for r in samples.select("lang", "text").collect()])  # the fixed sample table
    shared = rows.sparkSession.sparkContext.broadcast(p)
    keys = rows.select(F.col(id_col).alias("id"), *[F.col(f).alias(f"t{k}") for k, f in enumerate(fields)], *[F.col(x).alias(f"l{k}") for k, x in enumerate(labels)])
    kind = keys.schema["id"].dataType.simpleString()
    struct = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prof = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                b = batch.slice(a, SLICE)
                for k, f in enumerate(fields):
                    texts = b.column(k + 1).to_pylist()
                    got = prof.label(texts, every)
                    if every:
                        got = [g or ([(None, 0, len(t), 0.0)] if t and not t.isspace() else None) for g, t in zip(got, texts)]
                    at = [i for i, x in enumerate(got) if x]
                    langs = [[{"lang": r[0], "start": r[1], "end": r[2], "confidence": r[3]} for r in got[i]] for i in at]
                    take = pa.array(at, pa.int64())
                    cols = [b.column(0).take(take), pa.array([f] * len(at), pa.string()), pa.array(langs, struct)]
                    more = [b.column(len(fields) + 1 + k).take(take), b.column(k + 1).take(take)] if labels else []
                    yield pa.RecordBatch.from_arrays([*cols, *more], names=["id", "field", "langs", "label", "text"][: len(cols + more)])

    return keys.mapInArrow(run, f"id {kind}, {RESULT}" + (", label string, text string" if labels else ""))


def label_lang(codes: DataFrame, label_of: DataFrame, label: str) -> DataFrame:
    """Adds said: the language a label names in any code form and case, null where it names none (codes is the fixed table of languages)."""
    forms = codes.select("lang", F.explode(F.array("lang", "nllb_code", "short_code")).alias("form")).where("form is not null").select(F.lower("form").alias("form"), F.col("lang").alias("said")).dropDuplicates(["form"])
    return label_of.join(F.broadcast(forms), F.lower(F.trim(label)) == F.col("form"), "left").drop("form")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm import mojibake

    rows = table(spark, sf_dir, "paired_sp_train").select("line_no", "src", "trg", "src_lang", "trg_lang")
    runs = identify(rows, "line_no", ("src", "trg"), table(spark, sf_dir, "lang_samples"), labels=("src_lang", "trg_lang"))
    langs = runs.withColumn("langs", F.array_distinct(F.transform("langs", lambda x: x["lang"])))
    said = label_lang(table(spark, sf_dir, "languages"), langs, "label")
    odd = materialise(said.where("size(langs) > 1 or said is null or said <> langs[0]").select("id", "field", "langs", "text"), "odd")
    bad = mojibake.damaged(spark, rows, "line_no", ("src", "trg"), odd)
    return odd.join(bad, ["id", "field"], "left_anti").select(F.col("id").alias("line_no"), "field", F.explode("langs").alias("lang"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir)


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text and every segment of a mixed one with its language and confidence."""
    rows = table(spark, sf_dir, "paired_sp_train").select("line_no", "src", "trg")
    runs = identify(rows, "line_no", ("src", "trg"), table(spark, sf_dir, "lang_samples"), every=True)
    return runs.select(F.col("id").alias("line_no"), "field", F.posexplode("langs").alias("segment", "r")).select("line_no", "field", "segment", "r.start", "r.end", "r.lang", F.round("r.confidence", 6).alias("confidence"))
