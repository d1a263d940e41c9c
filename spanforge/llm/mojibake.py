"""Problem 3: text that was decoded with a wrong character encoding, found and restored where that can be known.

Noisy-channel decoding.  A channel is a pair (encoding the text was decoded with, encoding it was written in), once or
twice over.  A suspicious text is laid out as a lattice: each word with characters beyond ASCII is turned back into its
bytes by every channel and read again.  Bytes lost in decoding (replacement characters) are wildcards of the same lattice: a
byte of UTF-8 whose neighbours are there leaves the letters they allow, a run of lost bytes one letter for one to three bytes,
and the words of the corpus that fit are the readings.  A Viterbi search over the words, with word frequencies of the whole
corpus as source model and a price for entering and changing a channel, picks what happened to each word, over all channels
that explain some word of the text; look-alike characters compete as a channel of their own, so disguised text is not taken
for garbled text.

Word frequencies are counted over all rows.  The MAX_WORDS most frequent words are handed to the workers; where there are
more, the readings of each suspicious text are joined with the rest and go with the text, and so does the likeliest of the
rest for each shape of a word with lost bytes that no frequent word fits (a frequent one always goes first).  Texts written wholly in one language's alphabet cannot hold such
damage and are passed over by the JVM.

Defined results: null, empty and blank texts are no cases; a text with replacement or C1 control characters always is one;
what no channel explains stays as it is; texts of any length are searched whole; repeated rows come out each; ties go to
the undamaged reading, then to the earlier channel.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.common import materialise, ship, table

MAX_WORDS = 300_000
# letters beyond a-z of each language, fixed values
ALPHABETS = {
    "eng": "", "fra": "àâæçéèêëîïôœùûüÿ", "ita": "àèéìíîòóùú", "deu": "äöüß", "ces": "áčďéěíňóřšťúůýž",
    "hsb": "ćčěłńóřŕšśžź", "mlt": "àċèġħìîòùż", "ukr": "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя",
}
OWN = "|".join(f"[{'a-z' if lang != 'ukr' else ''}{letters}]+" for lang, letters in ALPHABETS.items())  # words in one language's letters
PLAIN = "–—’‘‚“”„«»‹›…•·°§€£№©®™  ½²³"  # marks that ordinary text holds
SINGLE = ["cp1252", "cp1250", "cp1251", "latin-1", "iso8859-2", "iso8859-3", "iso8859-5", "iso8859-15", "mac_roman", "mac_latin2", "cp437", "cp850", "cp852", "cp866", "koi8-u"]
TWICE = ["cp1252", "latin-1"]
ENTER, CHANGE, LEAVE, OOV, OOV_LETTER, ODD = 4.5, 9.0, 2.0, 8.0, 1.0, 6.0
AT_EDGE = 2.0  # price in place of ODD of a letter read as an ordinary mark before or after the words of its token, or as an apostrophe or dash between them
INNER = "’‘–—"
MEMO = 100_000
LOST = 1 << 20  # number of the channel that lost bytes
EDGE, INSIDE = 8, 3  # most letters of a shape's ends, or of what is left within it, that words are looked up by


def language_pattern() -> list[str]:
    """For each language, a pattern of the texts written in its letters, digits and ordinary marks alone."""
    marks = "".join(f"\\x{{{ord(c):X}}}" for c in PLAIN)
    out = []
    for lang, letters in ALPHABETS.items():
        beyond = "".join(sorted(set(letters + letters.upper().replace("SS", ""))))
        ascii_ = "\\x{0}-\\x{7F}" if lang != "ukr" else "\\x{0}-@\\x{5B}-`\\x{7B}-\\x{7F}"
        out.append(f"^[{ascii_}{marks}{beyond}]*$")
    return out


def suspicious(text: Column) -> Column:
    clean = F.lit(False)
    for p in language_pattern():
        clean = clean | text.rlike(p)
    case = "[\\x{C0}-\\x{DE}\\x{100}-\\x{17F}&&\\p{Lu}](?<=\\p{Ll}.)"  # a capital inside a word
    lead = "[\\x{C2}-\\x{F4}][\\x{A0}-\\x{BF}€‚„…†‡ˆ‰‹‘’“”•–—˜™›]"  # what the bytes of UTF-8 look like one by one
    return (F.octet_length(text) > F.length(text)) & (~clean | text.rlike(f"{case}|{lead}"))  # ASCII alone is clean and has neither


def word_counts(rows: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None, float]:
    """(the most frequent words, at most MAX_WORDS of them; the others, if any; number of occurrences) of the words that occur twice or more and are written in one language's letters."""
    each = rows.select(F.explode(F.array(*fields)).alias("text")).where("text is not null")
    words = each.select(F.explode(F.split(F.lower("text"), "[^\\p{L}\\p{M}]+")).alias("w")).where("w <> ''")
    counts = materialise(words.groupBy("w").agg(F.count("*").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    good = counts.where((F.col("n") >= 2) & F.col("w").rlike(f"^(?:{OWN})$"))
    by_n = sorted(good.groupBy("n").agg(F.count("*").alias("k")).collect(), key=lambda r: r["n"])  # how many words occur so often; as different counts add up to the total at most, there are at most sqrt(2 total) of them
    above, least = good.count(), 2
    for r in by_n:
        if above <= MAX_WORDS:
            break
        above, least = above - r["k"], r["n"] + 1
    return good.where(F.col("n") >= least), good.where(F.col("n") < least) if least > 2 else None, float(total)


def sloppy(codec: str) -> str:
    """The 256 characters of a single-byte encoding, undefined bytes as the C1 control of the same number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@lru_cache(1)
def channels() -> tuple[list[str], list[tuple[frozenset[str], bool, list[tuple[int, bool, dict[str, float], object]]]]]:
    """Names of the channels, and for each encoding a text may have been decoded with: the characters it can give, whether
    they include Cyrillic, and its channels (number, whether the written encoding has Cyrillic too, the least price of
    each character that has one, reader).  A letter that would be read as a mark speaks against a single-byte channel, and
    so does a character read as an odd one; neither rules it out."""
    tables = {c: sloppy(c) for c in SINGLE}
    back = {c: {ch: b for b, ch in enumerate(t)} for c, t in tables.items()}
    cyrillic = {c for c, t in tables.items() if "ж" in t}

    def as_utf8(codec: str, times: int) -> object:
        inv = back[codec]

        def read(s: str) -> str | None:
            for _ in range(times):
                try:
                    s = bytes([inv[c] for c in s]).decode("utf-8")
                except (KeyError, UnicodeDecodeError):
                    return None
            return s

        return read

    names, groups, seen = [], {c: [] for c in SINGLE}, set()

    good = {c for letters in ALPHABETS.values() for c in letters + letters.upper()} | set(PLAIN)

    def add(name: str, wrong: str, both: bool, price: dict[str, float], read: object) -> None:
        groups[wrong].append((len(names), both, price, read))
        names.append(name)

    for wrong in SINGLE:
        add(f"utf-8 as {wrong}", wrong, True, {}, as_utf8(wrong, 1))
    for wrong in TWICE:
        add(f"utf-8 as {wrong} twice", wrong, True, {}, as_utf8(wrong, 2))
    for true in SINGLE:
        for wrong in SINGLE:
            m = tuple((ch, tables[true][b]) for ch, b in sorted(back[wrong].items()) if b > 127)
            if true != wrong and m not in seen and any(a != b for a, b in m):
                seen.add(m)
                trans = str.maketrans(dict(m))
                price = {ch: x for ch, to in m if (x := (to > "\x7f" and to not in good) * ODD + (ch.isalpha() and not to.isalpha()) * (AT_EDGE if to in PLAIN else ODD))}
                add(f"{true} as {wrong}", wrong, true in cyrillic, price, lambda s, t=trans: s.translate(t))
    return names, [(frozenset(c for c in tables[w] if c > "\x7f"), w in cyrillic, groups[w]) for w in SINGLE]


def wild(word: str, channel: str | None) -> tuple[str, int, int] | None:
    """(pattern, least, most letters) of the lower-case words that a word with lost bytes may have been.

    A lost byte is a letter beyond ASCII of its own or, in UTF-8, one of its two or three bytes.  With a channel, characters
    beyond ASCII are bytes again: a lead byte before lost ones leaves the letters of its block, a trail byte after one those of its place."""
    low = word.lower() if channel is None else word
    if channel is None:
        out, least, most = [], 0, 0
        for run in re.finditer("(�+)|([^�]+)", low):
            n = len(run.group())
            if run.group(1):
                out.append(f"[^a-z]{{{-(-n // 3)},{n}}}")
                least, most = least - (-n // 3), most + n
            else:
                out.append(re.escape(run.group()))
                least, most = least + n, most + n
        return "".join(out), least, most
    inv = {c: b for b, c in enumerate(sloppy(channel))}
    bytes_ = [None if c == "�" else inv.get(c, -1) for c in low]
    if -1 in bytes_:
        return None
    out, n, i = [], 0, 0
    while i < len(bytes_):
        b, nxt = bytes_[i], bytes_[i + 1] if i + 1 < len(bytes_) else -1
        if b is not None and b < 0x80:
            out.append(re.escape(chr(b).lower()))
            i += 1
        elif b is not None and 0xC2 <= b <= 0xDF and (nxt is None or 0x80 <= nxt <= 0xBF):
            letters = {chr((b & 31) << 6 | x).lower() for x in (range(64) if nxt is None else [nxt & 63])}
            out.append("[" + "".join(sorted(c for c in letters if c.isalpha())) + "]")
            i += 2
        elif b is None and nxt not in (None, -1) and 0x80 <= nxt <= 0xBF:
            letters = {chr(x << 6 | nxt & 63).lower() for x in range(2, 32)}
            out.append("[" + "".join(sorted(c for c in letters if c.isalpha())) + "]")
            i += 2
        else:
            return None
        if out[-1] == "[]":
            return None
        n += 1
    return "".join(out), n, n


def lookups(pattern: str, least: int, most: int) -> list[tuple[int, int, int, str]]:
    """(letters at the start, at the end, inside; key) under which every word of least to most letters that fits a pattern of
    `wild` is found: its size and the letters that are left at both ends, or without such, some that are left inside."""
    one = [m.group(1) or m.group(2) for m in re.finditer(r"\[\^a-z\]\{\d+,\d+\}|\[([^\]]+)\]|(.)", pattern)]  # letters that may stand there, None for any beyond a-z
    runs = "".join(x if x and len(x) == 1 else "\0" for x in one).split("\0")
    start, end = runs[0][:EDGE], runs[-1][-EDGE:]
    if start or end:
        return [(len(start), len(end), 0, f"{n}|{len(start)}|{len(end)}|{start}|{end}") for n in range(least, most + 1)]
    run = max(runs, key=len)[:INSIDE]
    some = [run] if run else min((x for x in one if x), key=len)
    return [(0, 0, len(x), f"{n}|{x}") for n in range(least, most + 1) for x in some]


def folded(s: str) -> str:
    """The look-alike reading: compatibility forms, combining marks, invisible characters and look-alike letters to plain Latin."""
    from spanforge.llm.one_form import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS

    s = unicodedata.normalize("NFKC", s)
    return "".join(c for c in s if unicodedata.category(c) != "Cf").translate(str.maketrans(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS))


class Decoder:
    """Viterbi search over the words of one text; readings of a word are kept in a bounded table."""

    def __init__(self, logp: dict[str, float]):
        self.logp = logp
        self.of_text: dict[str, float] = {}  # words of the text at hand that are not among the most frequent
        self.fits: dict[str, tuple[float, str]] = {}  # the likeliest word not among them for the shapes of the text at hand
        self.memo: dict[str, tuple] = {}
        self.lost: dict[str, str | None] = {}
        self.by_size: dict[int, list[str]] | None = None
        good = {c for letters in ALPHABETS.values() for c in letters + letters.upper()} | set(PLAIN)
        self.good = good
        self.runs = re.compile(r"[^\W\d_]+")
        self.own = re.compile(OWN)

    def with_words(self, words: dict[str, float], fits: dict[str, tuple[float, str]]) -> None:
        """Further words of the next text: all that `asked` and `shapes` name for its tokens, so a token reads alike in every text."""
        self.of_text, self.fits = words, fits

    def asked(self, tok: str) -> list[str]:
        """The words not among the most frequent that the readings of a token may hold."""
        words, beyond = self.plain(tok), {c for c in tok if c > "\x7f"}
        if words and self.known(words):
            return []
        texts = [tok, folded(tok), *(r for chars, _, group in channels()[1] if beyond <= chars for _, _, _, read in group if (r := read(tok)))]
        return sorted({w for s in texts for x in self.runs.findall(s) if (w := x.lower()) not in self.logp and self.own.fullmatch(w)})

    def plain(self, tok: str) -> list[str]:
        """The words of a token in ordinary letters and marks; none if one of them is short."""
        words = self.runs.findall(tok)
        return words if {c for c in tok if c > "\x7f"} <= self.good and all(len(w) > 2 for w in words) else []

    def known(self, words: list[str]) -> bool:
        """Whether all are words as they should be."""
        return all((w.lower() in self.logp or w.lower() in self.of_text) and (w.islower() or w[1:].islower() or w.isupper()) for w in words)

    def score(self, s: str) -> tuple[float, int]:
        """(log probability, known words) of one reading."""
        total, known = 0.0, 0
        for c in s:
            if c > "\x7f" and c not in self.good:
                total -= ODD
        for w in self.runs.findall(s):
            p = self.logp.get(w.lower())
            if p is None and self.of_text:
                p = self.of_text.get(w.lower())
            if p is not None:
                total += p
                known += w[0] > "\x7f" or len(w) > 1
            else:
                total -= OOV + OOV_LETTER * len(w)
                cyr = any("Ѐ" <= c <= "ӿ" for c in w)
                if cyr and any(c < "ɐ" for c in w):
                    total -= ODD
            if len(w) > 1 and any(c > "\x7f" and c.isupper() and b.islower() for b, c in zip(w, w[1:])):
                total -= 3
        return total, known

    def marks(self, tok: str, s: str) -> float:
        """Price of the letters of a token that a single-byte channel reads as marks."""
        at = [i for i, (a, b) in enumerate(zip(tok, s)) if a.isalpha() and not b.isalpha()]
        if not at:
            return 0.0
        inside = [i for i, c in enumerate(s) if c.isalpha()] or [0]
        ordinary = lambda i: s[i] in PLAIN and (not inside[0] < i < inside[-1] or s[i] in INNER and s[i - 1].isalpha() and s[i + 1].isalpha())
        return sum(AT_EDGE if ordinary(i) else ODD for i in at)

    def readings(self, tok: str) -> tuple:
        """(own score, [(channel, reading, score)]) of one token; a channel's reading must be better than the token as it stands."""
        got = self.memo.get(tok)
        if got is None:
            own, _ = self.score(tok)
            out = []
            beyond = {c for c in tok if c > "\x7f"}
            words = self.plain(tok)
            if words and self.known(words):
                got = self.memo[tok] = (own, [])  # a word as it should be needs no other reading
                return got
            pure = words and all("Ѐ" <= c <= "ӿ" for w in words for c in w)  # bytes of a Latin text do not give whole Cyrillic words
            most, odd = 4 - own, sorted(c for c in tok if c > "\x7f")
            # a reading scores no more than what its characters cost, so one that cannot come near the token is not made
            tries = [(k, read) for chars, cyr, group in channels()[1] if beyond <= chars and (cyr or not pure) for k, both, price, read in group if (both or not pure) and (not price or sum(price.get(c, 0) for c in odd) < most)]
            for k, read in sorted(tries, key=lambda x: x[0]):
                s = read(tok)
                if s is not None and s != tok:
                    p, known = self.score(s)
                    if len(s) == len(tok):  # single bytes
                        sure = known > 0
                        p -= self.marks(tok, s)
                    else:  # several characters that happen to be one of UTF-8 are evidence in themselves
                        p += 2.0 * (len(tok) - len(s))
                        sure = all(c < "\x80" or c in self.good for c in s)
                    if p > own - 4:
                        out.append((k, s, p, sure and p > own))
            s = folded(tok)
            if s != tok:
                p, known = self.score(s)
                out.append((-1, s, p, True))
            if len(self.memo) > MEMO:
                self.memo.clear()
            got = self.memo[tok] = (own, out)
        return got

    def fill(self, tok: str) -> tuple[float, str] | None:
        """(score, reading) of a token with lost bytes: the likeliest words that fit what is left, if all of its words have one."""
        got = self.lost.get(tok, 0)
        if got == 0:
            if len(self.lost) > MEMO:
                self.lost.clear()
            got = self.lost[tok] = max((x for channel in (None, *TWICE) if (x := self._filled(tok, channel))), default=None)
        return got

    def _filled(self, tok: str, channel: str | None) -> tuple[float, str] | None:
        """The token with the characters that are left read as bytes of UTF-8 decoded with `channel`, or as they stand."""
        out, total, at = [], 0.0, 0
        for begin, end, shape in self.shapes(tok, channel):
            w = tok[begin:end]
            out.append(tok[at:begin])
            at = end
            if shape is None:
                return None
            if not shape:
                out.append(w)
                total += self.score(w)[0]
                continue
            got = self.frequent(*shape) or self.fits.get(shape[0])
            if got is None:
                return None
            total += got[0]
            hit = got[1]
            out.append(hit.upper() if w.isupper() and len(w) > 1 else hit[0].upper() + hit[1:] if w[0].isupper() and channel is None else hit)
        return total, "".join(out) + tok[at:]

    def shapes(self, tok: str, channel: str | None) -> Iterator[tuple[int, int, tuple]]:
        """(begin, end, shape) of the words of a token: empty for one without lost bytes, None for one of which nothing can be told."""
        kept = "�" if channel is None else "�\u0080-\U0010ffff"
        for m in re.finditer(rf"(?:[^\W\d_]|[{kept}])+", tok):
            w = m.group()
            shape = () if "�" not in w and (channel is None or w.isascii()) else wild(w, channel)
            if shape and not re.sub(r"\[\^a-z\]\{\d+,\d+\}", "", shape[0]):
                shape = None  # nothing is left of the word
            yield m.start(), m.end(), shape

    def frequent(self, pattern: str, least: int, most: int) -> tuple[float, str] | None:
        """(log frequency, word) of the likeliest of the most frequent words that fit a shape."""
        if self.by_size is None:
            self.by_size = {}
            for x in self.logp:
                self.by_size.setdefault(len(x), []).append(x)
        fit = re.compile(pattern)
        return max(((self.logp[x], x) for n in range(least, most + 1) for x in self.by_size.get(n, ()) if fit.fullmatch(x)), default=None)

    def decode(self, text: str) -> tuple[bool, str, list[str], bool]:
        """(damaged, restored text, channels, whether all damage is restored)."""
        parts = re.split(r"([ \t\r\n]+)", text)
        at = [i for i, p in enumerate(parts) if i % 2 == 0 and not p.isascii()]
        damaged, whole, used = False, True, []
        emits, active = [], set()
        for i in at:
            if "�" in parts[i]:
                damaged = True
                got = self.fill(parts[i])
                if got is None:
                    whole = False
                    emits.append((0.0, []))
                else:
                    emits.append((got[0] - 2 * OOV, [(LOST, got[1], got[0], True)]))
                    active.add(LOST)
            else:
                emits.append(self.readings(parts[i]))
                active.update(k for k, _, _, strong in emits[-1][1] if strong)
        if active:
            states = [None, *sorted(active)]
            best, trail = {None: 0.0}, []
            for i, (own, alts) in zip(at, emits):
                emit = {None: own} | {k: p for k, _, p, _ in alts}
                foreign = any(c not in self.good for c in parts[i] if c > "\x7f")
                top = max(((v, t) for t, v in best.items() if t is not None), key=lambda x: x[0], default=(-math.inf, None))
                start = best.get(None, -math.inf)
                nxt, come = {}, {}
                for s in states:
                    e = emit.get(s)
                    if e is None:
                        if s is None or foreign:
                            continue
                        e = own - 4  # a damaged span may hold a word the damage left as it was
                    cands = [(best.get(s, -math.inf), s)]
                    if s is None:
                        cands.append((top[0] - LEAVE, top[1]))
                    else:
                        cands += [(start - ENTER, None), (top[0] - CHANGE, top[1])]
                    v, t = max(cands, key=lambda x: (x[0], x[1] is None))
                    if v > -math.inf:
                        nxt[s], come[s] = v + e, t
                best = nxt
                trail.append(come)
            s = max(best, key=lambda k: (best[k], k is None))
            for i, (_, alts), come in zip(reversed(at), reversed(emits), reversed(trail)):
                if s is not None and s != -1:
                    r = next((x for k, x, *_ in alts if k == s), None)
                    if r is not None:
                        damaged = True
                        used.append("lost bytes" if s == LOST else channels()[0][s])
                        parts[i] = r
                s = come[s]
        out = "".join(parts)
        if re.search("[\x80-\x9f]", text):
            damaged = True
            whole = whole and not re.search("[\x80-\x9f]", out)
        whole = whole and "�" not in out
        return damaged, out, sorted(set(used)), whole


def _extra(odd: DataFrame, others: DataFrame, total: float, known: Broadcast) -> DataFrame:
    """The suspicious texts with columns `more`: the words of their readings that are not among the most frequent, with log
    frequency; and `fits`: of those words the likeliest for each shape of a word with lost bytes that no frequent word fits."""
    longest = others.agg(F.max(F.length("w"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(known.value)
        open_: dict[tuple, list[tuple[int, int, int, str]]] = {}  # lookups of the shapes that no frequent word fits
        asked: dict[str, list[str]] = {}
        for b in batches:
            rows, words, patterns, keys = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen, shapes = set(), set()
                for tok in re.split(r"[ \t\r\n]+", t):
                    if "�" in tok:
                        seen.update(w for x in d.runs.findall(tok) if (w := x.lower()) not in d.logp and d.own.fullmatch(w))
                        shapes.update(x for channel in (None, *TWICE) for _, _, x in d.shapes(tok, channel) if x)
                    elif not tok.isascii():
                        if len(asked) > MEMO:
                            asked.clear()
                        if tok not in asked:
                            asked[tok] = d.asked(tok)
                        seen.update(asked[tok])
                if len(open_) > MEMO:
                    open_.clear()
                for x in shapes - open_.keys():
                    open_[x] = [] if d.frequent(*x) else lookups(x[0], x[1], min(x[2], longest))
                shapes = sorted(x for x in shapes if open_[x])
                rows += [i] * (len(seen) + len(shapes))
                words += [*sorted(seen), *[None] * len(shapes)]
                patterns += [*[None] * len(seen), *(x[0] for x in shapes)]
                keys += [*[None] * len(seen), *([{"i": i, "j": j, "k": k, "key": key} for i, j, k, key in open_[x]] for x in shapes)]
            kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("k", pa.int32()), ("key", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(words, pa.string()), pa.array(patterns, pa.string()), pa.array(keys, kind)], names=["_row", "w", "pattern", "keys"])

    numbered = materialise(odd.withColumn("_row", F.monotonically_increasing_id()), "suspicious")
    asked = materialise(numbered.select("_row", "text").mapInArrow(run, "_row long, w string, pattern string, keys array<struct<i:int,j:int,k:int,key:string>>"), "asked")
    words = asked.where("w is not null").select("_row", "w").join(others, "w")
    more = words.groupBy("_row").agg(F.collect_list(F.struct("w", F.log(F.col("n") / total).alias("p"))).alias("more"))  # words of one text
    keys = asked.where("pattern is not null").groupBy("pattern").agg(F.first("keys").alias("keys")).select("pattern", F.inline("keys"))
    kinds = [tuple(r) for r in keys.select("i", "j", "k").distinct().collect()]  # at most (EDGE + 1)^2 + INSIDE
    size = F.length("w")
    ends = [F.when(size >= max(i, j), F.array(F.concat_ws("|", size, F.lit(i), F.lit(j), F.substring("w", 1, i), F.right(F.col("w"), F.lit(j))))) for i, j, k in kinds if not k]
    inside = [F.when(size >= k, F.transform(F.sequence(F.lit(1), size - k + 1), lambda at, k=k: F.concat_ws("|", size, F.substring(F.col("w"), at, F.lit(k))))) for _, _, k in kinds if k]
    under = F.flatten(F.array_compact(F.array(*ends, *inside))) if kinds else F.array().cast("array<string>")
    best = keys.join(others.select("w", "n", F.explode(F.array_distinct(under)).alias("key")), "key").where(F.rlike("w", F.concat(F.lit("^(?:"), "pattern", F.lit(")$"))))
    best = best.groupBy("pattern").agg(F.max(F.struct("n", "w")).alias("b"))
    fits = asked.where("pattern is not null").select("_row", "pattern").join(best, "pattern")
    fits = fits.groupBy("_row").agg(F.collect_list(F.struct("pattern", F.col("b.w").alias("w"), F.log(F.col("b.n") / total).alias("p"))).alias("fits"))  # shapes of one text
    return numbered.join(more, "_row", "left").join(fits, "_row", "left").select("id", "field", "text", "more", "fits")


def restore(spark: SparkSession, rows: DataFrame, id_col: str, fields: tuple[str, ...], only: DataFrame | None = None) -> DataFrame:
    """(id, field, text, restored, channels, whole) of the damaged fields; only: the (id, field, text) to look at, the words being those of all rows."""
    ship(spark)
    top, others, total = word_counts(rows, fields)
    known = spark.sparkContext.broadcast({r["w"]: math.log(r["n"] / total) for r in top.collect()})  # at most MAX_WORDS
    if only is None:
        only = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("e")).select("id", "e.field", "e.text")
    odd = only.select("id", "field", "text").where(suspicious(F.col("text")))
    none = {"more": F.lit(None).cast("array<struct<w:string,p:double>>"), "fits": F.lit(None).cast("array<struct<pattern:string,w:string,p:double>>")}
    odd = odd.withColumns(none) if others is None else _extra(odd, others, total, known)
    kind = odd.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(known.value)
        for b in batches:
            got = []
            for i, (t, more, fits) in enumerate(zip(*(b.column(c).to_pylist() for c in (2, 3, 4)))):
                d.with_words({x["w"]: x["p"] for x in more or ()}, {x["pattern"]: (x["p"], x["w"]) for x in fits or ()})
                r = d.decode(t)
                if r[0]:
                    got.append((i, *r))
            at = pa.array([g[0] for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array([g[2] for g in got], pa.string()), pa.array([g[3] for g in got], pa.list_(pa.string())), pa.array([g[4] for g in got], pa.bool_())],
                names=["id", "field", "text", "restored", "channels", "whole"],
            )

    return odd.select("id", "field", "text", "more", "fits").mapInArrow(run, f"id {kind}, field string, text string, restored string, channels array<string>, whole boolean")


def damaged(spark: SparkSession, rows: DataFrame, id_col: str, fields: tuple[str, ...], only: DataFrame | None = None) -> DataFrame:
    return restore(spark, rows, id_col, fields, only).select("id", "field")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "paired_sp_train").select("line_no", "src", "trg")
    return damaged(spark, rows, "line_no", ("src", "trg")).select(F.col("id").alias("line_no"), "field")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "paired_sp_train").select("line_no", "src", "trg")
    return restore(spark, rows, "line_no", ("src", "trg")).withColumnRenamed("id", "line_no")
