"""The array kernels of problem 9 against plain definitions, and their time against the same."""

import re
import time

import numpy as np
import pyarrow as pa

from spanforge.llm import npwords
from spanforge.llm import subjects as S

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?]+(?=\s|$|[\"»”“)])|[\r\n]+|\|\|\|")
ODD = [
    "", " ", "one two three four", "One TWO three. four five six seven! eight nine", "a b c d.e f g h", "a b c d..e f g h... i j k l?! m n o p", "a b c d.\0 e f g h", "a b c d. e f g h.» i j k l.”m n o p.) q r s t.",
    "a b c d || e f g h ||| i j k l |||| m n o p ||||||q r s t", "a b c d\re f g h\n\n\r\ni j k l m n o p", ". ! ?", "\n\n", "a1b c_d e½f Ⅷ x²y 漢字 ok i̇ İstanbul ΣΑΣ ΟΔΟΣ. ΟΔΟΣ", "x" * 3000 + " y z w", "ünï cödé é́ te𝟙xt 𝒜 ab", "a b c d.", "a b c d.\n", "a b c d?.", "a b c d. ",
]


def plain(texts):
    return [[w for s in SENTENCE.split(t.lower()) if len(w := WORD.findall(s)) >= 4] for t in texts]


def test_cut_equals_plain_definition():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rnd = np.random.default_rng(3)
    alphabet = [*"aB.!?\r\n|\"»”“) _1é\0 Σİ½", "|||", " the ", " of "]
    texts = ODD + ["".join(alphabet[i] for i in rnd.integers(len(alphabet), size=200)) for _ in range(200)] + ["".join(every[i : i + 4096]) for i in range(0, len(every), 4096)]
    texts += ["q w e ." + c + "r t y u" + c + "z" for c in every[:0x3100]]
    of, count, h = S.cut(texts)
    want = plain(texts)
    assert list(zip(of.tolist(), count.tolist())) == [(i, len(s)) for i, of_text in enumerate(want) for s in of_text]
    words = [w for of_text in want for s in of_text for w in s]
    assert len({*h.tolist()}) == len({*words}) == len({*zip(words, h.tolist())})
    assert [len(x) for x in S.cut([])] == [len(x) for x in S.cut(["", " . "])] == [0, 0, 0]


def test_sums_equal_loops():
    terms = [[5, 5, 7], [], [7, -1, 5, 9], [3]]
    doc, own, at = S._flat(pa.array(terms, pa.list_(pa.int64())).slice(0))
    assert own[at].tolist() == [x for t in terms for x in t] and doc.tolist() == [i for i, t in enumerate(terms) for _ in t]
    doc, own, at = S._flat(pa.array(terms, pa.list_(pa.int64())).slice(2))
    assert own[at].tolist() == [7, -1, 5, 9, 3] and doc.tolist() == [0, 0, 0, 0, 1]
    n = np.array([1.0, 1, 1, 1, 0])
    got = S._sums(own, at, n, iter([n / 2, n / 4]), np.array([9.0, 8, 7])).to_pylist()
    assert sorted((r["term"], r["n"], r["c0"], r["c1"]) for r in got if r["term"] is not None) == [(-1, 1, 0.5, 0.25), (5, 1, 0.5, 0.25), (7, 1, 0.5, 0.25), (9, 1, 0.5, 0.25)]
    assert got[-1] == {"term": None, "n": 9, "c0": 8, "c1": 7}


def test_mixtures_equal_loops():
    rnd = np.random.default_rng(4)
    row, size = np.array([0, 0, 0, 2, 2, 5]), np.array([7, 3, 2, 0, 1, 4])
    u, rest = rnd.random((6, 3)) + 0.01, rnd.random(3) + 0.01
    at, w = S.mixtures(row, u, rest, size, 6)
    assert at.tolist() == [0, 2, 5]
    for i, d in enumerate(at):
        x = np.full(3, 1 / 3)
        for _ in range(6):
            x = sum(x * y / (x * y).sum() for y in u[row == d]) + (size[d] - (row == d).sum()) * x * rest / (x * rest).sum()
            x /= x.sum()
        assert np.allclose(w[i], x, rtol=1e-12)


def test_cut_takes_less_than_half_the_time_of_the_plain_definition():
    texts = ["The council says in the report that the street still needs work, and nobody knows where the house is. " * 15] * 400

    def seconds(run):
        out = []
        for _ in range(3):
            a = time.process_time()
            run()
            out.append(time.process_time() - a)
        return min(out)

    def old():
        got = plain(texts)
        return npwords.joined([w for t in got for s in t for w in s], lower=False)

    S.kinds()
    assert seconds(lambda: S.cut(texts)) < seconds(old) / 2
