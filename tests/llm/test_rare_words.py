"""Words beyond those handed to the workers take part in the search for lost bytes too."""

import re

from spanforge.llm import mojibake as M

COMMON = "la première année le procès coûte cher"
RARE = "créée naïve où âgée çà élève noël fièvre très вулиця місто"


def test_lookups_find_whatever_fits():
    words = set(RARE.split()) | {"crée", "ééé", "été", "tres", "trêve", "aaaaaaaaaaaaaaaaaaaaé"}
    for w, channel in (("cr�e", None), ("�ve", None), ("�l�ve", None), ("�t�", None), ("a�", None), ("aaaaaaaaaaaaaaaaaaaa��", None), ("мі��о", None), ("fiÃ�vre", "cp1252"), ("�©tÃ�", "cp1252"), ("Ã�Ã�", "cp1252"), ("Ã�Ã�Ã�", "cp1252")):
        pattern, least, most = M.wild(w, channel)
        keys = M.lookups(pattern, least, most)
        for x in (x for x in words if re.fullmatch(pattern, x)):
            under = {f"{len(x)}|{i}|{j}|{x[:i]}|{x[len(x) - j:]}" if not k else next((f"{len(x)}|{x[a:a + k]}" for a in range(len(x)) if key == f"{len(x)}|{x[a:a + k]}"), "") for i, j, k, key in keys}
            assert under & {key for *_, key in keys}, (w, x)


def test_lost_bytes_of_rare_words(spark, monkeypatch):
    texts = [COMMON] * 30 + [RARE] * 3 + ["élevé élevé"]
    bad = ["la premi�re ann�e cr��e", "�l�ve No�l fi��vre", "le proc�s na�ve l'�g��e", "fiÃ�vre tr�s", "��ве мі��о вулиц�", "No�l No�l zzz�zz", "trÃ¨s l�’élève"]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts + bad)], "line_no long, src string, trg string")
    run = lambda: {r.id: (r.restored, r.whole) for r in M.restore(spark, rows, "line_no", ("src", "trg")).collect()}
    all_ = run()
    assert all_[len(texts)] == ("la première année créée", True)
    for most in (5, 1):
        monkeypatch.setattr(M, "MAX_WORDS", most)
        assert run() == all_


def test_asked_words_are_all_that_readings_need():
    words = (COMMON + " " + RARE).split()
    logp = {w: -5.0 - i / 10 for i, w in enumerate(words)}
    top = {w: p for w, p in logp.items() if w in COMMON.split()}
    whole, part = M.Decoder(logp), M.Decoder(top)
    tables = [M.sloppy(c) for c in M.SINGLE]
    toks = [*words, *(w.capitalize() + "," for w in words)]
    toks += ["".join(t[b] for b in w.encode("utf-8")) for w in words for t in tables] + ["".join(t[b] for b in w.encode("cp1252")) for w in words if w.isascii() or "é" in w for t in tables]
    for tok in toks:
        part.with_words({w: logp[w] for w in M.Decoder(top).asked(tok) if w in logp}, {})
        assert part.readings(tok) == whole.readings(tok), tok
    assert not any(w in top for tok in toks for w in M.Decoder(top).asked(tok))
