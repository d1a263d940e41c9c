import pytest

from spanforge.llm import language as L
from spanforge.llm import mojibake as M
from spanforge.llm import one_form as N

FORMS = {
    "ｖｉｅｌｅ Leute": "viele Leute", "a enсore besoin": "a encore besoin", "(Друнора) la cittα": "(Друнора) la citta", "е́ é ﬁn ĳ ǌ": "é é fin ij nj",
    "𝟎𝟏  x y​z": "01  x yz", "Ka": "Ka", "": "", "la а b": "la a b", "Тарас i Олeна": "Тарас і Олена", "taxi ще Друнора": "taxi ще Друнора",
    "l‑appell so­ft": "l-appell soft", "20 °C, § 4, 15 €, ÜBER ÄRA.": "20 °C, § 4, 15 €, ÜBER ÄRA.", "m² ½ № … ’«» –": "m² ½ № … ’«» –", "a\t  b": "a\t  b", "голοвною": "головною", "il-Друнора": "il-Друнора",
    "cаsa,привет друг": "casa,привет друг", "pаypal\tпривет": "paypal\tпривет", "ϲоmе": "come", "ℌello ℃ №": "Hello ℃ №", "Ꭺpple": "Apple", "օpen": "open",
}


def test_forms(spark):
    rows = spark.createDataFrame([(i, t, None, "f") for i, t in enumerate([*FORMS, None, "x" * 300_000 + "ﬁ"])], "i long, t string, n string, u string")
    got = {r.i: r for r in N.one_form(rows, ["i"], ["t", "n"]).collect()}
    for i, want in enumerate([*FORMS.values(), None, "x" * 300_000 + "fi"]):
        assert got[i].t == want and got[i].n is None, (i, want, got[i].t)
    again = N.one_form(spark.createDataFrame([(i, r.t) for i, r in got.items()], "i long, t string"), ["i"], ["t"]).collect()
    assert all(r.t == got[r.i].t for r in again)
    found = {r.id for r in N.changed(rows.select("i", "t", "n"), "i", ("t", "n")).collect()}
    assert found == {i for i, (a, b) in enumerate(FORMS.items()) if a != b} | {len(FORMS) + 1}
    assert N.one_form(rows.limit(0), ["i"], ["t"]).count() == 0


CLEAN = {
    "fra": "à la première année le procès coûte cher où personne ne répond très bien à côté de la fièvre",
    "ces": "žena říká že město zůstává a příběh je dobře známý každý rok před dnů tématem",
    "ukr": "місто залишається головною темою року і вулиця коштує щороку близько крон але ніхто не знає",
    "deu": "die prüfung hört für die straße schön auf und das wetter zählt über alle maßen heute",
}


@pytest.mark.parametrize(
    "lang, true, wrong",
    [("fra", "utf-8", "cp1252"), ("fra", "utf-8", "cp437"), ("ces", "utf-8", "cp1250"), ("ces", "cp1250", "cp1252"), ("ukr", "utf-8", "cp1251"), ("ukr", "cp1251", "latin-1"), ("ukr", "koi8-u", "cp1251"), ("fra", "mac_roman", "cp1252"), ("deu", "cp1252", "cp437"), ("deu", "utf-8", "latin-1")],
)
def test_channels_restore(lang, true, wrong):
    import math

    freq = {w: math.log(1 / 500) for t in CLEAN.values() for w in t.split()}
    d = M.Decoder(freq)
    text = CLEAN[lang]
    table = M.sloppy(wrong)
    damaged = "".join(table[b] for b in text.encode(true))
    hit, restored, used, whole = d.decode(damaged)
    assert hit and restored == text and whole, (restored, used)
    half = text[: text.index(" ", 20)] + " " + "".join(table[b] for b in text[text.index(" ", 20) + 1 :].encode(true))
    assert d.decode(half)[1] == text
    assert not d.decode(text)[0]


def test_lost_bytes_and_no_cases():
    import math

    d = M.Decoder({w: math.log(1 / 500) for t in CLEAN.values() for w in t.split()})
    assert d.decode("la premi�re ann�e")[:2] == (True, "la première année")
    assert d.decode("la premi��re ann��e")[:2] == (True, "la première année")  # two bytes a letter
    assert d.decode("la premi�re annÃ�e")[:2] == (True, "la première année")  # one of two bytes left
    assert d.decode("мiсто мі��о")[1].endswith("місто")
    hit, text, _, whole = d.decode("� ���")
    assert hit and not whole and text == "� ���"
    for t in ("20 °C, § 4, 15 €, ÜBER ÄRA.", "(Ñandra, Ørvik)", "a enсore besoin", "", "plain", "ｖｉｅｌｅ"):
        assert not d.decode(t)[0], t


def test_restore_frame(spark, monkeypatch):
    good = [(i, CLEAN["fra"], CLEAN["ukr"], "x") for i in range(30)]
    bad = [(100, CLEAN["fra"].encode().decode("cp1252", "ignore"), None, "y"), (101, "", " ", "z"), (102, None, "12 # 4", "z")]
    rows = spark.createDataFrame(good + bad, "line_no long, src string, trg string, text string")
    got = M.restore(spark, rows, "line_no", ("src", "trg")).collect()
    assert [(r.id, r.field) for r in got] == [(100, "src")]
    monkeypatch.setattr(M, "MAX_WORDS", 5)  # words beyond go with the texts
    again = M.restore(spark, rows, "line_no", ("src", "trg")).collect()
    assert [r.restored for r in again] == [r.restored for r in got]
    assert M.restore(spark, rows.limit(0), "line_no", ("src", "trg")).count() == 0


SAMPLES = [
    ("eng", "the council says in the report that the street still needs work and nobody knows where the house is but every morning many people wait there"),
    ("ita", "il consiglio dice nel rapporto che la strada ha ancora bisogno di lavoro e nessuno sa dove si trova la casa ma ogni mattina molta gente aspetta"),
    ("ukr", "рада стверджує у звіті що вулиця ще потребує роботи і ніхто не знає де є будинок але щоранку багато людей чекає біля міста"),
]


def test_language_runs():
    p = L.Profiles(SAMPLES)
    t = [SAMPLES[0][1], SAMPLES[1][1].upper(), SAMPLES[2][1], f"{SAMPLES[1][1]} ({SAMPLES[0][1]})", None, "", "12 34", "Друнора", "the the the the the the the", SAMPLES[0][1] + " " + SAMPLES[2][1]]
    got = [x and [r[0] for r in x] for x in p.label(t)]
    assert got[:4] == [["eng"], ["ita"], ["ukr"], ["ita", "eng"]]
    assert got[4:9] == [None] * 5 and sorted(set(got[9])) == ["eng", "ukr"]
    (a, s, e, c), (b, s2, e2, _) = p.label(t)[3]
    assert t[3][s2:e2] == SAMPLES[0][1] and s == 0 and 0 < c <= 1
    short = p.label([*t[4:9], "la casa"], every=True)
    assert short[:2] == [None, None] and short[-1][0][0] == "ita" and 0 < short[-1][0][3] < 0.5
    assert p.label([]) == [] and L.Profiles([]).label(["some words in here now"]) == [None]
    assert [r[0] for r in p.label([" ".join([SAMPLES[1][1]] * 2000)])[0]] == ["ita"]


def test_identify_and_labels(spark):
    samples = spark.createDataFrame(SAMPLES, "lang string, text string")
    rows = spark.createDataFrame([(1, SAMPLES[0][1], SAMPLES[1][1], 5), (2, None, "", 6)], "line_no long, src string, trg string, lang int")
    got = {(r.id, r.field): [x.lang for x in r.langs] for r in L.identify(rows, "line_no", ("src", "trg"), samples).collect()}
    assert got == {(1, "src"): ["eng"], (1, "trg"): ["ita"]}
    codes = spark.createDataFrame([("eng", "eng_Latn", "en", "English")], "lang string, nllb_code string, short_code string, lang_name string")
    said = L.label_lang(codes, spark.createDataFrame([("EN",), ("eng_latn",), ("xx",), (None,), ("",)], "l string"), "l")
    assert [r.said for r in said.collect()] == ["eng", "eng", None, None, None]
