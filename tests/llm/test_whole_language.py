"""A clause of another language in one long segment is found wherever it stands; names in it are none."""

from spanforge.llm import language as L

SAMPLES = [
    ("eng", "the council says in the report that the street still needs work and nobody knows where the house is but every morning many people wait there"),
    ("ita", "il consiglio dice nel rapporto che la strada ha ancora bisogno di lavoro e nessuno sa dove si trova la casa ma ogni mattina molta gente aspetta"),
]


def test_short_clause_in_a_long_segment():
    p = L.Profiles(SAMPLES)
    eng, ita = (t for _, t in SAMPLES)
    clause = "but every morning many people say that nobody knows where the street is"
    for before, after in (("", f"{ita} {ita} {ita}"), (f"{ita} {ita} {ita}", ""), (f"{ita} {ita} e", f"{ita} {ita}")):
        text = " ".join(x for x in (before, clause, after) if x)
        runs = p.label([text])[0]
        (got,) = [text[s:e] for lang, s, e, _ in runs if lang == "eng"]
        assert {lang for lang, *_ in runs} == {"eng", "ita"} and len(set(got.split()) & set(clause.split())) >= 10, runs
    names = f"{ita} Whitney Streeter e Matthew Northwood {ita}"
    assert [r[0] for r in p.label([names])[0]] == ["ita"]
    assert [r[0] for r in p.label([f"{eng} {eng}"])[0]] == ["eng"]
