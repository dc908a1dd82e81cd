from collections import Counter

import pytest

from evidex.llm import langid as L

TEXT = {
    "en": ["The weekly digest was split into smaller pieces during the weekend.", "Our retrieval test still shows the wrong title for the third meeting.", "The extraction job cannot explain where its evidence came from."],
    "de": ["Die Urlaubskasse wurde in einem Zug geschrieben.", "Unser Suchversuch liefert dieselbe Antwort mit geringerer Gewissheit.", "Der Lesekreis am Donnerstag wartet seit Montag auf die Freigabe."],
    "es": ["El boletín semanal cuenta ahora otra historia.", "El respaldo del ordenador viejo responde más rápido cuando la caché está caliente.", "La cola de revisión solo imprime ceros."],
    "pt": ["O boletim semanal conta agora outra história.", "A cópia do computador velho guarda perguntas a que ninguém respondeu.", "O grafo de relações só imprime zeros."],
    "fr": ["Le budget des vacances oublie un point sur deux.", "La file de relecture n'affiche que des zéros.", "Notre essai de recherche a besoin d'un responsable avant la prochaine version."],
    "it": ["La bozza della proposta appartiene a un progetto chiuso da anni.", "Il calendario del giardino legge la stessa pagina.", "La nostra prova di ricerca mostra ancora il titolo sbagliato."],
    "nl": ["De wachtrij houdt twee schrijfwijzen voor dezelfde persoon.", "Het weekbericht drukt alleen maar nullen af.", "De leesgroep van donderdag wacht nog op een handtekening."],
}


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, passage string")


@pytest.fixture(scope="module")
def trees(spark):
    rows = [(n, t[n % 3] + " " + t[(n + 1) % 3], k if n % 9 else "en") for n in range(60) for k, t in TEXT.items()]
    return L.fit(documents(spark, [(i, t, k) for i, (_, t, k) in enumerate(rows)]))


def test_found(spark, trees):
    rows = [(i, " ".join(t), k) for i, (k, t) in enumerate(TEXT.items())]
    rows += [
        (100, " ".join(TEXT["en"]), "de"), (101, " ".join(TEXT["de"] + TEXT["en"]), "de"), (102, TEXT["fr"][0], None), (103, TEXT["fr"][0], "fr-CA"), (104, TEXT["fr"][0], "und"),
        (105, None, "en"), (106, "  ", None), (107, "a0400191 46DFDBC4", None), (108, "```\nfor row in rows: pass\n```", "fr"), (109, "el boletin semanal cuenta ahora otra historia", "it"),
        (110, " ".join(TEXT["en"] * 6) + " " + TEXT["it"][0], "EN_gb"), (102, TEXT["fr"][0], None),
    ]
    df = documents(spark, rows)
    found = L.detect(df, trees)
    got = {tuple(r) for r in L.relabelled(df, found).collect()}
    assert got == {(100, "en"), (101, "de"), (101, "en"), (102, "fr"), (104, "fr"), (109, "es")}
    assert all(0 <= r["confidence"] <= 1 for r in found.collect())
    assert L.relabelled(df.limit(0), L.detect(df.limit(0), trees)).count() == 0


def test_passages_follow_the_text(trees):
    got = L.passages(" ".join(TEXT["nl"]) + "\n> " + " ".join(TEXT["pt"]) + "\n" + " ".join(TEXT["nl"]), L.Scorer(trees))
    assert [L.LANGUAGES[p[0]] for p in got] == ["nl", "pt", "nl"]
    long = L.passages(" ".join(TEXT["de"]) * 2000, L.Scorer(trees))
    assert [L.LANGUAGES[p[0]] for p in long] == ["de"]


def test_code_lengths_are_a_distribution():
    tree = L.ContextTree(Counter({"aa": 3, "ab": 1}), order=2)
    escape, seen = tree.cost[b"a"]
    assert abs(2**-escape + sum(2**-c for c in seen.values()) - 1) < 1e-9
    assert tree.bits("aa") < tree.bits("ab") < tree.bits("zz")


def test_without_labels(spark):
    df = documents(spark, [(1, " ".join(TEXT["de"]), None)])
    assert {tuple(r) for r in L.relabelled(df, L.detect(df, L.fit(df))).collect()} == {(1, "de")}
