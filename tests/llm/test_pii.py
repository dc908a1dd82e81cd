import pytest
from pyspark.sql import functions as F

from evidex.llm import pii, queries

FILLER = [f"The draft chapter number {n} still waits for a signature and the disk was full." for n in range(300)]
TEXTS = [
    "You can reach Jürgen Tibrel at +49 30 23125 564 after lunch.",
    "contact: Pekriglis, Ursula <francisco34@mail.pazum.example>",
    "Send the parcel to Flat 4, 281 Nakel Road, Vemorford ZZ8 5QX.",
    "SSN 666-28-5445 must not appear in the notes. Section 211-17-0007 of the manual.",
    "The job ran on 10.223.24.20 port 8443. Pinned reader@58.38.1 in the lock file. Clone git@forge.example:notes/x first.",
    "Ask c. nobody or Dr. XENIA VAN DER PLOR, then zoë@x.example; Tel. (585) 555-0145",
    "From Port Quella to Saint Ostrem Square it takes 3 minutes.",
    "Die neue Anschrift lautet Kenelplatz 135b, 00453 Lilum",
    "Calle Firum 131, 1º izq., 00376 Nerel or 106 rue Tomor, 00139 Stumel",
]


@pytest.fixture(scope="module")
def model():
    return pii.train(FILLER + TEXTS * 20 + [t.replace("6", "4") for t in TEXTS] * 5)


def found(model, text):
    return [(s.kind, text[s.start : s.end]) for s in model.spans(text, model.lexicon())]


def test_values_and_decoys(model):
    assert found(model, TEXTS[0]) == [("name", "Jürgen Tibrel"), ("phone", "+49 30 23125 564")]
    assert found(model, TEXTS[1]) == [("name", "Pekriglis, Ursula"), ("email", "francisco34@mail.pazum.example")]
    assert found(model, TEXTS[2]) == [("address", "Flat 4, 281 Nakel Road, Vemorford ZZ8 5QX")]
    assert found(model, TEXTS[3]) == [("id_number", "666-28-5445")]
    assert found(model, TEXTS[4]) == []
    assert found(model, TEXTS[5])[0] == ("name", "XENIA VAN DER PLOR") and ("phone", "(585) 555-0145") in found(model, TEXTS[5])
    assert found(model, TEXTS[6]) == []
    assert found(model, TEXTS[7]) == [("address", "Kenelplatz 135b, 00453 Lilum")]
    assert [k for k, _ in found(model, TEXTS[8])] == ["address", "address"]


def test_positions_are_code_points(model):
    text = "😀😀 İ " + TEXTS[0]
    assert model.spans(text, model.lexicon())[0].start == text.index("Jürgen")


def test_odd_texts(model):
    for text in (None, "", "   ", "\n", "a" * 200_000, "1 " * 50_000, "(" * 1000):
        assert model.spans(text, model.lexicon()) == []


def test_tables(spark, model):
    m = spark.createDataFrame([("1", TEXTS[0], "clash"), ("2", None, "x"), ("3", "", "x"), ("1", TEXTS[0], "x")], "id string, content_text string, pii_kind string")
    texts = pii.texts_of(m, m.limit(0))
    assert sorted((r["record_id"], r["pii_kind"], r["start_pos"]) for r in pii.find(texts, model).collect()) == [("1", "name", 14), ("1", "name", 14), ("1", "phone", 31), ("1", "phone", 31)]
    out = {r["record_id"]: r["text"] for r in pii.redact(texts, model).collect()}
    assert out == {"1": "You can reach [NAME] at [PHONE] after lunch.", "3": ""}
    assert pii.find(texts.limit(0), model).count() == 0
    fitted = pii.fit(spark.createDataFrame([("messages", str(i), t) for i, t in enumerate(FILLER + TEXTS * 5)], "record_table string, record_id string, text string"))
    assert fitted.common
    assert F is not None


def test_em_trusts_what_agrees():
    post = pii.reliabilities({(1, 1, 1, 1): 500, (1, 1, 0, 0): 100, (-1, 1, -1, 0): 80, (1, 0, -1, 0): 60})
    assert post[1, 1, 1, 1] > 0.9 and post[-1, 1, -1, 0] < 0.2 and post[1, 0, -1, 0] < 0.5


SURNAMES = [a + b + c + d for a in ("Kal", "Tor", "Ve", "Mi", "Dro") for b in ("ban", "ler", "dim", "vor", "sag") for c in ("ic", "ume", "ora", "ent", "ask") for d in ("", "son", "berg", "ov")]
SENTENCES = ["You can reach {} at noon.", "Please ask {} or the desk.", "Emergency contact {}, third floor.", "Regards,\n{}\nThe build is green.", "I spoke with {} on the train."]


def _corpus():
    given = sorted(pii.GIVEN)[::4]
    cases = [(SENTENCES[(i + j) % 5], g, SURNAMES[(9 * i + j) % len(SURNAMES)]) for i, g in enumerate(given) for j in range(9)]
    return [(t.format(f"{g.title()} {s}"), f"{g.title()} {s}") for t, g, s in cases]


def test_given_names_are_learned_from_context(monkeypatch):
    cases = _corpus()
    unknown = {n.split()[0].lower() for _, n in cases[::18]}
    monkeypatch.setattr(pii, "GIVEN", pii.GIVEN - set(sorted({n.split()[0].lower() for _, n in cases})[::2]))
    m = pii.train(FILLER + [t for t, _ in cases])
    hit = sum(("name", n) in found(m, t) for t, n in cases)
    assert hit >= 0.95 * len(cases) and unknown
    assert len(m.given) > len(pii.GIVEN)


def test_unknown_names_and_places():
    m = pii.train(FILLER + [t for t, _ in _corpus()])
    for text, name in (("We met Chidinma Venkatesan today.", "Chidinma Venkatesan"), ("Hiroshi Tanaka joined the call yesterday.", "Hiroshi Tanaka"), ("card owner Wanjiru Kamau", "Wanjiru Kamau")):
        assert ("name", name) in found(m, text)
    assert found(m, "It takes Port Quella an hour.") == []


def test_addresses_over_long_lines_and_several_lines(model):
    gap = "x " * 3000
    text = f"{gap}Send it to 281 Nakel Road, Vemorford ZZ8 5QX. {gap}Then 12 Tomor Street\nNerel, ZZ 00376, {gap}"
    assert [v for k, v in found(model, text) if k == "address"] == ["281 Nakel Road, Vemorford ZZ8 5QX", "12 Tomor Street\nNerel, ZZ 00376"]


def test_fit_counts_every_text(spark):
    n = 26_000
    rare = [f"Opening{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghij"]  # each begins five texts, as few as count among so many
    texts = [f"{w} of file {i}" for w in rare for i in range(5)] + [f"entry {i} was filed" for i in range(n)] + TEXTS * 3
    rows = spark.createDataFrame([("messages", str(i), t) for i, t in enumerate(texts)], "record_table string, record_id string, text string")
    fitted, here = pii.fit(rows), pii.train(texts)
    assert {w.lower() for w in rare} <= fitted.starters
    assert (fitted.common, fitted.starters, fitted.given) == (here.common, here.starters, here.given)
    assert abs(fitted.weights - here.weights).max() < 0.05 and abs(here.weights).max() > 0.5
    # a kind of case that only one text in 26,000 has is fitted too
    assert found(fitted, TEXTS[3]) == found(here, TEXTS[3]) and found(fitted, TEXTS[3])


def test_names_are_learned_over_tables_as_here(spark, monkeypatch):
    cases = _corpus()
    half = set(sorted({n.split()[0].lower() for _, n in cases})[::2])
    monkeypatch.setattr(pii, "GIVEN", pii.GIVEN - half)
    taught = [t.replace(f"{n.split()[0]} ", f"{n.split()[0]}q ") for t, n in cases]  # no such names in the workers' list
    rows = spark.createDataFrame([("messages", str(i), t) for i, t in enumerate(FILLER + taught)], "record_table string, record_id string, text string")
    learned = pii.fit(rows).given
    assert learned == pii.train(FILLER + taught).given and len(learned) > len(pii.GIVEN) + 20


def test_each_text_is_searched_once(spark, tmp_path):
    odd = [TEXTS[0], TEXTS[0], None, "", "😀😀 İ " + TEXTS[0], "\n"]
    m = spark.createDataFrame([(str(i), t) for i, t in enumerate(FILLER + TEXTS * 3 + odd)], "id string, content_text string")
    texts = pii.texts_of(m, m.limit(20))
    model, searched = pii.fitted(texts)
    once, again = pii.find(texts, model, searched), pii.find(texts, model)
    assert once.dtypes == again.dtypes and sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect())) and once.count() > 30
    assert pii.find(texts, model, searched.limit(0)).count() == 0  # what was not kept is not looked for
    once, again = pii.redact(texts, model, searched), pii.redact(texts, model)
    assert once.dtypes == again.dtypes and sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))
    for name in ("messages", "segments"):
        m.write.parquet(str(tmp_path / f"{name}.parquet"))
    plan = queries.p1_found(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan
